import hashlib
import random

from notelode.llm.warc import LoserTree, parse, read_histories, shared_folder, url_key, write_archives

SCHEMA = "page_id long, url string, html string, n int, digest string"
TRICKY = "WARC/1.0\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4


def rows():
    big, same = "é" * 200_000, "same payload " * 20
    pages = [(7, "http://b.org/x", same), (3, "http://a.b.org/y", same), (9, None, same), (4, "http://b.org/x", "short"), (5, "http://b.org/x", "short")]
    pages += [(11, "http://b.org/x", None), (12, "", ""), (13, "http://b.org/w\r\nInjected: 1", TRICKY), (14, "http://z.org", big), (15, "u", big)]
    pages += [(3, "http://a.b.org/y", same), (None, "http://n.org/", "no id " * 30), (None, "http://n.org/", same)]
    return pages


def test_written_archives_read_back(frame, spark):
    folder = shared_folder(spark)
    source = frame([(*r, 1, "clash") for r in rows()], SCHEMA)
    write_archives(source, folder, archive_bytes=4_000)
    got = read_histories(spark, folder).collect()
    assert len(got) == len(rows())
    payloads = {}
    for page, _, html in rows():
        data = (html or "").encode()
        payloads.setdefault(data, []).append(page)
    want = []
    for data, pages in payloads.items():
        first = min((p for p in pages if p is not None), default=None)
        for page in pages:
            again = len(data) >= 100 and page != first
            want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    history = sorted(got, key=lambda r: r.position)
    assert [r.position for r in history] == list(range(len(got)))
    order = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in history]
    assert order == sorted(order)


def test_records_lie_where_the_index_says(frame, spark):
    folder = shared_folder(spark)
    write_archives(frame([(*r, 1, "") for r in rows()], SCHEMA), folder)
    files = spark.read.format("binaryFile").load(folder).where("path LIKE '%.txt'").collect()
    records = [x for f in files for x in parse(bytes(f.content))]
    assert {(place, length) for place, length, _, _ in records} == {(r.place, r.length) for r in read_histories(spark, folder).collect()}


def test_empty_table(frame, spark):
    folder = shared_folder(spark)
    write_archives(frame([], SCHEMA), folder)
    assert read_histories(spark, folder).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(0)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("http://WWW.b.org:80/A?b#c") == "org:80,b,www)/A?b#c"
    assert url_key(None) == ")" and url_key("plain") == ")plain"


def test_page_numbers_of_any_size(frame, spark):
    folder = shared_folder(spark)
    ids = [2**63 - 1, -(2**63), 2**62, 0, -1]
    write_archives(frame([(i, "http://a.org/", "same " * 40) for i in ids], "page_id long, url string, html string"), folder)
    got = {r.page_id: r for r in read_histories(spark, folder).collect()}
    assert set(got) == set(ids)
    assert [i for i in ids if got[i].record_type == "response"] == [-(2**63)]
    assert all(r.refers_to == -(2**63) for i, r in got.items() if i != -(2**63))
    assert all(len(r.captured) == 20 for r in got.values())
