import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from notelode.llm import pii
from notelode.llm.pii import KINDS, personal_data, redact

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), at, kind, m.end())
        for at, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])
    ]
    return sorted(found)


def made():
    rng = random.Random(6)
    parts = ["a", "1", "2", ".", "@", "-", " ", "+", "(", ")", "é", "b.c", "@x.y", "12", "4539 1488 0343 6467", "..",
             "10.0.0.1", "%", "\n", "5555-", "\U0001F600", "+1 (604) 555-1234", "999.1.2.3"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(50)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "1 " * 30_000), (5003, "a@b" + ".c" * 20_000), (5004, "9" * 50_000)]
    return rows + [(5005, "x" * 100_000), (5006, "me@x.org 10.0.0.1"), (5006, "me@x.org 10.0.0.1"), (None, "me@x.org")]


def test_base_spans_equal_the_plain_patterns(docs):
    rows = made()
    got = personal_data(docs(rows)).collect()
    want = Counter()
    for i, text in rows:
        spans = brute(text)
        kinds = Counter(k for _, _, k, _ in spans)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        want[(i, *(kinds[k] for k in KINDS), sha)] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        spans = set(r.spans.split(",")) if r.spans else set()
        if r.doc_id is not None and r.doc_id != 5006:
            assert {f"{k}:{a}:{b}" for a, _, k, b in brute(dict(rows)[r.doc_id])} <= spans


def test_without_training_rows_and_empty(docs):
    got = personal_data(docs([(1, "plain"), (2, None)])).collect()
    assert {(r.doc_id, r.spans, r.n_added) for r in got} == {(1, "", 0), (2, "", 0)}
    assert personal_data(docs([(1, "a")]).limit(0)).count() == 0


def test_redaction_keeps_rows_and_columns(docs):
    rows = [(1, "é me@x.org, 10.0.0.1 end"), (1, "é me@x.org, 10.0.0.1 end"), (None, "+1 (604) 555-1234"), (3, None), (4, "none")]
    source = docs(rows)
    got = redact(source)
    assert got.columns == source.columns
    texts = sorted(((r.doc_id or 0), r.text or "") for r in got.collect())
    assert texts == [(0, "[PHONE]"), (1, "é [EMAIL], [IP] end"), (1, "é [EMAIL], [IP] end"), (3, ""), (4, "none")]


def test_texts_with_very_many_spans_are_linear(docs):
    import time

    lines = "\n".join(f"10.0.{i % 256}.{i // 256} user{i}@mail.example.org (at) +49 30 {1000000 + i}" for i in range(12_000))
    started = time.time()
    got = pii.personal_data(docs([(1, lines), (2, "call me: a@b.cd"), (3, None)])).collect()
    row = next(r for r in got if r.doc_id == 1)
    assert row.n_ip == 12_000 and row.n_email == 12_000 and row.n_phone == 12_000
    assert time.time() - started < 120


def test_labels_of_proposals_equal_plain_overlap(frame):
    import random

    rng = random.Random(2)
    rows = []
    for row in range(30):
        for _ in range(rng.randrange(0, 25)):
            start = rng.randrange(0, 120)
            base = rng.random() < 0.4
            rows.append((row, row, row, "email" if base else "digits", "email", start, start + rng.randrange(1, 15), "1 2", "", "", base))
    schema = ("row long, doc_id long, text_key long, source string, kind string, start long, end long, match string, left string,"
              " right string, base boolean")  # fmt: skip
    got = sorted((r.row, r.start, r.end, r.label) for r in pii.judged(frame(rows, schema)).collect())
    want = sorted(
        (r[0], r[5], r[6], float(any(b[0] == r[0] and b[10] and b[5] < r[6] and r[5] < b[6] for b in rows))) for r in rows if not r[10]
    )
    assert got == want


def test_likeliest_equals_plain_comparison(frame):
    import random

    rng = random.Random(4)
    rows = [(row, row, row, (s := rng.randrange(0, 60), rng.randrange(1, 5), s + rng.randrange(1, 12), rng.choice([0.5, 0.7, 0.9])))
            for row in range(40) for _ in range(rng.randrange(0, 12))]
    schema = "row long, doc_id long, text_key long, s struct<start:bigint,rank:int,end:bigint,p:double>"
    got = sorted((r.row, *r.more) for r in pii._likeliest(frame(rows, schema)).collect())
    key = lambda s: (s[3], -s[0], s[2], -s[1])
    want = sorted({
        (row, *s[:3]) for row, _, _, s in rows
        if not any(r == row and o[0] < s[2] and s[0] < o[2] and key(o) > key(s) for r, _, _, o in rows)
    })
    assert got == want


def test_training_counts_every_proposal(docs, monkeypatch):
    """More proposals than the former sample held: all of them reach the trees, as weights."""
    lines = [f"me{i}@x.org 10.0.{i % 256}.7 +1 (604) 555-{i:04d} 12-{i}-3456 1 . 2 . 3 . {i}" for i in range(5_500)]
    proposals = pii.judged(pii.candidates(docs([(i, "\n".join(lines[i * 25 : i * 25 + 25])) for i in range(220)]))).cache()
    side = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    total, fitted = proposals.count(), proposals.where(side > 0).count()
    seen = []
    real = pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, df: seen.append(df.agg(F.sum("weight")).first()[0]) or real(self, df))
    assert pii.train(proposals) is not None
    assert total > 20_000 and seen == [fitted]
