"""Commits of large buckets: more files than asked for instead of one large sort, statistics without a shuffle."""

import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from notelode.models import StandIn
from notelode.operators import postings
from notelode.plans.index_run import index_notes
from notelode.sources import store as stores


def notes(spark, first, last, more=""):
    rng = random.Random(first)
    rows = [(f"n{i}.md", 1 + len(more), " ".join(f"w{rng.randrange(40)}" for _ in range(60)) + more) for i in range(first, last)]
    return rows, spark.createDataFrame(rows, "file_path string, mtime long, markdown string")


def test_large_buckets_are_dealt_to_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "TOKENS_PER_FILE", 500)
    store = stores.NoteStore(spark, str(tmp_path / "index"), buckets=2, files_per_bucket=1)
    rows, frame = notes(spark, 0, 80)
    index_notes(store, frame, StandIn())
    for table in ("chunks", "postings"):
        assert all(len([*b.glob("*.parquet")]) > 2 for b in Path(tmp_path, "index", table, "v=1").glob("bucket=*"))
    changed, frame = notes(spark, 70, 90, " more")
    index_notes(store, frame, StandIn(), whole=False)
    want = {path: Counter(text.split()) for path, _, text in [*rows, *changed]}
    held = store.lexical_index().where(F.col("term") != postings.ALL)
    got = Counter({(r["file_path"], r["term"]): r["tf"] for r in held.groupBy("file_path", "term").agg(F.sum("tf").alias("tf")).collect()})
    assert got == Counter({(path, term): n for path, counts in want.items() for term, n in counts.items()})
    assert {r["path"] for r in store.files().collect()} == {*want}

    def plain(df):
        return sorted(tuple(r[c] for c in ("term", "impact", "df", "cf", "length", "most", "least")) for r in df.collect())

    assert plain(postings.merged(store.statistics())) == plain(postings.statistics(store.lexical_index()))


def test_parts_of_statistics_need_no_shuffle_and_add_up(spark):
    texts = [(f"c{i}", f"f{i}", " ".join(random.Random(i).choices("abcd", k=30))) for i in range(60)] + [("e", "f", "")]
    index = postings.postings(spark.createDataFrame(texts, "chunk_id string, file_path string, content string"))
    sorted_ = index.repartition(2, "term").sortWithinPartitions("term", "impact").localCheckpoint()
    parts = postings.neighbours_statistics(sorted_)
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r["term"], r["impact"])
    want = sorted(map(tuple, postings.statistics(index).collect()))
    assert sorted(map(tuple, postings.merged(parts).select(*postings.statistics(index).columns).collect())) == want
    assert Counter(map(key, parts.collect())).most_common(1)[0][1] <= 2
    assert postings.neighbours_statistics(sorted_.limit(0)).collect() == []
