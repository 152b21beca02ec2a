"""Postings made row by row: equal to a plain count, without a shuffle, copies and snapshots included."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from notelode.functions import text as T
from notelode.operators import postings

SCHEMA = "chunk_id string, file_path string, content string"


def plain(rows):
    found, whole = defaultdict(list), []
    for chunk_id, path, text in rows:
        if text is not None:
            tokens = text.lower().split()
            whole.append(("", chunk_id, path, len(tokens), ()))
            for at, term in enumerate(tokens):
                found[term, chunk_id, path, len(tokens)].append(at)
    return sorted(([*k, tuple(sorted(v))] for k, v in found.items()), key=repr) + sorted(map(list, whole), key=repr)


def made(frame):
    rows = [[r["term"], r["chunk_id"], r["file_path"], r["length"], tuple(r["positions"])] for r in frame.collect()]
    return sorted((r for r in rows if r[0]), key=repr) + sorted((r for r in rows if not r[0]), key=repr)


def test_postings_equal_a_plain_count_and_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    rows = [(f"c{i}", f"f{i % 7}", text(rng.randrange(60))) for i in range(200)] + [("n", "f", None), ("e", None, ""), ("l", "f", text(5000))]
    monkeypatch.setattr(postings, "TOKENS_PER_STEP", 100)
    index = postings.postings(spark.createDataFrame(rows, SCHEMA))
    assert made(index) == plain(rows)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()


def test_chunks_that_come_twice_keep_one_row_for_a_term(spark):
    rows = [("a", "f", "x y x"), ("a", "f", "x y z"), ("a", "f", "x"), ("b", "f", "x"), (None, "f", "x y"), (None, "f", "y y")]
    assert made(postings.postings(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_tokens_of_plain_and_other_texts(spark):
    texts = ["Plain ASCII_text-12 a", "Größe İx ǅ áb 42٣ 中文 x", "KK", "", None, "\x00a\x7fb", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.regexp_extract_all(T.fold(F.col("t")), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
    assert all(r["a"] == r["b"] for r in df.select(T.index_tokens(F.col("t")).alias("a"), whole.alias("b")).collect())
