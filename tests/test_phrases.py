"""Phrases among postings: a bounded set is walked chunk by chunk, with the rows of the joins that larger sets take."""

import random

import pytest

from notelode.operators import postings

PHRASES = [
    ["a", "b"], ["b", "a"], ["a", "a"], ["a", "a", "b"], ["b", "c", "d"], ["c"], ["d", "e"], ["e", "nowhere"], ["a", "b", "c", "d", "e"], ["f", "a"],
]
SCHEMA = "chunk_id string, file_path string, content string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(f"c{i}", f"f{i % 5}", " ".join(rng.choice("aaabbcdef") for _ in range(rng.randrange(40)))) for i in range(150)]
    return rows + [("long", "f", " ".join(rng.choice("abcdef") for _ in range(3000))), ("none", "f", None), ("empty", "f", "")]


def found(rows):
    return sorted((tuple(r["parts"]), r["chunk_id"], r["tf"]) for r in rows.collect())


def plain(rows):
    out = []
    for parts in PHRASES:
        for chunk, _, text in rows:
            words = (text or "").split()
            tf = sum(words[i : i + len(parts)] == parts for i in range(len(words)))
            out += [(tuple(parts), chunk, tf)] if tf else []
    return sorted(out)


def test_phrases_are_walked_without_a_row_for_each_place_and_phrase(spark, texts, monkeypatch):
    monkeypatch.setattr(postings, "TOKENS_PER_STEP", 50)
    index = postings.postings(spark.createDataFrame(texts, SCHEMA).repartition(7))
    got = postings.phrase_hits(index, spark.createDataFrame([(p,) for p in PHRASES], "parts array<string>"))
    assert found(got) == plain(texts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("batch", ["40", "10000"])
def test_small_and_large_sets_find_the_same_where_ids_repeat_or_are_null(spark, texts, batch, monkeypatch):
    twice = texts[:20] + [(a, b + "x", c) for a, b, c in texts[10:30]] + [("c1", "f1", "a b c d e a a"), (None, "f", "a b a b")]
    index = postings.postings(spark.createDataFrame(texts + twice, SCHEMA)).localCheckpoint()
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "parts array<string>")
    monkeypatch.setattr(postings, "MAX_BROADCAST_KEYS", -1)
    want = found(postings.phrase_hits(index, phrases))
    monkeypatch.undo()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found(postings.phrase_hits(index, phrases)) == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_phrase_of_known_words(spark, texts):
    index = postings.postings(spark.createDataFrame(texts, SCHEMA))
    none = spark.createDataFrame([(["x", "y"],), ([],)], "parts array<string>")
    assert postings.phrase_hits(index, none).collect() == []
    assert postings.phrase_hits(index.limit(0), spark.createDataFrame([(["a", "b"],)], "parts array<string>")).collect() == []
