"""Ranked search over stored postings: equal to token arrays, and what it leaves unread."""

import random

import pytest

from notelode.operators import lexical, postings


@pytest.fixture(scope="module")
def library(spark):
    """Common words of very different frequency, rare words, phrases, ties and empty texts."""
    rng = random.Random(11)
    rows = [("", None), ("e1", ""), ("e2", " ,")]
    for i in range(900):
        words = ["common"] * (1 if rng.random() < 0.97 else rng.randrange(20, 60)) + [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        words += ["usual"] * rng.randrange(0, 3) + (["new", "york"] if rng.random() < 0.3 else []) + (["york", "new"] if rng.random() < 0.2 else [])
        rng.shuffle(words) if rng.random() < 0.5 else None
        rows.append((f"c{i:04d}", " ".join(words)))
    rows += [("t1", "common tie"), ("t2", "common tie")]
    frame = spark.createDataFrame([(a, a + ".md", b) for a, b in rows], "chunk_id string, file_path string, content string")
    return rows, frame


@pytest.fixture(scope="module")
def stored(spark, library, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("postings"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = {k: conf.get(k) for k in ("parquet.block.size", "parquet.page.row.count.limit", "parquet.page.size.row.check.min")}
    conf.set("parquet.page.row.count.limit", "50")
    try:
        postings.write(postings.postings(library[1]), folder, 2)
    finally:
        for key, value in kept.items():
            conf.set(key, value) if value is not None else conf.unset(key)
    return spark.read.parquet(folder)


QUESTIONS = [
    ("a", "common"), ("b", "common usual"), ("c", "w7 common"), ("d", "new_york"), ("e", "common new_york usual"), ("f", "missing common"),
    ("g", "tie"), ("h", "york new common"), ("i", "..."), ("j", "common common w9"),
]


def ranked(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["bm25"], 9)) for r in hits.collect())


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_best_hits_equal_token_arrays(spark, library, stored, k):
    asked = spark.createDataFrame(QUESTIONS, "query_id string, question string")
    want = ranked(lexical.lexical_top_k(lexical.index_chunks(library[1]), asked, k))
    assert ranked(postings.best_hits(stored, asked, k)) == want and len(want) >= 8
    assert ranked(lexical.lexical_top_k(stored, asked, k)) == want


def test_stored_statistics_serve_the_search(spark, stored):
    asked = spark.createDataFrame(QUESTIONS[:3], "query_id string, question string")
    parts = postings.statistics(stored.where("length % 2 = 0")).unionByName(postings.statistics(stored.where("length % 2 = 1")))
    assert ranked(postings.best_hits(stored, asked, 4, parts)) == ranked(postings.best_hits(stored, asked, 4))


def test_many_terms_are_joined(spark, stored, monkeypatch):
    asked = spark.createDataFrame(QUESTIONS, "query_id string, question string")
    want = ranked(postings.best_hits(stored, asked, 5))
    monkeypatch.setattr(postings, "MAX_NAMED_TERMS", 1)
    assert ranked(postings.best_hits(stored, asked, 5)) == want


def rows_read(df):
    """Rows that the scans of a plan hand on, after pages are skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_low_classes_and_other_terms_are_not_read(spark, stored):
    asked = spark.createDataFrame([("a", "common")], "query_id string, question string")
    search = postings._Search(stored, asked, None)
    first = postings._ranked(search.hits(postings._above(search.index, search.first_look(5))), 5)
    bars = first.where("rank = 5").selectExpr("query_id", "-bm25 AS bar")
    floors = search.floors(bars)
    assert floors.first()["floor"] > 0
    all_of_it = stored.count()
    of_term = stored.where("term = 'common'").count()
    assert of_term > 800
    assert rows_read(stored.where("term = 'common'").select("positions")) < all_of_it / 2
    assert rows_read(postings._above(stored, floors).select("positions")) < of_term / 3


def test_phrases_equal_plain_counting(spark, library, stored):
    wanted = [["new", "york"], ["york", "new"], ["common", "common"], ["common", "usual", "new"], ["nowhere", "common"]]
    phrases = spark.createDataFrame([(w,) for w in wanted], "parts array<string>")
    got = {(tuple(r["parts"]), r["chunk_id"]): r["tf"] for r in postings.phrase_hits(stored, phrases).collect()}
    want = {}
    for chunk, text in library[0]:
        words = (text or "").split()
        for parts in wanted:
            n = sum(words[i : i + len(parts)] == parts for i in range(len(words)))
            if n:
                want[tuple(parts), chunk] = n
    assert got == want and len(want) > 100
