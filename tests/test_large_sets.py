"""Large question sets: what is handed on grows with the questions, and texts meet only the rows that need them."""

import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelode.catalog import inputs, queries
from notelode.config import Chunking, Config
from notelode.functions import steps
from notelode.operators import chunking, lexical, vector
from notelode.operators.packing import contexts, pack
from notelode.plans import retrieve as plan

CHUNK = (
    "chunk_id string, file_path string, heading_path array<string>, content string, tokens int,"
    " mtime long, embedding array<double>"
)
WORDS = ["alpha", "beta", "gamma", "delta", "foo_bar", "omega"]


@pytest.fixture(scope="module")
def library(spark):
    """Chunks with rows that come twice, nulls, no tokens and no vectors."""
    rng = random.Random(11)
    rows = []
    for i in range(80):
        content = None if i % 31 == 7 else " ".join(rng.choices(WORDS, k=rng.randint(1, 90)))
        vectors = [] if i % 13 == 5 else [rng.gauss(0, 1) for _ in range(4)]
        tokens = (None, 0, len((content or "").split()))[min(i % 9, 2)]
        rows.append((f"c{i:02}", None if i % 17 == 3 else f"f{i % 25}.md", ["H", str(i % 3)], content, tokens, i, vectors))
    chunks = spark.createDataFrame(rows + rows[10:14], CHUNK).repartition(9)
    asked = [(f"q{i}", " ".join(rng.sample(WORDS, 2)), [rng.gauss(0, 1) for _ in range(4)]) for i in range(12)]
    return chunks, spark.createDataFrame(asked, "query_id string, question string, vector array<double>")


def rows_of(df):
    return sorted((tuple(str(value) for value in row) for row in df.collect()))


def test_hits_of_block_pairs_do_not_grow_with_the_chunks(spark):
    rows = [(f"c{i:04}", [float(i % 7), 1.0], 0.0) for i in range(800)]
    chunks = spark.createDataFrame(rows, "key string, embedding array<double>, boost double").repartition(40)
    asked = spark.createDataFrame([(f"q{i}", [1.0, i + 1.0], None) for i in range(6)], "query_id string, vector array<double>, skip string")
    hits = vector._block_pairs(chunks, asked, 3, "dot", False, 2)
    assert hits.count() <= vector.CHUNK_SLICES * 3 * 6


def test_large_lexical_sets_salt_ids_alone(library, monkeypatch):
    chunks, asked = library
    joined = []
    real = lexical.salted_join
    monkeypatch.setattr(lexical, "salted_join", lambda large, small, *rest: joined.append((large.columns, small.columns)) or real(large, small, *rest))
    monkeypatch.setattr(lexical, "_phrase_documents", lambda *_: pytest.fail("there are no phrases"))
    index, plain = lexical.index_chunks(chunks.where("content is not null").dropDuplicates(["chunk_id"])), asked.where(~F.col("question").contains("_"))
    want = rows_of(lexical.lexical_hits(index, plain))
    joined.clear()
    assert rows_of(lexical.lexical_hits(index, plain, max_questions=1)) == want and len(want) > 20
    assert joined == [(["probe", "chunk_id"], ["query_id", "probe"])]


@pytest.mark.parametrize("hybrid", [True, False])
def test_texts_meet_only_final_rows(library, monkeypatch, hybrid):
    """With both searches over unique chunks, and by vectors alone over rows that come twice."""
    chunks, asked = library
    config = Config()
    config = replace(config, features=replace(config.features, hybrid_retrieval=hybrid))
    if hybrid:
        chunks = chunks.where("content is not null").dropDuplicates(["chunk_id"])
    small = plan.retrieve(chunks, asked, config, 0)
    unique = small.groupBy("query_id", "chunk_id").count().where("count = 1").count()
    want, want_context = rows_of(small), rows_of(contexts(pack(small, config.retrieval.context_token_budget)))
    attached = []
    real = plan.attach
    monkeypatch.setattr(plan, "small_rows", lambda *_: None)
    monkeypatch.setattr(plan, "attach", lambda ranked, found, columns, few: attached.append([str(c) for c in columns]) or real(ranked, found, columns, few))
    assert rows_of(plan.retrieve(chunks, asked, config, 0)) == want and unique > 50
    assert attached and all("content" not in columns for columns in attached)
    assert rows_of(contexts(plan.retrieve_packed(chunks, asked, config, 0))) == want_context


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"alpha beta {i}", "en", f"src{i % 3}", 9) for i in range(20)]
    spark.createDataFrame(docs + docs[:2], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [float(i), 1.0], i % 2) for i in range(12)]
    spark.createDataFrame(vectors + vectors[:1], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_a_stored_corpus_has_the_same_rows(spark, tables):
    for counted in (False, True):
        stored = inputs.stored_corpus(spark, tables, counted)
        lazy = inputs.corpus(spark, tables)
        assert rows_of(stored.select(lazy.columns)) == rows_of(lazy)


class Seen(Exception):
    pass


@pytest.mark.parametrize("name,module,function", [
    ("eval_metrics", queries, "retrieve"), ("hybrid_passages", queries, "retrieve"),
    ("answer_questions", queries.answer_plan, "answer"), ("eval_answers", queries.answer_plan, "evaluate"),
])
def test_queries_search_a_stored_corpus(spark, tables, monkeypatch, name, module, function):
    """Texts were shuffled to their vectors by every scan of the search."""

    def look(chunks, *_):
        raise Seen(chunks._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(module, function, look)
    with pytest.raises(Seen) as seen:
        queries.QUERIES[name](spark, tables)
    assert "Join" not in str(seen.value)


def test_notes_are_planned_in_small_steps(monkeypatch):
    sizes = []
    real = pa.array
    monkeypatch.setattr(chunking.pa, "array", lambda rows, kind: sizes.append(len(rows)) or real(rows, kind))
    n = 1000
    plans = chunking._plan_udf(Chunking()).func(
        real(["1.a"] * n), real([[2, 0, 3]] * n, pa.list_(pa.int32())), real([["Head"]] * n), real([None] * n, pa.string()), real(["x"] * n)
    )
    assert len(plans) == n and max(sizes) <= steps.ROWS_PER_STEP
    assert plans[n - 1].as_py() == {"title": "Head", "chunks": [
        {"heading_path": ["Head"], "parts": [{"overlap": False, "lines": [2]}], "tokens": 3, "chunk_type": "text"}
    ]}
