"""Hybrid retrieval for any number of questions as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.vectors import recency_boost
from ..models import ModelClient
from ..operators.filters import Filters
from ..operators.fusion import attach, cap_per_file, fuse
from ..operators.lexical import index_chunks, lexical_top_k
from ..operators.lineage import cut
from ..operators.mmr import diversify
from ..operators.packing import chunk_cost, pack
from ..operators.rerank import rerank
from ..operators.sizing import few, small_rows
from ..operators.vector import vector_top_k

PAYLOAD = ("file_path", "heading_path", "content", "tokens")
QUESTION = "query_id string, question string, vector array<double>"


def settle(questions: DataFrame) -> tuple[DataFrame, bool]:
    """Questions computed once, and whether they are few enough to broadcast."""
    slim = questions.select(
        F.col("query_id").cast("string").alias("query_id"), "question",
        F.col("vector").cast("array<double>").alias("vector"),
    )
    rows = small_rows(slim, F.octet_length("question") + F.size("vector") * 8)
    if rows is None:
        return cut(slim), False
    return questions.sparkSession.createDataFrame(rows, QUESTION), True


def filter_hits(hits: DataFrame, chunks: DataFrame, filters: Filters, small: bool) -> DataFrame:
    """Lexical hits whose chunk exists and passes, ranked anew after the cut."""
    if filters.empty:
        return hits
    order = Window.partitionBy("query_id").orderBy("_was")
    kept = attach(
        hits.withColumnRenamed("rank", "_was"), chunks.where(filters.predicate()), [], small
    )
    return kept.withColumn("rank", F.row_number().over(order)).drop("_was")


def _versions(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``_version``, which tells rows of one chunk id apart unless they are equal."""
    nulls = F.array(*(F.col(name).isNull() for name in (*PAYLOAD, "embedding")))
    return chunks.withColumn("_version", F.xxhash64("chunk_id", *PAYLOAD, "embedding", F.size("heading_path"), nulls))


def _chosen(ranked: DataFrame, chunks: DataFrame, config: Config) -> DataFrame:
    """The rows of ``ranked`` that the per-file cap and diversification leave, ranked anew.

    ``ranked`` has an ``embedding`` or the ``_version`` by which it is read for the pool alone.
    """
    settings = config.retrieval
    capped = cap_per_file(ranked)
    top_n, pool = settings.rerank_top_n, settings.diversification_pool
    if not config.features.mmr_diversification:
        return capped.where(F.col("rank") <= top_n)
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    in_pool = F.col("rank") <= pool
    if pool < top_n:
        in_pool = in_pool | (F.col("_total") <= top_n)
    pooled = capped.withColumn("_total", total).where(in_pool).drop("_total")
    if "embedding" not in pooled.columns:
        known = chunks.select("chunk_id", "_version", F.col("embedding").cast("array<double>").alias("embedding"))
        pooled = pooled.join(known.dropDuplicates(["chunk_id", "_version"]), ["chunk_id", "_version"])
    return diversify(pooled, top_n, settings.mmr_lambda).drop("embedding")


def _with_payload(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` with the payload of their versions; texts of chunks that are not asked for stay where they are."""
    asked = cut(rows.select("chunk_id", "_version").distinct())
    keys = few(asked.select("chunk_id").distinct(), "chunk_id")
    held = chunks.join(keys, "chunk_id", "left_semi").join(asked, ["chunk_id", "_version"], "left_semi")
    held = held.select("chunk_id", "_version", *PAYLOAD).dropDuplicates(["chunk_id", "_version"])
    return rows.drop("file_path").join(held, ["chunk_id", "_version"]).drop("_version")


def _fused(
    chunks: DataFrame, questions: DataFrame, small: bool, config: Config, now_ms: int, filters: Filters,
    index: DataFrame | None,
) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of both searches together; ``questions`` are settled."""
    settings = config.retrieval
    boost = recency_boost(F.col("mtime"), settings.recency_boost, now_ms)
    vector = vector_top_k(
        chunks.where(filters.predicate()), questions, settings.vector_top_k, boost
    )
    if config.features.hybrid_retrieval:
        tokens = index_chunks(chunks) if index is None else index
        lexical = lexical_top_k(tokens, questions, settings.lexical_top_k)
        lexical = filter_hits(lexical, chunks, filters, small)
    else:
        lexical = vector.limit(0)
    weights = settings.fusion_weights
    fused = fuse(vector, lexical, weights.vector, weights.lexical)
    return fused.select("query_id", "chunk_id", "score", "rank")


def _slim(fused: DataFrame, chunks: DataFrame, config: Config) -> DataFrame:
    """The final rows of a large question set without texts: ``_version`` and ``tokens``, what a text costs."""
    cost = chunk_cost(F.col("tokens"), F.col("content")).alias("tokens")
    return _chosen(attach(fused, chunks, ["_version", "file_path", cost], False), chunks, config)


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    config: Config | None = None,
    now_ms: int = 0,
    filters: Filters | None = None,
    client: ModelClient | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Final ranked chunks per question: ``query_id, chunk_id, score, rank`` and the payload.

    ``questions`` has ``query_id, question, vector``. Filters apply before the vector cut and
    after the lexical one. ``client`` enables reranking. ``index`` is the stored lexical index;
    without it tokens are taken from the chunk contents.
    """
    config, filters = config or Config(), filters or Filters()
    questions, small = settle(questions)
    fused = _fused(chunks, questions, small, config, now_ms, filters, index)
    if small:
        vector = F.col("embedding").cast("array<double>").alias("embedding")
        final = _chosen(attach(fused, chunks, [*PAYLOAD, vector], small), chunks, config)
    else:
        # Texts meet only the final rows of a large question set.
        versions = _versions(chunks)
        final = _with_payload(cut(_slim(fused, versions, config)).drop("tokens"), versions)
    final = final.select("query_id", "chunk_id", "score", "rank", *PAYLOAD)
    if config.features.reranking and client is not None:
        final = rerank(
            final, questions, config.prompts.reranker, client, config.models.reranker_model
        ).select(*final.columns)
    return final


def retrieve_packed(
    chunks: DataFrame,
    questions: DataFrame,
    config: Config | None = None,
    now_ms: int = 0,
    filters: Filters | None = None,
    client: ModelClient | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``retrieve`` that ``pack`` admits to the budget, with their ``label``.

    Of a large question set only these rows ever meet their texts, unless a model reorders them.
    """
    config, filters = config or Config(), filters or Filters()
    budget = config.retrieval.context_token_budget
    questions, small = settle(questions)
    if small or (config.features.reranking and client is not None):
        return pack(cut(retrieve(chunks, questions, config, now_ms, filters, client, index)), budget)
    versions = _versions(chunks)
    slim = cut(_slim(_fused(chunks, questions, small, config, now_ms, filters, index), versions, config))
    # Tokens are what a text costs already; a text that is null has no cost, as in ``pack``.
    priced = slim.withColumn("content", F.when(F.col("tokens").isNotNull(), F.lit("")))
    packed = cut(pack(priced, budget).drop("content", "tokens"))
    return _with_payload(packed, versions)
