"""Rank fusion, the per-file cap and merging of result lists."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_FILE = 2


def fuse(
    vector: DataFrame, lexical: DataFrame, vector_weight: float = 0.7, lexical_weight: float = 0.3
) -> DataFrame:
    """Weighted reciprocal ranks of two lists, ``weight / rank`` with ranks from 1.

    Scores of the inputs are ignored. Equal sums keep the vector order first, then the
    lexical order. Both lists hold at most their top-k rows per question.
    """
    left = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    right = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    score = F.coalesce(F.lit(float(vector_weight)) / F.col("vector_rank"), F.lit(0.0)) + F.coalesce(
        F.lit(float(lexical_weight)) / F.col("lexical_rank"), F.lit(0.0)
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("lexical_rank")
    )
    return (
        left.join(right, ["query_id", "chunk_id"], "full_outer")
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
    )


def cap_per_file(ranked: DataFrame, limit: int = PER_FILE) -> DataFrame:
    """At most ``limit`` rows per question and file in rank order, ranked anew."""
    per_file = Window.partitionBy("query_id", "file_path").orderBy("rank")
    whole = Window.partitionBy("query_id").orderBy("rank")
    return (
        ranked.withColumn("_nth", F.row_number().over(per_file))
        .where(F.col("_nth") <= limit)
        .drop("_nth")
        .withColumn("rank", F.row_number().over(whole))
    )


def merge_results(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Union of two ranked lists with the best score per chunk, sorted anew by score.

    Equal scores keep the order of first appearance, ``base`` before ``extra``.
    """
    columns = ["query_id", "chunk_id", "score"]
    both = base.select(*columns, F.struct(F.lit(0).alias("list"), "rank").alias("seen")).unionByName(
        extra.select(*columns, F.struct(F.lit(1).alias("list"), "rank").alias("seen"))
    )
    best = both.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.min("seen").alias("seen")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seen"))
    return best.withColumn("rank", F.row_number().over(order)).drop("seen")


def merge_waves(waves: DataFrame) -> DataFrame:
    """Fold the result lists of one question in wave order.

    ``waves`` has ``query_id, wave, chunk_id, score, rank``. Every merge sorts anew, so ties
    depend on the earlier sorts; the fold sees ``waves * top_n`` rows per question.
    """

    def fold(lists: pd.DataFrame) -> pd.DataFrame:
        merged: dict[str, float] = {}
        for wave, rows in lists.sort_values(["wave", "rank"]).groupby("wave"):
            for chunk_id, score in zip(rows["chunk_id"], rows["score"]):
                if chunk_id not in merged or score > merged[chunk_id]:
                    merged[chunk_id] = score
            if wave:
                merged = dict(sorted(merged.items(), key=lambda item: -item[1]))
        return pd.DataFrame(
            {
                "query_id": lists["query_id"].iloc[0],
                "chunk_id": list(merged),
                "score": list(merged.values()),
                "rank": range(1, len(merged) + 1),
            }
        )

    columns = waves.select("query_id", "wave", "chunk_id", "score", "rank")
    return columns.groupBy("query_id").applyInPandas(
        fold, "query_id string, chunk_id string, score double, rank int"
    )


def attach(ranked: DataFrame, chunks: DataFrame, columns: Iterable[str], small: bool) -> DataFrame:
    """Chunk columns for ranked ids; ids without a chunk are dropped.

    ``small`` tells that the number of questions was checked, which bounds ``ranked``: then the
    ranked side is broadcast and the chunk table is scanned without a shuffle.
    """
    side = F.broadcast(ranked) if small else ranked
    return chunks.select("chunk_id", *columns).join(side, "chunk_id")
