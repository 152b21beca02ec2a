"""Checked sizes for broadcasts, salted joins and salted top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .lineage import cut

# A question set is shipped to the executors only up to these sizes.
MAX_BROADCAST_QUERIES = 2048
MAX_BROADCAST_BYTES = 32 << 20
# Keys of a change, or paths asked for, are broadcast up to this number and so many bytes.
MAX_BROADCAST_KEYS = 200_000
MAX_BROADCAST_KEY_BYTES = 16 << 20
SALTS = 32
# Join keys with more rows than this are split; there can be at most rows / HOT_ROWS of them.
HOT_ROWS = 100_000


def small_rows(df: DataFrame, size_of: Column, max_rows: int = MAX_BROADCAST_QUERIES) -> list[Row] | None:
    """Rows of ``df`` when their number and summed ``size_of`` bytes are within bounds, else None.

    The size is measured by an aggregate first, so nothing unbounded reaches the driver.
    """
    kept = df.persist()
    try:
        measured = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(size_of).alias("bytes")).first()
        if measured["n"] > max_rows or (measured["bytes"] or 0) > MAX_BROADCAST_BYTES:
            return None
        return kept.collect()
    finally:
        kept.unpersist()


def is_few(keys: DataFrame, key: str) -> bool:
    """Whether ``keys`` are measured to be small enough for a broadcast."""
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(key)).alias("bytes")).first()
    return size["n"] <= MAX_BROADCAST_KEYS and (size["bytes"] or 0) <= MAX_BROADCAST_KEY_BYTES


def few(keys: DataFrame, key: str) -> DataFrame:
    """``keys``, to be broadcast if it is measured to be small; it is read twice."""
    return F.broadcast(keys) if is_few(keys, key) else keys


def salt_of(key: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: str | None,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows per group with their rank, exact under skew.

    One group may hold most of the rows, so a first pass ranks inside ``salts`` slices of each
    group and the second pass only ever sees ``salts * k`` rows per group. Spark's group limit
    already trims both passes on the map side. ``order`` has to be a total order. Where groups are
    known to be bounded, ``spread`` is None and the first pass is left out.
    """
    sliced = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    if spread is not None:
        df = df.withColumn("_salt", salt_of(F.col(spread))).withColumn("_local", F.row_number().over(sliced))
        df = df.where(F.col("_local") <= k).drop("_local", "_salt")
    return (
        df.withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
    )


def salted_join(
    large: DataFrame, small: DataFrame, on: Sequence[str], spread: str, salts: int = SALTS
) -> DataFrame:
    """Inner join whose hot keys on the ``large`` side are split over ``salts`` slices."""
    left = large.withColumn("_salt", salt_of(F.col(spread), salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def hot_join(
    large: DataFrame, small: DataFrame, on: Sequence[str], spread: str, salts: int = SALTS
) -> DataFrame:
    """Inner join that splits only keys with more than ``HOT_ROWS`` rows on the ``large`` side.

    Unlike ``salted_join`` it copies ``small`` rows of hot keys alone, at the price of counting the
    keys of ``large`` first. The counts are joined as a table, however many keys are hot.
    """
    counts = large.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    hot = cut(counts.select(*on, F.lit(True).alias("_hot")))
    slices = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    left = large.join(hot, list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt_of(F.col(spread), salts)).otherwise(F.lit(0))
    )
    right = small.join(hot, list(on), "left").withColumn("_salt", F.explode(slices)).drop("_hot")
    return left.drop("_hot").join(right, [*on, "_salt"]).drop("_salt")


def tiles(rows: int, per_tile: int) -> int:
    return max(1, math.ceil(rows / per_tile))
