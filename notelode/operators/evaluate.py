"""Recall and citation accuracy of answers against expected paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(retrieved: Column, expected: Column) -> Column:
    hits = F.filter(expected, lambda path: F.array_contains(retrieved, path))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(hits) / F.size(expected))


def citation_accuracy(cited: Column, expected: Column) -> Column:
    hits = F.filter(cited, lambda path: F.array_contains(expected, path))
    return (
        F.when(F.size(cited) == 0, F.lit(0.0))
        .when(F.size(expected) == 0, F.lit(1.0))
        .otherwise(F.size(hits) / F.size(cited))
    )


def score_cases(cases: DataFrame, top_k: int) -> DataFrame:
    """Per case ``recall`` over the first ``top_k`` paths and ``citation_accuracy`` over all.

    ``cases`` has ``query_id, paths, expected_paths``; paths are those of the packed chunks.
    """
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    expected = F.coalesce("expected_paths", F.array().cast("array<string>"))
    return cases.select(
        "query_id",
        recall(F.slice(paths, 1, top_k), expected).alias("recall"),
        citation_accuracy(paths, expected).alias("citation_accuracy"),
    )


def metrics(scored: DataFrame) -> DataFrame:
    """One row ``recall_at_k, citation_accuracy``; no cases give zeros."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return scored.agg(
        (F.coalesce(F.sum("recall"), F.lit(0.0)) / n).alias("recall_at_k"),
        (F.coalesce(F.sum("citation_accuracy"), F.lit(0.0)) / n).alias("citation_accuracy"),
    )
