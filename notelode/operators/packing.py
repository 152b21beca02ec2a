"""Greedy packing of ranked chunks into a token budget, with citation labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_pieces_or_zero
from .lineage import cut
from .sizing import top_k

SEPARATOR = "\n\n---\n\n"


def chunk_cost(tokens: Column, content: Column) -> Column:
    return F.when(F.coalesce(tokens, F.lit(0)) != 0, tokens).otherwise(
        count_pieces_or_zero(content)
    )


def _prune(ranked: DataFrame, budget: int) -> DataFrame:
    """Drop rows that cost something and cannot be admitted whatever the others are.

    A row of cost ``c`` is admitted only if ``c`` fits, and once it does not fit it never does
    again, so the admitted rows of one cost are its first ``budget / c`` at most. Only the very
    first row may exceed the budget. What is left per question is bounded by the budget.
    """
    head = top_k(ranked, ["query_id"], [F.asc("rank")], 1, spread="chunk_id", rank="_n")
    fits = ranked.where((F.col("cost") > 0) & (F.col("cost") <= budget))
    rest = top_k(fits, ["query_id", "cost"], [F.asc("rank")], max(1, budget), spread="chunk_id", rank="_n")
    rest = rest.where(F.col("_n") <= F.floor(F.lit(budget) / F.col("cost")) + 1)
    return head.unionByName(rest).drop("_n").dropDuplicates(["query_id", "rank"])


def pack(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows admitted to the context, in rank order, with ``label`` numbers from 1.

    ``ranked`` has ``query_id, chunk_id, rank, tokens, content`` and whatever else should come
    along; ranks differ within a question. Rows that do not fit are skipped and later, smaller
    ones may still be taken; the first row always is. Rows without cost always fit, unless the
    first row overdrew the budget; they are admitted without being folded. A chunk counts once.
    """
    once = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    cost = chunk_cost(F.col("tokens"), F.col("content")).cast("long")
    costed = cut(
        ranked.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), cost.alias("cost"))
        .withColumn("_seen", F.row_number().over(once))
        .where(F.col("_seen") == 1)
        .drop("_seen")
    )
    lists = _prune(costed, budget).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "cost"))).alias("rows")
    )

    def admit(acc: Column, row: Column) -> Column:
        taken = (F.size(acc["ranks"]) == 0) | (acc["left"] - row["cost"] >= 0)
        return F.when(
            taken,
            F.struct(
                (acc["left"] - row["cost"]).alias("left"),
                F.array_append(acc["ranks"], row["rank"]).alias("ranks"),
            ),
        ).otherwise(acc)

    start = F.struct(
        F.lit(budget).cast("long").alias("left"), F.array().cast("array<long>").alias("ranks")
    )
    folded = lists.select(
        "query_id", F.get("rows", F.lit(0))["cost"].alias("first"),
        F.aggregate("rows", start, admit, lambda acc: acc["ranks"]).alias("ranks"),
    )
    priced = folded.select("query_id", F.explode("ranks").alias("rank"))
    free = costed.where(F.col("cost") == 0).join(
        folded.where(F.col("first") <= budget).select("query_id"), "query_id", "left_semi"
    )
    admitted = priced.unionByName(free.select("query_id", "rank")).distinct()
    in_order = Window.partitionBy("query_id").orderBy("rank")
    return ranked.join(
        costed.join(admitted, ["query_id", "rank"])
        .withColumn("label", F.row_number().over(in_order))
        .select("query_id", "chunk_id", F.col("rank").alias("_rank"), "label"),
        ["query_id", "chunk_id"],
    ).where(F.col("rank") == F.col("_rank")).drop("_rank")


def context_block(label: Column, path: Column, headings: Column, content: Column) -> Column:
    head = F.concat(F.lit("[C"), label.cast("string"), F.lit("] "), path, F.lit(" | "))
    return F.concat(head, F.array_join(headings, " > "), F.lit("\n"), content)


def citation_line(label: Column, path: Column, headings: Column) -> Column:
    head = F.concat(F.lit("[C"), label.cast("string"), F.lit("] "), path, F.lit(" | "))
    return F.concat(head, F.array_join(headings, " > "))


def join_in_order(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts of a bounded group joined in ``order``."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("at"), text.alias("text"))))
    return F.array_join(F.transform(pairs, lambda pair: pair["text"]), separator)


def contexts(packed: DataFrame) -> DataFrame:
    """Per question the context text, the citation lines, and labels by chunk id."""
    label, path, headings = F.col("label"), F.col("file_path"), F.col("heading_path")
    entry = F.struct("label", "chunk_id", "file_path")
    return packed.groupBy("query_id").agg(
        join_in_order(label, context_block(label, path, headings, F.col("content")), SEPARATOR).alias(
            "context"
        ),
        join_in_order(label, citation_line(label, path, headings), "\n").alias("citation_lines"),
        F.map_from_entries(
            F.transform(
                F.sort_array(F.collect_list(entry)),
                lambda e: F.struct(e["chunk_id"], F.concat(F.lit("C"), e["label"].cast("string"))),
            )
        ).alias("citations"),
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["file_path"]).alias("paths"),
    )
