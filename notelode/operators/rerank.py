"""Reordering short candidate lists by ids that a model returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import render_prompt
from ..functions.text import json_ids, utf16_prefix
from ..models import ModelClient, ask
from .lineage import cut

PREVIEW_CHARS = 800


def reorder(rows: Column, ids: Column) -> Column:
    """``rows`` (structs with ``chunk_id``) in the order of ``ids``; the others follow.

    Unknown ids are ignored and an id given twice yields its row twice.
    """
    def by_id(wanted: Column) -> Column:
        return F.get(F.filter(rows, lambda row: row["chunk_id"] == wanted), F.lit(0))

    named = F.filter(F.transform(ids, by_id), lambda row: row.isNotNull())
    others = F.filter(rows, lambda row: ~F.array_contains(ids, row["chunk_id"]))
    return F.concat(named, others)


def preview(row: Column) -> Column:
    return F.concat(
        F.lit("ID: "), row["chunk_id"],
        F.lit("\nHeading: "), F.array_join(row["heading_path"], " > "),
        F.lit("\nContent:\n"), utf16_prefix(row["content"], PREVIEW_CHARS),
    )


def rerank(
    ranked: DataFrame, questions: DataFrame, template: str, client: ModelClient, model: str = ""
) -> DataFrame:
    """Ask a model for the order of each question's final list.

    ``ranked`` holds at most the configured top-n rows per question, so a question's list is one
    row while the model is called, once. Lists of one row, unusable responses and failed calls leave
    the order as it is.
    """
    payload = [c for c in ranked.columns if c not in ("query_id", "rank")]
    lists = ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *payload))).alias("rows")
    )
    asked = cut(lists.join(questions.select("query_id", "question"), "query_id"))
    prompt = render_prompt(
        template,
        {"question": F.col("question"), "chunks": F.array_join(F.transform("rows", preview), "\n\n")},
    )
    prompt = F.when(F.size("rows") > 1, prompt)
    options = {"temperature": 0, "max_tokens": 256}
    replies = cut(ask(asked.withColumn("_p", prompt), F.col("_p"), client, model, options).select("query_id", "reply"))
    answered = asked.join(replies, "query_id").withColumn("ids", json_ids(F.coalesce("reply", F.lit(""))))
    return answered.select(
        "query_id", F.posexplode(reorder(F.col("rows"), F.col("ids"))).alias("_at", "row")
    ).select("query_id", *(f"row.{c}" for c in payload), (F.col("_at") + 1).alias("rank"))
