"""Answering questions: retrieve, widen by rewrites and follow-ups, pack, generate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.prompts import render_prompt
from ..functions.text import bullet_lines, json_array_or_lines
from ..models import ModelClient, ask, embed_questions
from ..operators.evaluate import metrics, score_cases
from ..operators.filters import Filters
from ..operators.fusion import merge_waves
from ..operators.lineage import cut
from ..operators.packing import contexts, pack
from .retrieve import PAYLOAD, retrieve


def _variants(questions: DataFrame, texts: Column, name: str) -> DataFrame:
    """One row per extra question text, with ``root`` and its ``wave`` number."""
    return questions.select(
        F.col("query_id").alias("root"), F.posexplode(texts).alias("_at", "question")
    ).select(
        F.concat_ws("#", "root", F.lit(name), F.col("_at").cast("string")).alias("query_id"),
        "root", (F.col("_at") + 1).alias("wave"), "question",
    )


def _merge(base: DataFrame, waves: DataFrame, found: DataFrame) -> DataFrame:
    """``base`` results widened by the results ``found`` for the extra questions in ``waves``."""
    extra = found.join(waves.select("query_id", "root", "wave"), "query_id")
    lists = base.withColumn("wave", F.lit(0)).unionByName(
        extra.drop("query_id").withColumnRenamed("root", "query_id")
    )
    payload = lists.select("query_id", "chunk_id", *PAYLOAD).dropDuplicates(["query_id", "chunk_id"])
    return cut(merge_waves(lists).join(payload, ["query_id", "chunk_id"]))


def answer(
    chunks: DataFrame,
    questions: DataFrame,
    client: ModelClient,
    config: Config | None = None,
    now_ms: int = 0,
    filters: Filters | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """``query_id, question, answer, context, citations, paths, error`` for ``query_id, question`` rows.

    A model call that fails costs its own question the rewrites, follow-ups or the answer, whose
    ``error`` says why.

    The original questions and all rewrites are one retrieval; follow-ups, which depend on the
    packed context, are a second one. Any merge re-sorts by fused score.
    """
    config = config or Config()
    models, prompts = config.models, config.prompts
    budget = config.retrieval.context_token_budget

    def found_for(wanted: DataFrame) -> DataFrame:
        embedded = embed_questions(
            wanted, client, models.embedding_model, models.embedding_batch_size
        )
        return cut(retrieve(chunks, embedded, config, now_ms, filters, client, index))

    questions = cut(questions.select(F.col("query_id").cast("string").alias("query_id"), "question"))
    if config.features.query_rewriting:
        prompt = render_prompt(prompts.query_rewrite, {"question": F.col("question")})
        options = {"temperature": 0.2, "max_tokens": 256}
        asked = cut(ask(questions, prompt, client, models.query_rewrite_model, options))
        rewrites = cut(_variants(asked, json_array_or_lines(F.col("reply")), "rewrite"))
        results = found_for(
            questions.unionByName(rewrites.select("query_id", "question"))
        )
        base = results.join(questions.select("query_id"), "query_id", "left_semi")
        results = _merge(base, rewrites, results)
    else:
        results = found_for(questions)

    if config.features.iterative_retrieval:
        packed = contexts(pack(results, budget))
        prompt = render_prompt(
            prompts.iterative_gap, {"question": F.col("question"), "context": F.col("context")}
        )
        options = {"temperature": 0.1, "max_tokens": 256}
        asked = cut(ask(questions.join(packed, "query_id", "left"), prompt, client, models.llm_model, options))
        follow_ups = cut(_variants(asked, bullet_lines(F.col("reply")), "follow-up"))
        found = found_for(follow_ups.select("query_id", "question"))
        results = _merge(results, follow_ups, found)

    packed = contexts(pack(results, budget))
    full_context = F.concat(
        F.coalesce("context", F.lit("")), F.lit("\n\nCitations:\n"),
        F.coalesce("citation_lines", F.lit("")),
    )
    prompt = render_prompt(prompts.qa, {"question": F.col("question"), "context": full_context})
    options = {"temperature": models.temperature, "max_tokens": models.max_tokens}
    answered = ask(questions.join(packed, "query_id", "left"), prompt, client, models.llm_model, options)
    return answered.select(
        "query_id", "question", F.col("reply").alias("answer"), "context", "citations", "paths",
        F.col("reply_error").alias("error"),
    )


def evaluate(
    chunks: DataFrame,
    cases: DataFrame,
    client: ModelClient,
    config: Config | None = None,
    now_ms: int = 0,
) -> DataFrame:
    """One row of metrics for ``query_id, question, expected_paths`` cases."""
    config = config or Config()
    answers = answer(chunks, cases, client, config, now_ms)
    joined = cases.select("query_id", "expected_paths").join(
        answers.select("query_id", "paths"), "query_id"
    )
    return metrics(score_cases(joined, config.retrieval.rerank_top_n))
