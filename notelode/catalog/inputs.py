"""Inputs of the registered queries, derived by Spark from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markers import BLOCK_END, BLOCK_START
from ..operators.lineage import settled, shared_folder
from ..operators.sizing import top_k

NOW_MS = 1_735_689_600_000
EPOCH = 1_700_000_000
HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def doc_mtime(key: str = "doc_id") -> Column:
    return F.lit(EPOCH) + F.col(key) * HOUR


def plain_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes without Markdown structure, one folder per source."""
    return table(spark, sf_dir, "documents").select(
        doc_path().alias("file_path"), doc_mtime().alias("mtime"), F.col("text").alias("markdown")
    )


def rich_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as structured notes whose make-up depends on their label.

    Unlabelled notes have a titled frontmatter, those of quality 0 an untitled one with a
    summary, those of quality 1 none; toxic ones carry a generated block.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    ident, lang, source = F.col("doc_id").cast("string"), F.col("lang"), F.col("source")
    front = (
        F.when(
            F.col("quality").isNull(),
            F.concat(
                F.lit("---\ntitle: Note "), ident, F.lit("\ntags:\n  - #"), lang, F.lit("\n  - "),
                source, F.lit("\n---\n"),
            ),
        )
        .when(
            F.col("quality") == 0,
            F.concat(F.lit("---\nsummary: Short\ntags: "), lang, F.lit(", #"), source, F.lit("\n---\n")),
        )
        .otherwise(F.lit(""))
    )
    block = F.when(
        F.coalesce("toxic", F.lit(0)) == 1,
        F.concat(
            F.lit(f"\n\n{BLOCK_START}\nAI Summary\n\nold "), ident, F.lit(f"\n{BLOCK_END}")
        ),
    ).otherwise(F.lit(""))
    body = F.concat(
        F.lit("# "), source, F.lit("\n"), F.col("text"), block, F.lit("\n\n## Links\n\n- [["), source,
        F.lit("]]\n- see [["), lang, F.lit("/index|home]]\n\n```sql\nselect "), ident,
        F.lit("\n\nfrom t\n```\n"),
    )
    return docs.join(labels, "doc_id", "left").select(
        doc_path().alias("file_path"), doc_mtime().alias("mtime"),
        F.concat(front, body).alias("markdown"),
    )


# One line of every class that structured notes may hold; ``{}`` takes a word of the note.
GRAMMAR_LINES = (
    "### {}", "#### Deep {}", "##### {} five", "###### {}", "#no heading {}", "####### seven", "# Windows {}\r", "> quoted {}",
    "> [!NOTE] {}", "> [!tip]- {}", ">[!X]", "| {} | b |", "|---|---|", "| --- | --- |", "  | {} |", "***", "- - -", "___",
    "* * x", "~~~", "code {}", "~~~", "```js", "  ```", "\t~~~", "1. {}", "  - {}", "+ {}", "    - {}", "-{}", "\u00a0", "\r", "{}",
)


def grammar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents followed by lines of every class, each with the document's language in it."""
    lines = [F.replace(F.lit(line), F.lit("{}"), F.col("lang")) for line in GRAMMAR_LINES]
    return table(spark, sf_dir, "documents").select(
        doc_path().alias("file_path"), doc_mtime().alias("mtime"), F.concat_ws("\n", "text", *lines).alias("markdown")
    )


def turn_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as journal entries, one folder per conversation.

    Assistant turns are earlier generated blocks, the others user text.
    """
    text = F.when(
        F.col("role") == "assistant",
        F.concat(F.lit(BLOCK_START + "\n"), F.col("text"), F.lit("\n" + BLOCK_END)),
    ).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit("conv"), F.col("conv_id").cast("string"), F.lit("/turn"),
            F.col("turn").cast("string"), F.lit(".md"),
        ).alias("file_path"),
        (F.lit(NOW_MS) - F.col("turn") * 86_400_000 * 7 - F.col("conv_id")).alias("mtime_ms"),
        text.alias("markdown"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("embedding").cast("array<double>").alias("embedding"), "label",
        doc_mtime("vec_id").alias("mtime"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed chunks: every document, with its source as file; some have no vector."""
    docs = table(spark, sf_dir, "documents")
    known = vectors(spark, sf_dir).select("doc_id", "embedding", "label")
    none = F.array().cast("array<double>")
    return docs.join(known, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", none)).select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.col("source"), F.lit(".md")).alias("file_path"),
        F.array("source", "lang").alias("heading_path"), F.col("text").alias("content"),
        T.count_tokens(F.col("text")).alias("tokens"), F.lit("text").alias("chunk_type"),
        F.array("lang").alias("tags"), doc_mtime().alias("mtime"), "embedding", "label", "source", "lang", "doc_id",
    )


def stored_corpus(spark: SparkSession, sf_dir: str, counted: bool = False) -> DataFrame:
    """The same as a table, as an index stores it: texts meet their vectors once, whoever reads them afterwards.

    Tokens are counted by the readers that ask for them, or once for all rows if ``counted``.
    """
    whole, folder = corpus(spark, sf_dir), shared_folder(spark, "corpus")
    if counted:
        return settled(whole, folder)
    return settled(whole.drop("tokens"), folder).withColumn("tokens", T.count_tokens(F.col("content")))


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"),
        F.concat(F.col("source"), F.lit(".md")).alias("file_path"),
        F.array("lang").alias("tags"), F.lit("text").alias("chunk_type"), "source",
    )


def centroids(chunks: DataFrame, key: str) -> DataFrame:
    """Mean vector per key; partial sums leave each task before the shuffle."""
    each = chunks.select(key, F.posexplode("embedding").alias("at", "x"))
    means = each.groupBy(key, "at").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias("vector"))


def label_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = centroids(vectors(spark, sf_dir), "label")
    return mean.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("query_id"), "vector")


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions, each with the embedding of the same number, if there is one."""
    items = table(spark, sf_dir, "benchmark")
    known = vectors(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("vector"))
    vector = F.coalesce("vector", F.array().cast("array<double>"))
    return items.join(known, "item_id", "left").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"), vector.alias("vector")
    )


def phrase_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent pair of neighbouring long ASCII words per source, as a phrase."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("source", T.index_tokens(F.col("text")).alias("w"))
    last = F.size("w") - 1
    pairs = tokens.where(last > 0).select(
        "source", F.explode(F.arrays_zip(F.slice("w", F.lit(1), last).alias("a"), F.slice("w", F.lit(2), last).alias("b"))).alias("p")
    )
    long_word = "^[a-z0-9]{4,}$"
    counts = (
        pairs.where(F.col("p.a").rlike(long_word) & F.col("p.b").rlike(long_word))
        .groupBy("source", F.concat_ws("_", "p.a", "p.b").alias("pair"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("source").agg(F.min_by("pair", F.struct(-F.col("n"), F.col("pair"))).alias("question"))
    return best.select(F.col("source").alias("query_id"), "question")


def word_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the two long ASCII terms found in most of its documents."""
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("source", F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("t"))
    counts = terms.where(F.col("t").rlike("^[a-z0-9]{5,}$")).groupBy("source", "t").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = top_k(counts, ["source"], [F.desc("n"), F.asc("t")], 2, spread="t")
    return best.groupBy(F.col("source").alias("query_id")).agg(
        F.array_join(F.sort_array(F.collect_list("t")), " ").alias("question")
    )



def source_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its word question with the mean vector of its chunks."""
    mean = centroids(corpus(spark, sf_dir), "source")
    return word_questions(spark, sf_dir).join(
        mean.withColumnRenamed("source", "query_id"), "query_id"
    )
