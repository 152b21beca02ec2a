"""The training-data pipeline: stages over ``documents``, each one written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``documents``; the last one adds the ids of the text's pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelode.llm import decontaminate, near_dup, pieces, pii, toxicity
from notelode.llm.tables import measured, table
from notelode.llm.warc import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Ids of rejected documents are broadcast up to this number (8 bytes each), joined beyond it.
MAX_BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose doc_id is not rejected; rows with a null doc_id stay."""
    ids = measured(rejected.select("doc_id").distinct(), MAX_BROADCAST_IDS)
    return docs.join(ids, "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels come from the labels table."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model, *COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return _without(docs, near_dup.near_duplicates(docs, words=5, percent=80).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and ``n_chars`` counted anew."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``ids`` of every text's pieces, and the text as they decode to."""
    return pieces.encode(docs, pieces.model_path(), decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

# Trained weights, signatures and alignments decide the rows; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Results of stages go to the shared folder and are read again."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    folder = shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
