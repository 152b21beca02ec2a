"""Exact vector top-k that reads only clusters which can reach the k-th score.

Chunk vectors are stored by the nearest of a few centres, with each cluster's radius and size. A dot
product with any vector of a cluster is at most that with its centre plus the question's length times
the radius (Cauchy-Schwarz). A first look scores the clusters with the highest bounds; the k-th
score found there rules out clusters, whose files are then not opened. Centres are fitted on a
bounded sample and decide only how much is read, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .sizing import MAX_BROADCAST_QUERIES, small_rows
from .vector import vector_top_k

SAMPLE = 8192
ROUNDS = 8
# A first look takes clusters with this many vectors for each hit wanted.
FIRST_LOOK = 4
SLACK = 1e-9
# Vectors that are null, of another length or hold no number: always read.
ODD = -1


def centres_of(vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` centres by Lloyd's rounds; the first ones are rows far from each other."""
    if not len(vectors):
        return np.zeros((0, 0))
    centres = [vectors[0]]
    far = ((vectors - centres[0]) ** 2).sum(1)
    while len(centres) < most and far.max() > 0:
        centres.append(vectors[int(far.argmax())])
        far = np.minimum(far, ((vectors - centres[-1]) ** 2).sum(1))
    out = np.array(centres)
    for _ in range(ROUNDS):
        near = nearest(vectors, out)[0]
        sums = np.zeros_like(out)
        np.add.at(sums, near, vectors)
        n = np.bincount(near, minlength=len(out))
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centre and the distance to it."""
    near = ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)
    return near, np.sqrt(((vectors - centres[near]) ** 2).sum(1))


def _usable(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``length`` finite numbers, and those vectors."""
    rows = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == length)
    vectors = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), length)
    fine = np.isfinite(vectors).all(1)
    return rows[fine], vectors[fine]


def write(chunks: DataFrame, folder: str, most: int = 256, sample: int = SAMPLE) -> None:
    """Store ``chunks`` (chunk_id, embedding and further columns) by cluster, and the clusters' bounds.

    At most ``sample`` vectors, chosen by a hash of their id, are fetched to fit up to ``most`` centres.
    """
    spark = chunks.sparkSession
    chosen = chunks.where(F.size("embedding") > 0).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = chosen.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()
    column = chosen["embedding"].combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    length = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    centres = centres_of(_usable(column, length)[1], most) if length else np.zeros((0, 0))
    shipped = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, far = np.full(batch.num_rows, ODD, np.int32), np.full(batch.num_rows, np.nan)
            if len(shipped.value):
                rows, vectors = _usable(batch.column("_vector"), shipped.value.shape[1])
                cluster[rows], far[rows] = nearest(vectors, shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cluster), pa.array(far)], names=["_row", "cluster", "far"])

    rows = chunks.drop("cluster", "far").select(F.struct("*").alias("_row"), F.col("embedding").cast("array<double>").alias("_vector"))
    schema = StructType([rows.schema["_row"], StructField("cluster", IntegerType()), StructField("far", DoubleType())])
    placed = rows.mapInArrow(assign, schema).select("_row.*", "cluster", "far")
    # The columns of an empty table are kept, too.
    placed.drop("cluster").limit(0).write.mode("overwrite").parquet(f"{folder}/columns")
    placed.repartition("cluster", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.mode("overwrite").partitionBy("cluster").parquet(f"{folder}/chunks")
    stored = spark.read.schema("far double, cluster int").parquet(f"{folder}/chunks")
    sizes = stored.groupBy("cluster").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    sizes.join(known, "cluster", "left").coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds")


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    columns = spark.read.parquet(f"{folder}/columns").schema
    return spark.read.schema(StructType([*columns.fields, StructField("cluster", IntegerType())])).parquet(f"{folder}/chunks")


class Pruned:
    """A question set against the stored bounds: which clusters have to be read."""

    def __init__(self, spark: SparkSession, folder: str, questions: list, k: int, boost: Column | None):
        self.k = k
        self.questions = spark.createDataFrame(
            [(r["query_id"], r["vector"]) for r in questions], "query_id string, vector array<double>"
        )
        self.chunks = stored_chunks(spark, folder)
        self.boost = boost
        bounds = spark.read.parquet(f"{folder}/bounds").orderBy("cluster").collect()  # a row for each cluster
        added = dict.fromkeys((r["cluster"] for r in bounds), 0.0)
        if boost is not None:
            added = {r["cluster"]: r["most"] for r in self.chunks.groupBy("cluster").agg(F.max(boost).alias("most")).collect()}
        self.clusters = np.array([r["cluster"] for r in bounds], int)
        self.n = np.array([r["n"] for r in bounds], int)
        self.ids = [r["query_id"] for r in questions]
        self.most = np.full((len(questions), len(bounds)), np.inf)
        for j, row in enumerate(bounds):
            if row["centre"] is None:
                continue
            centre = np.array(row["centre"])
            for i, asked in enumerate(questions):
                vector = np.array([0.0 if x is None else x for x in asked["vector"] or []])
                if len(vector) == len(centre) and np.isfinite(vector).all():
                    reach = vector @ centre + np.sqrt(vector @ vector) * row["radius"]
                    self.most[i, j] = reach + (added[row["cluster"]] or 0.0) + SLACK * (1 + abs(reach))

    def read(self, chosen: np.ndarray) -> DataFrame:
        """Best ``k`` of each question among the clusters ``chosen`` (a flag for each)."""
        rows = self.chunks.where(F.col("cluster").isin(self.clusters[chosen].tolist()))
        return vector_top_k(rows, self.questions, self.k, self.boost)

    def first_look(self) -> np.ndarray:
        chosen = np.zeros(len(self.clusters), bool)
        for bound in self.most:
            order = np.argsort(-bound, kind="stable")
            before = np.cumsum(self.n[order]) - self.n[order]
            chosen[order[before < FIRST_LOOK * self.k]] = True
        return chosen

    def needed(self) -> np.ndarray:
        """Clusters that can hold one of some question's best ``k``."""
        seen = self.read(self.first_look()).where(F.col("rank") == self.k).collect()  # a row for each question at most
        bar = {r["query_id"]: r["score"] for r in seen}
        bars = np.array([bar.get(i, -np.inf) for i in self.ids])
        bars[np.isnan(bars)] = -np.inf
        return (self.most >= bars[:, None]).any(axis=0)


def top_k_pruned(
    spark: SparkSession, folder: str, questions: DataFrame, k: int, boost: Column | None = None,
    max_questions: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """``vector_top_k`` over what ``write`` stored; question sets beyond the bounds read all clusters."""
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = small_rows(asked, F.size("vector") * 8 + 64, max_questions)
    if rows is None:
        return vector_top_k(stored_chunks(spark, folder), asked, k, boost, max_questions)
    search = Pruned(spark, folder, rows, k, boost)
    return search.read(search.needed())
