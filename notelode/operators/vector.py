"""Exact vector scoring: every chunk against every question vector, top-k per question.

Small question sets travel to the executors with the task and each partition keeps only its
own top-k, so a scan emits ``partitions * questions * k`` rows and the chunk table is never
shuffled. Of larger sets both sides are packed into blocks of bounded bytes that are settled in the
shared folder; executors read every pair of blocks, and no vector reaches the driver. Both ways are
exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .lineage import cut
from .sizing import MAX_BROADCAST_QUERIES, small_rows, tiles, top_k

# Scores are compared at this many decimals, so that the order in which a product is summed
# cannot reorder equal vectors.
SCORE_DECIMALS = 12
CELLS_PER_STEP = 2_000_000
# Rows of a step until every question has ``k`` hits.
FIRST_ROWS = 1024
# Blocks of a large question set: bytes of one, rows of one on the chunks' side, tiles of a task.
BLOCK_BYTES = 4 << 20
CHUNKS_PER_BLOCK = 8192
TILES_PER_TASK = 2
# Slices of the chunks that a tile meets: each hands on its own best ``k`` per question, so the hits
# grow with the questions alone and not with the product of both sides.
CHUNK_SLICES = 4
# Scores that are no number rank behind all others and come out as NaN.
LOWEST = -float(np.finfo(float).max)
# Lengths between this and its reciprocal neither vanish nor overflow in a product.
TINY = 1e-150
# Most that a product of vectors of length 1 in half the digits is off, for each number and eight more; twice the bound.
HALF_ERROR = 2.0**-23
# The same for lengths and boosts that half the digits can hold.
HALF_RANGE = 1e15
# Scores in half the digits are looked at again one by one up to this share of a step.
CLOSE_SHARE = 64
HIT_SCHEMA = "query_id string, key string, score double"


def _lengths(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.value_lengths().fill_null(0), dtype=int)


def _numbers(vectors: pa.Array) -> np.ndarray:
    """The numbers of all vectors one behind the other, nulls read as 0."""
    return np.asarray(pc.fill_null(vectors.flatten(), 0.0), dtype=float)


class _Questions:
    """Question vectors of one tile, grouped by length."""

    def __init__(self, ids: list[str], vectors: list | pa.Array, skip: list[str | None]):
        self.ids = np.array(ids, dtype=object)
        self.own = np.array(skip, dtype=object)
        self.skip: dict[str, list[int]] = {}
        for number, key in enumerate(skip):
            if key is not None:
                self.skip.setdefault(key, []).append(number)
        if not isinstance(vectors, pa.Array):
            vectors = pa.array(vectors, pa.list_(pa.float64()))
        lengths, flat = _lengths(vectors), _numbers(vectors)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.blocks = [
            (members, flat[starts[members][:, None] + np.arange(n)])
            for n in np.unique(lengths)
            for members in [np.flatnonzero(lengths == n)]
        ]
        self._halves: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray] | None] = {}

    @staticmethod
    def _scaled(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Vectors as they are multiplied, and their lengths; None where half the digits do not hold them."""
        norms = np.sqrt((vectors * vectors).sum(1))
        if not ((norms == 0) | ((norms > 1 / HALF_RANGE) & (norms < HALF_RANGE))).all():
            return None
        if metric != "cosine":
            return vectors, norms
        return vectors / np.where(norms == 0, 1.0, norms)[:, None], np.where(norms == 0, 0.0, 1.0)

    def near(self, chunk_vectors: pa.Array, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The same products in half the digits, how far a question's may be off, and what is multiplied for them.

        None where vectors differ in length, other than those that are empty, or hold numbers that are too large or too small for it.
        """
        lengths = _lengths(chunk_vectors)
        each = self.blocks[0][1].shape[1] if len(self.blocks) == 1 else 0
        if each == 0 or not ((lengths == each) | (lengths == 0)).all():
            return None
        if metric not in self._halves:
            scaled = self._scaled(self.blocks[0][1], metric)
            self._halves[metric] = scaled and (*scaled, scaled[0].astype(np.float32))
        vectors = np.zeros((len(lengths), each))  # without a vector all products are 0
        vectors[lengths > 0] = _numbers(chunk_vectors).reshape(-1, each)
        right, left = self._halves[metric], self._scaled(vectors, metric)
        if right is None or left is None:
            return None
        off = HALF_ERROR * (each + 8) * (left[1].max(initial=0) * right[1] + 1 / HALF_RANGE)
        return left[0].astype(np.float32) @ right[2].T, off, left[0], right[0]

    def scores(self, chunk_vectors: pa.Array, metric: str) -> np.ndarray:
        """Dot products or cosines over the shared length, shape ``chunks x questions``."""
        lengths, flat = _lengths(chunk_vectors), _numbers(chunk_vectors)
        found = np.unique(lengths)
        if len(found) == len(self.blocks) == 1:  # the usual case: nothing is put together
            return self._block(flat.reshape(len(lengths), found[0]), self.blocks[0][1], metric)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        out = np.zeros((len(lengths), len(self.ids)))
        for n in found[found > 0]:
            rows = np.flatnonzero(lengths == n)
            left = flat[starts[rows][:, None] + np.arange(n)]
            for members, matrix in self.blocks:
                where = rows if len(self.blocks) == 1 else np.ix_(rows, members)
                out[where] = self._block(left, matrix, metric)
        return out

    @staticmethod
    def _block(left: np.ndarray, matrix: np.ndarray, metric: str) -> np.ndarray:
        shared = min(left.shape[1], matrix.shape[1])
        a, b = left[:, :shared], matrix[:, :shared]
        if metric != "cosine":
            return a @ b.T
        norms = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        if all(((n == 0) | ((n > TINY) & (n < 1 / TINY))).all() for n in norms):
            # Rows are scaled instead of all their products; a vector without length stays zero.
            a, b = (m / np.where(n == 0, 1.0, n)[:, None] for m, n in zip((a, b), norms))
            return a @ b.T
        scale, block = np.outer(*norms), a @ b.T
        return np.divide(block, scale, out=np.zeros_like(block), where=scale != 0)


def _worth(batch: pa.RecordBatch, k: int, per_key_max: bool) -> pa.RecordBatch:
    """The rows ``key, embedding, boost`` to score, by key where the best of a key counts.

    Rows without a vector score their boost, whatever the question: only the best of a key
    or the first ``k`` of them can be hits. A key that is null is no file.
    """
    bare = _lengths(batch.column(1)) == 0
    if not per_key_max and bare.sum() <= k:
        return batch
    boost = np.round(np.asarray(batch.column(2), dtype=float), SCORE_DECIMALS)
    rows = pd.DataFrame({"key": batch.column(0).to_numpy(zero_copy_only=False), "boost": boost})
    rows.loc[rows["boost"].isna() | (rows["boost"] == -np.inf), "boost"] = LOWEST
    best = rows[bare].sort_values(["boost", "key"], ascending=[False, True], kind="stable")
    best = best.drop_duplicates("key") if per_key_max else best.head(k)
    kept = np.union1d(np.flatnonzero(~bare), best.index.to_numpy(dtype=int))
    if per_key_max:
        codes = pd.factorize(rows["key"].to_numpy()[kept])[0]
        order = np.argsort(codes, kind="stable")
        kept = kept[order[codes[order] >= 0]]
    return batch.take(pa.array(kept, pa.int64()))


class _Best:
    """Running top-k per question over the batches of one task."""

    def __init__(self, questions: _Questions, k: int, metric: str, per_key_max: bool):
        self.q, self.k, self.metric, self.per_key_max = questions, k, metric, per_key_max
        self.floor = np.full(len(questions.ids), -np.inf)
        self.ready = False  # every question has ``k`` hits that are numbers
        self.pool: list[pd.DataFrame] = []
        self.pooled = self.steps = 0

    def add(self, keys: pa.Array, vectors: pa.Array, boost: pa.Array) -> None:
        """Rows that went through ``_worth``."""
        most, at = max(1, CELLS_PER_STEP // max(1, len(self.q.ids))), 0
        if self.per_key_max and not self.ready and len(keys) > FIRST_ROWS:
            # Rows come by key: some of each are looked at first, and again in their turn, so that hits of ``k`` keys are known.
            names = keys.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            within = np.arange(len(names)) - np.repeat(starts, np.diff(np.append(starts, len(names))))
            some = pa.array(np.flatnonzero(within < max(1, FIRST_ROWS // len(starts)))[:FIRST_ROWS])
            self._add_step(keys.take(some), vectors.take(some), boost.take(some))
        while at < len(keys):
            end = at + (most if self.ready else min(most, FIRST_ROWS))
            self._add_step(keys[at:end], vectors[at:end], boost[at:end])
            at = end

    def _add_step(self, keys: pa.Array, vectors: pa.Array, boost: pa.Array) -> None:
        names = keys.to_numpy(zero_copy_only=False)
        boost = np.asarray(boost, dtype=float)
        found = self._close(names, vectors, boost) if self.ready else None
        key, col, values = found or self._all(names, vectors, boost)
        self.pool.append(pd.DataFrame({"q": col, "key": key, "score": values}))
        self.pooled += len(col)
        self.steps += 1
        early = not self.ready and self.steps & (self.steps - 1) == 0
        if early or self.pooled > 2 * self.k * len(self.q.ids) + 10_000:
            self._compact()

    def _close(self, names: np.ndarray, vectors: pa.Array, boost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Keys, questions and scores that reach the k-th hit, found in half the digits and scored in all of them.

        None where that does not hold or does not pay; then all scores are looked at.
        """
        near = self.q.near(vectors, self.metric) if (np.abs(boost) < HALF_RANGE).all() else None
        if near is None:
            return None
        products, off, left, right = near
        if boost.any():
            products += boost.astype(np.float32)[:, None]
            off = off + 2 * HALF_ERROR * np.abs(boost).max()
        least = self.floor - off - (np.abs(self.floor) + 10) * (10.0**-SCORE_DECIMALS + HALF_ERROR)
        close = np.greater_equal(products, least.astype(np.float32)).ravel()
        if CLOSE_SHARE * np.count_nonzero(close) > close.size:
            return None
        row, col = np.divmod(np.flatnonzero(close), len(self.q.ids))
        values = np.round(np.einsum("ij,ij->i", left[row], right[col]) + boost[row], SCORE_DECIMALS)
        kept = values >= self.floor[col]
        if self.per_key_max:
            kept &= names[row] != self.q.own[col]
        return names[row[kept]], col[kept], values[kept]

    def _all(self, names: np.ndarray, vectors: pa.Array, boost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same among all scores; before every question has its hits, the best ``k`` of the step."""
        scores = self.q.scores(vectors, self.metric)
        if boost.any():
            scores += boost[:, None]
        edges = None
        if self.per_key_max:  # rows come by key
            edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        if self.ready and (edges is None or 4 * len(edges) > len(names)):
            # Most rows fall short of the k-th hit: one look at each score is enough for them.
            row, col = np.nonzero(scores >= self.floor - (np.abs(self.floor) + 10) * 10.0**-SCORE_DECIMALS)
            values = np.round(scores[row, col], SCORE_DECIMALS)
            kept = values >= self.floor[col]
            if self.per_key_max:
                kept &= names[row] != self.q.own[col]
            row, col, values = row[kept], col[kept], values[kept]
        else:
            if edges is not None:
                names = names[edges]
                scores = np.fmax.reduceat(scores, edges, axis=0)
            scores = np.round(scores, SCORE_DECIMALS)
            scores[np.isnan(scores) | (scores == -np.inf)] = LOWEST
            if self.per_key_max:
                for number, name in enumerate(names):
                    if name in self.q.skip:
                        scores[number, self.q.skip[name]] = -np.inf
            cut = self.floor
            if len(scores) > self.k:
                nth = len(scores) - self.k
                cut = np.maximum(cut, np.partition(scores, nth, axis=0)[nth])
            row, col = np.nonzero((scores >= cut) & (scores > -np.inf))
            values = scores[row, col]
        return names[row], col, values

    def _compact(self) -> None:
        pool = pd.concat(self.pool) if self.pool else pd.DataFrame({"q": [], "key": [], "score": []})
        pool = pool.sort_values(["q", "score", "key"], ascending=[True, False, True])
        if self.per_key_max:
            pool = pool.drop_duplicates(["q", "key"])
        pool = pool.groupby("q", sort=False).head(self.k)
        full = pool.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.floor[full.index.to_numpy(dtype=int)] = full["min"].to_numpy()
        self.ready = bool(((self.floor > LOWEST) & (self.floor < np.inf)).all())
        self.pool, self.pooled = [pool], len(pool)

    def result(self) -> pa.RecordBatch:
        self._compact()
        pool = self.pool[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.q.ids[pool["q"].to_numpy(dtype=int)].tolist(), pa.string()),
                pa.array(pool["key"].tolist(), pa.string()),
                pa.array(pool["score"].to_numpy(dtype=float), pa.float64()),
            ],
            names=["query_id", "key", "score"],
        )


def _scan(chunks: DataFrame, rows: list, k: int, metric: str, per_key_max: bool) -> DataFrame:
    ids = [row["query_id"] for row in rows]
    vectors = [row["vector"] for row in rows]
    skip = [row["skip"] for row in rows]

    def score_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(_Questions(ids, vectors, skip), k, metric, per_key_max)
        for batch in batches:
            best.add(*_worth(batch, k, per_key_max).columns)
        yield best.result()

    return chunks.select("key", "embedding", "boost").mapInArrow(score_partition, HIT_SCHEMA)


def _blocks(
    rows: DataFrame, most: int, choose: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch
) -> DataFrame:
    """Chosen rows packed into arrays: at most ``most`` rows and about ``BLOCK_BYTES`` in one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(choose, batches):
            each = max(1, min(most, BLOCK_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, column) for column in part.columns], names=part.schema.names
                )

    packed = StructType([StructField(f.name, ArrayType(f.dataType)) for f in rows.schema.fields])
    return cut(rows.mapInArrow(pack, packed))


def _block_pairs(
    chunks: DataFrame, questions: DataFrame, k: int, metric: str, per_key_max: bool, per_tile: int
) -> DataFrame:
    """Every block of chunks against every tile of questions; a task keeps the best ``k`` of its tiles."""
    choose = partial(_worth, k=k, per_key_max=per_key_max)
    blocks = _blocks(chunks.select("key", "embedding", "boost"), CHUNKS_PER_BLOCK, choose)
    tiled = _blocks(questions.select("query_id", "vector", "skip"), per_tile).withColumn("tile", F.monotonically_increasing_id())
    held = cut(tiled)
    spread = tiles(held.count(), TILES_PER_TASK)
    pairs = blocks.coalesce(CHUNK_SLICES).crossJoin(held.coalesce(spread))

    def score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            columns = [batch.column(name) for name in ("tile", "query_id", "vector", "skip", "key", "embedding", "boost")]
            for tile, ids, vectors, skip, keys, embeddings, boost in zip(*columns):
                name = tile.as_py()
                if name not in best:
                    asked = _Questions(ids.as_py(), vectors.values, skip.as_py())
                    best[name] = _Best(asked, k, metric, per_key_max)
                best[name].add(keys.values, embeddings.values, boost.values)
        for one in best.values():
            yield one.result()

    return pairs.mapInArrow(score_pairs, HIT_SCHEMA)


def _score(
    chunks: DataFrame, questions: DataFrame, k: int, metric: str, per_key_max: bool, max_questions: int
) -> DataFrame:
    rows = small_rows(questions, F.size("vector") * 8 + 64, max_questions)
    if rows is not None:
        hits = _scan(chunks, rows, k, metric, per_key_max)
    else:
        hits = _block_pairs(chunks, questions, k, metric, per_key_max, max_questions)
    if per_key_max:
        hits = hits.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    # Pairs of blocks leave at most ``CHUNK_SLICES * k`` rows of a question.
    spread = "key" if rows is not None else None
    best = top_k(hits, ["query_id"], [F.desc("score"), F.asc("key")], k, spread=spread)
    return best.withColumn("score", F.when(F.col("score") == LOWEST, float("nan")).otherwise(F.col("score")))


def _question_columns(questions: DataFrame, skip: Column) -> DataFrame:
    return questions.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("vector").cast("array<double>").alias("vector"),
        skip.cast("string").alias("skip"),
    )


def vector_top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    boost: Column | None = None,
    max_questions: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Best ``k`` chunks per question by dot product plus ``boost``; ties go to the lower id.

    ``chunks`` has ``chunk_id, embedding`` and what ``boost`` reads; filter it beforehand, since
    filters apply before the cut on this side. ``questions`` has ``query_id, vector``.
    """
    source = chunks.select(
        "chunk_id",
        F.col("chunk_id").cast("string").alias("key"),
        "embedding",
        (F.lit(0.0) if boost is None else boost).cast("double").alias("boost"),
    )
    wanted = _question_columns(questions, F.lit(None))
    hits = _score(source, wanted, k, "dot", False, max_questions)
    return hits.withColumnRenamed("key", "chunk_id")


def related_files(
    chunks: DataFrame,
    notes: DataFrame,
    k: int,
    max_questions: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Best ``k`` other files per note by the cosine of their closest chunk.

    A file in the overall top ``k`` is also in the top ``k`` of the task that holds its closest
    chunk, so trimming per task loses nothing. ``notes`` has ``query_id, path, vector``.
    """
    source = chunks.select(
        "chunk_id",
        F.replace("file_path", F.lit("\\"), F.lit("/")).alias("key"),
        "embedding",
        F.lit(0.0).alias("boost"),
    )
    wanted = _question_columns(notes, F.replace("path", F.lit("\\"), F.lit("/")))
    hits = _score(source, wanted, k, "cosine", True, max_questions)
    return hits.withColumnRenamed("key", "path")
