"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of single words, word pairs and pairs with one word left out; a
feature counts once for a text, so long texts are not judged by their length. Every feature of the
training texts has a coordinate of its own; none is counted or dropped beforehand. The training
rows are dealt to shards of about ``SHARD_ROWS``. A shard goes over its rows ``PASSES`` times with
its own per-coordinate rates, from the common state, and sends only what the L1 term left with a
weight other than zero, as a difference to that state. The differences of a coordinate are averaged over
the shards that send it. So what is sent and broadcast follows the learned weights, not the
features seen; the scoring pass reads every text once and moves none.

Training reads at most ``MAX_ROWS`` labelled rows, a parameter; that bounds a shard's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .tables import give_back, lean, table, texts
from .words import LETTERS, ngrams, slices, words

MAX_ROWS = 16_000
SHARD_ROWS = 4000
# Tasks that the training texts are read into.
SPREAD = 8
ROUNDS = 2
PASSES = 3
# The key of the intercept among those of features.
INTERCEPT = -1
THRESHOLD = 0.7


@dataclass(frozen=True)
class Rates:
    """Learning rates and penalties. A text moves a coordinate by less than 1 in a pass, so with
    ``l1`` at the number of all passes no feature of a single training text keeps a weight."""

    alpha: float = 20.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, number of the text) of all words, pairs and skipping pairs of a slice."""
    found = words(data, edges, kept=LETTERS)
    owner = found.owner()
    out = []
    for n, gap in ((1, 0), (2, 0), (2, 1)):
        grams, place = ngrams(found, n, gap)
        out.append((grams, owner[place]))
    return out


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with the distinct features of its texts, row by row."""
    for batch in batches:
        own = []
        for at, to, data, edges in slices(batch.column("text")):
            parts = features(data, edges)
            grams = np.concatenate([g for g, _ in parts])
            owner = np.concatenate([o for _, o in parts])
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(to - at + 1))
            own += [np.unique(grams[order[bounds[i] : bounds[i + 1]]]).astype(np.int64) for i in range(to - at)]
        yield batch, own


def weights_of(z: np.ndarray, n: np.ndarray, rates: Rates) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - rates.l1, 0)
    return -shrunk / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2)


def ftrl(rows: list[tuple[np.ndarray, float]], z: np.ndarray, n: np.ndarray, rates: Rates) -> None:
    """One pass of FTRL-proximal over (coordinates, label); the last coordinate is the intercept."""
    for own, label in rows:
        zi, ni = z[own], n[own]
        w = weights_of(zi, ni, rates)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(ni)
        z[own] = zi + gradient - (np.sqrt(ni + gradient * gradient) - root) / rates.alpha * w
        n[own] = ni + gradient * gradient


def _shard(state, rates: Rates, round_: int, passes: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a shard's rows change in the common state (keys, z, n), for weights other than zero."""
        known, z0, n0 = state.value
        own, ids, labels = [], [], []
        for batch, rows in _distinct(batches):
            own += rows
            ids += batch.column("doc_id").to_pylist()
            labels += batch.column("label").to_pylist()
        if not own:
            return
        keys = np.unique(np.concatenate([*own, np.array([INTERCEPT])]))
        last = np.searchsorted(keys, INTERCEPT)
        rows = [np.append(np.searchsorted(keys, x), last) for x in own]
        z, n = np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
        held = keys[at] == known
        z[at[held]], n[at[held]] = z0[held], n0[held]
        before, seen = z.copy(), n.copy()
        # The order depends on the rows alone, so a task that is run again gives the same state.
        by_id = np.argsort(np.array(ids), kind="stable")
        for pass_ in range(passes):
            order = by_id[np.random.default_rng((round_, pass_)).permutation(len(rows))]
            ftrl([(rows[i], labels[i]) for i in order], z, n, rates)
        sent = np.abs(z) > rates.l1
        sent[at[held]] = sent[last] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[sent]), pa.array((z - before)[sent]), pa.array((n - seen)[sent])], names=["key", "z", "n"]
        )

    return run


def labelled(labels: DataFrame, column: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Up to ``max_rows`` training rows (doc_id, label), the same ones in every run.

    Rows held out (crc32 of the doc_id as text leaves 1 by 3) and rows with a null are left out; a
    doc_id with several labels takes the largest.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
    one = usable.groupBy("doc_id").agg(F.max(column).cast("double").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rates: Rates = Rates(),
          max_rows: int = MAX_ROWS, rounds: int = ROUNDS, passes: int = PASSES) -> Model:
    """Fit on labelled rows of ``docs``.

    With no label, or one class only, the model has no weights and scores every text alike: 0
    without labels, else the share of label 1.
    """
    spark = docs.sparkSession
    chosen = labelled(labels, column, max_rows)
    sampled = cut(texts(docs).join(F.broadcast(chosen), "doc_id").repartition(SPREAD, "doc_id"))
    seen = sampled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    none = np.zeros(0)
    if seen["ones"] in (0, seen["n"]):
        share = min(max(seen["ones"] / max(seen["n"], 1), 1e-12), 1 - 1e-12)
        return Model(none.astype(np.int64), none, float(np.log(share / (1 - share))))
    shards = sampled.coalesce(-(-seen["n"] // SHARD_ROWS))
    keys, z, n = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    for round_ in range(rounds):
        state = spark.sparkContext.broadcast((keys, z, n))
        moved = shards.mapInArrow(_shard(state, rates, round_, passes), "key long, z double, n double")
        mean = moved.groupBy("key").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow().sort_by("key")
        both = np.union1d(keys, mean["key"].to_numpy())
        old, new = np.searchsorted(both, keys), np.searchsorted(both, mean["key"].to_numpy())
        sums = [np.zeros(len(both)), np.zeros(len(both))]
        for total, before, more in zip(sums, (z, n), ("z", "n")):
            total[old] = before
            total[new] += mean[more].to_numpy()
        keys, (z, n) = both, sums
        state.destroy()
    give_back()
    w = weights_of(z, n, rates)
    last = np.searchsorted(keys, INTERCEPT)
    kept = np.setdiff1d(np.flatnonzero(w), last)
    return Model(keys[kept], w[kept], float(w[last]))


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Scores of whole texts; an empty text is scored by the intercept."""
    out = []
    small = np.zeros(1 << 16, bool)
    small[model.keys & 0xFFFF] = True
    for at, to, data, edges in slices(column):
        total = np.full(to - at, model.bias)
        if len(model.keys):
            for grams, owner in features(data, edges):
                grams = grams.astype(np.int64)
                near = np.flatnonzero(small[grams & 0xFFFF])
                place = np.minimum(np.searchsorted(model.keys, grams[near]), len(model.keys) - 1)
                hit = model.keys[place] == grams[near]
                once = np.unique(owner[near[hit]] * len(model.keys) + place[hit])
                np.add.at(total, once // len(model.keys), model.weights[once % len(model.keys)])
        out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``docs`` columns named in ``keep``, and ``score``; null texts are empty. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(batch.column("text"), shipped.value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, "score"]
            )

    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return source.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model, "doc_id").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op1_toxicity": op1_toxicity}
