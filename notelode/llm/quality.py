"""Quality by weak labels: labellers, their accuracies by expectation-maximisation, a linear scorer.

Nine heuristic labellers vote good, bad or not at all on every text. Votes are counted by pattern
over all documents; a two-class model with one table of vote probabilities per labeller is fitted
to those counts by expectation-maximisation, without any true label. There are at most 3**9
patterns, so the driver holds a bounded table however many documents there are. The posterior of
its pattern is a text's soft label.

A linear scorer over hashed word shapes learns the soft labels of at most ``MAX_ROWS`` texts and
scores all of them. Shapes (letters, capitals, digits and marks in order, runs collapsed), pairs of
shapes and repetitions carry over between languages, which words would not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .tables import lean, table, texts
from .words import PLACES, U64, hash_spans, mix, slices, words

MAX_ROWS = 16_000
BUCKETS = 1 << 14
SHARDS = 4
ROUNDS = 4
RATE = 0.5
THRESHOLD = 0.5
GOOD, BAD, NONE = 2, 1, 0

_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_LETTER = (_KIND == 97) | (_KIND == 65)
_MARK = ~_LETTER & (_KIND != 48) & (_KIND > 32)
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:?!"])
_MARK[[ord(c) for c in ".,;:'\"-?!()"]] = False


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measures(data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers per text that the labellers look at."""
    found = words(data, edges)
    owner, n = found.owner(), len(edges) - 1
    count = np.diff(found.first)
    sums = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][edges])
    distinct = np.zeros(len(owner), bool)
    distinct[np.unique(mix(found.hashes + owner.astype(U64) * PLACES[3]), return_index=True)[1]] = True
    again = np.zeros(len(owner), bool)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    last = data[found.end - 1]
    odd = np.r_[0, np.cumsum(~(_LETTER | (_KIND == 48))[data])]
    clean = (odd[found.end - 1] == odd[found.start]) & (_LETTER | (_KIND == 48) | _STOP)[last]
    per = lambda mask: np.bincount(owner, mask, n)
    letters = sums(_LETTER[data])
    return {
        "words": count, "distinct": _share(per(distinct), count), "again": _share(per(again), count),
        "marks": _share(sums(_MARK[data]), sums(data > 32)), "capitals": _share(sums((data >= 65) & (data <= 90)), letters),
        "bars": _share(sums(data == ord("|")), count), "shouts": _share(per(last == ord("!")), count),
        "clean": _share(per(clean), count), "length": _share(per(found.end - found.start), count),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller. Thresholds are fixed parameters, the same for every corpus."""

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    long = m["words"] >= 20
    return np.stack(
        [
            vote(m["words"] < 3, (m["words"] >= 30) & (m["words"] < 100_000)),
            vote(long & (m["distinct"] < 0.3), long & (m["distinct"] > 0.45)),
            vote(m["again"] > 0.15, long & (m["again"] < 0.05)),
            vote(m["marks"] > 0.06, m["marks"] < 0.02),
            vote(m["clean"] < 0.7, m["clean"] > 0.9),
            vote(m["capitals"] > 0.4, m["capitals"] < 0.15),
            vote(m["shouts"] > 0.3, m["shouts"] < 0.05),
            vote(m["bars"] > 0.15, m["bars"] < 0.02),
            vote((m["length"] < 2.5) | (m["length"] > 14), (m["length"] > 3) & (m["length"] < 11)),
        ],
        axis=1,
    ).astype(np.uint8)


LABELLERS = 9


@lean
def _vote_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(LABELLERS)
    for batch in batches:
        codes = [votes(measures(data, edges)) @ base for _, _, data, edges in slices(batch.column("text"))]
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.astype(np.int32))], names=["doc_id", "votes"])


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts and P(vote | class) per class, labeller and vote."""

    good: float
    chance: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """P(good | votes); labellers that do not vote say nothing."""
        seen = (codes[:, None] // 3 ** np.arange(LABELLERS)) % 3
        log = np.tile(np.log([1 - self.good, self.good]), (len(codes), 1))
        for k in range(LABELLERS):
            log += np.where(seen[:, k : k + 1] == NONE, 0.0, np.log(self.chance[:, k, seen[:, k]]).T)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -35, 35)))


def fit_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns; starts from the majority of votes.

    Add-one counts keep every probability inside 0 and 1. With no patterns the model is even.
    """
    seen = (codes[:, None] // 3 ** np.arange(LABELLERS)) % 3
    good, bad = (seen == GOOD).sum(1), (seen == BAD).sum(1)
    # A heuristic that objects outweighs several that have nothing to object to.
    p = np.where(bad > 0, 0.2, 0.9) if len(codes) else np.zeros(0)
    p = np.where(good + bad == 0, 0.5, p)
    model = LabelModel(0.5, np.full((2, LABELLERS, 3), 1 / 3))
    for _ in range(rounds):
        share = (counts @ p + 1) / (counts.sum() + 2)
        chance = np.empty((2, LABELLERS, 3))
        for which, weight in ((0, counts * (1 - p)), (1, counts * p)):
            for k in range(LABELLERS):
                for vote in (GOOD, BAD):
                    chance[which, k, vote] = weight[seen[:, k] == vote].sum() + 1
                chance[which, k, NONE] = 1
                chance[which, k] /= chance[which, k, GOOD] + chance[which, k, BAD]
        model = LabelModel(float(share), chance)
        p = model.posterior(codes)
    return model


def shape_features(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their weights: shapes, shape pairs, repeated words."""
    found = words(data, edges)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, np.int64)
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[found.start] = True
    inside[1:] = np.cumsum(new)
    shapes = hash_spans(kind[new], inside[found.start], inside[found.end])
    pairs = np.zeros(len(shapes), U64)
    pairs[1:] = mix(shapes[:-1] * PLACES[0] + shapes[1:] * PLACES[1])
    again = np.zeros(len(shapes), bool)
    again[1:] = found.hashes[1:] == found.hashes[:-1]
    repeats = mix(shapes * PLACES[2] + again.astype(U64))
    for i in range(len(edges) - 1):
        low, high = found.first[i], found.first[i + 1]
        all_ = np.concatenate([shapes[low:high], pairs[low + 1 : high], repeats[low + 1 : high]])
        own, n = np.unique(all_ & U64(BUCKETS - 1), return_counts=True)
        value = np.sqrt(n / max(1, high - low))
        size = np.array([BUCKETS + min(15, int(np.log2(high - low + 1)))])
        yield np.r_[own.astype(np.int64), size], np.r_[value / max(np.linalg.norm(value), 1e-9), 0.3]


WIDTH = BUCKETS + 17  # buckets, classes of length, intercept


def _learn(state, model: LabelModel, seed: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g = (x.copy() for x in state.value)
        ids, rows, goal = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            goal.append(model.posterior(batch.column("votes").to_numpy()))
            for _, _, data, edges in slices(batch.column("text")):
                rows += shape_features(data, edges)
        if not ids:
            return
        goal = np.concatenate(goal)
        order = np.argsort(np.array(ids), kind="stable")[np.random.default_rng(seed).permutation(len(ids))]
        for i in order:
            at, value = rows[i]
            miss = 1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -35, 35))) - goal[i]
            step = miss * value
            g[at] += step * step
            w[at] -= RATE * step / np.sqrt(g[at] + 1e-6)
            g[-1] += miss * miss
            w[-1] -= RATE * miss / np.sqrt(g[-1] + 1e-6)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH)), pa.array(w), pa.array(g)], names=["at", "w", "g"])

    return run


def _scores(weights):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            out = []
            for _, _, data, edges in slices(batch.column("text")):
                out += [w[at] @ value + w[-1] for at, value in shape_features(data, edges)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score, keep) of every row of ``docs``: score from 0 to 1, keep from ``THRESHOLD``.

    A null text is empty; texts without words get the labellers' votes on nothing, which are bad.
    Repeated rows and null ids are scored like all others. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    plain = texts(docs)
    coded = plain.mapInArrow(_vote_codes, "doc_id long, votes int")
    patterns = coded.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    model = fit_labels(patterns["votes"].to_numpy(np.int64), patterns["n"].to_numpy(np.float64))
    order = F.xxhash64("doc_id")
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(order, "doc_id").limit(max_rows)
    sampled = plain.join(F.broadcast(chosen), "doc_id").repartition(SHARDS, "doc_id")

    @lean
    def with_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("votes", next(_vote_codes(iter([batch]))).column("votes"))

    sampled = cut(sampled.mapInArrow(with_votes, "doc_id long, text string, votes int"))
    w, g = np.zeros(WIDTH), np.zeros(WIDTH)
    for round_ in range(ROUNDS):
        state = spark.sparkContext.broadcast((w, g))
        learned = sampled.mapInArrow(_learn(state, model, round_), "at long, w double, g double")
        mean = learned.groupBy("at").agg(F.avg("w").alias("w"), F.avg("g").alias("g")).toPandas()
        w, g = np.zeros(WIDTH), np.zeros(WIDTH)
        w[mean["at"]], g[mean["at"]] = mean["w"], mean["g"]
        state.unpersist()
    shipped = spark.sparkContext.broadcast(w)
    return plain.mapInArrow(_scores(shipped), "doc_id long, score double").withColumn("keep", F.col("score") >= THRESHOLD)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op6_quality": op6_quality}
