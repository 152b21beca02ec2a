"""Benchmark decontamination: spaced word triples as seeds, then Smith-Waterman alignment.

Seeds are triples of neighbouring words of the test items, with up to one word left out
(``ITEM_SHAPES``); documents are searched for the same words with up to two words left out
(``DOC_SHAPES``). Every triple is a seed, however common: an alignment of an item of nine words or
more that reaches half the score of a verbatim copy always holds one. (Otherwise each two steps
from match to match would hold a skipped item word and another edit, or three edits, which costs
more than the matches give.) Passages around hits that hold enough of the item's words to reach
the threshold are aligned with it word by word, which scores copies with replaced, added or left
out words. Words are letters and digits, A-Z lower-cased.

Documents are read once and never shuffled: only passages around hits leave a task. The seeds are
broadcast when there are at most ``MAX_BROADCAST_SEEDS`` (40 bytes each, and 8 for each word of an
item); beyond that, triples and seeds meet in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .tables import lean, table, texts
from .words import LETTERS, PLACES, U64, Words, mix, ngrams, slices, words

GRAM = 3
# Places of a seed's words, counted from its first.
ITEM_SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
DOC_SHAPES = (*ITEM_SHAPES, (0, 1, 4), (0, 2, 4), (0, 3, 4))
MATCH, MISMATCH, GAP = 2, -1, -1
# Share of the score of a verbatim copy from which a document counts as contaminated.
THRESHOLD = 0.5
MAX_BROADCAST_SEEDS = 1_000_000
# Alignments of one step of the batched dynamic programme.
ALIGN_CELLS = 2_000_000


def _shaped(found: Words, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As ``ngrams``, of the words at these places; equal words have equal hashes in every shape."""
    count = len(found.hashes) - shape[-1]
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.full(count, U64(len(shape) * 31), U64)
    for weight, shift in zip(PLACES, shape):
        total += found.hashes[shift : shift + count] * weight
    owner = found.owner()
    kept = np.flatnonzero(owner[:count] == owner[shape[-1] :])
    return mix(total[kept]), kept


def _runs(found: Words, sizes, shapes) -> tuple[np.ndarray, np.ndarray]:
    parts = [ngrams(found, n) for n in sizes if n < GRAM]
    parts += [_shaped(found, shape) for shape in shapes if GRAM in sizes]
    return np.concatenate([g for g, _ in parts]).astype(np.int64), np.concatenate([p for _, p in parts])


@lean
def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, its words' hashes, its seeds and their places); short items have one of all words."""
    for batch in batches:
        ids, own, runs, ats = [], [], [], []
        for at, to, data, edges in slices(batch.column("text")):
            found = words(data, edges, kept=LETTERS)
            grams = {n: _runs(found, (n,), ITEM_SHAPES) for n in range(1, GRAM + 1)}
            for i in range(to - at):
                low, high = found.first[i], found.first[i + 1]
                if low == high:
                    continue
                hashes, place = grams[min(GRAM, int(high - low))]
                inside = np.flatnonzero((place >= low) & (place < high))
                ids.append(batch.column("item_id")[at + i].as_py())
                own.append(found.hashes[low:high].astype(np.int64))
                runs.append(hashes[inside])
                ats.append(place[inside] - low)
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(own, many), pa.array(runs, many), pa.array(ats, many)],
            names=["item_id", "item_words", "run", "at"],
        )


class Seeds:
    """Sorted seed hashes with where they occur in items, and the items' words."""

    def __init__(self, rows: list, items: list):
        rows = sorted(rows, key=lambda r: (r["run"], r["item_id"], r["at"]))
        column = lambda name: np.array([r[name] for r in rows], np.int64)
        self.run, self.item, self.at, self.length = map(column, ("run", "item_id", "at", "length"))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.run & 0xFFFFF] = True
        self.sizes = sorted({min(GRAM, int(n)) for n in self.length})
        # Of a repeated id all texts are seeds, and each is aligned.
        self.words: dict[int, list[np.ndarray]] = {}
        for r in items:
            self.words.setdefault(r["item_id"], []).append(np.array(r["item_words"], np.int64))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in ``grams`` that are seeds, first and last posting of each)."""
        near = np.flatnonzero(self.filter[grams & 0xFFFFF])
        low, high = np.searchsorted(self.run, grams[near]), np.searchsorted(self.run, grams[near], "right")
        hit = low < high
        return near[hit], low[hit], high[hit]


def reaches(item: np.ndarray, passage: np.ndarray, threshold: float) -> bool:
    """Whether the passage holds so many of the item's words that their alignment may reach the threshold."""
    return sum(map(set(passage.tolist()).__contains__, item.tolist())) >= threshold * len(item)


def windows(place: np.ndarray, at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of a document's words to align with one item, from its hits.

    Hits whose diagonals lie close together share a stretch, which spans the whole item with room
    for as many added words as half the score of a verbatim copy can pay; a stretch of repeated
    hits is begun anew behind three item lengths.
    """
    diagonal = np.sort(place - at)
    slack = length
    out: list[tuple[int, int]] = []
    first = last = int(diagonal[0])
    for d in diagonal[1:].tolist():
        if d - last > slack or d - first > 3 * length:
            out.append((first - slack, last + length + slack))
            first = d
        last = d
    out.append((first - slack, last + length + slack))
    return out


def _passages(shipped, threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shipped.value
        for batch in batches:
            docs, items, starts, own = [], [], [], []
            for at, to, data, edges in slices(batch.column("text")):
                found = words(data, edges, kept=LETTERS)
                grams, place = _runs(found, seeds.sizes, DOC_SHAPES)
                hit, low, high = seeds.hits(grams)
                if not len(hit):
                    continue
                many = high - low
                posting = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                where = np.repeat(place[hit], many)
                owner = np.searchsorted(found.first, where, "right") - 1
                order = np.lexsort((seeds.item[posting], owner))
                posting, where, owner = posting[order], where[order], owner[order]
                item = seeds.item[posting]
                breaks = np.flatnonzero((owner[1:] != owner[:-1]) | (item[1:] != item[:-1])) + 1
                for i, j in zip(np.r_[0, breaks], np.r_[breaks, len(item)]):
                    base, end = found.first[owner[i]], found.first[owner[i] + 1]
                    length = int(seeds.length[posting[i]])
                    for a, b in windows(where[i:j] - base, seeds.at[posting[i:j]], length):
                        a, b = max(0, a), min(int(end - base), b)
                        passage = found.hashes[base + a : base + b].astype(np.int64)
                        if not any(reaches(x, passage, threshold) for x in seeds.words[int(item[i])]):
                            continue
                        docs.append(batch.column("doc_id")[at + int(owner[i])].as_py())
                        items.append(int(item[i]))
                        starts.append(a)
                        own.append(passage)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(own, pa.list_(pa.int64()))],
                names=["doc_id", "item_id", "start", "passage"],
            )

    return run


@lean
def _all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every triple and shorter run of every document, for seed sets too large to ship."""
    for batch in batches:
        for at, _, data, edges in slices(batch.column("text")):
            found = words(data, edges, kept=LETTERS)
            grams, place = _runs(found, range(1, GRAM + 1), DOC_SHAPES)
            owner = np.searchsorted(found.first, place, "right") - 1
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[at + owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), from_pandas=True), pa.array(grams), pa.array(place - found.first[owner])],
                names=["doc_id", "run", "place"],
            )


@lean
def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of documents that come with their hits."""
    for batch in batches:
        for at, to, data, edges in slices(batch.column("text")):
            found = words(data, edges, kept=LETTERS)
            for i in range(to - at):
                own = found.hashes[found.first[i] : found.first[i + 1]].astype(np.int64)
                row = {c: batch.column(c)[at + i].as_py() for c in ("doc_id", "item_id", "length", "hits")}
                place, offset = np.array([(h["place"], h["at"]) for h in row["hits"]]).T
                spans = [(max(0, a), min(len(own), b)) for a, b in windows(place, offset, row["length"])]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([row["doc_id"]] * len(spans), pa.int64()), "item_id": pa.array([row["item_id"]] * len(spans), pa.int64()),
                     "start": pa.array([a for a, _ in spans], pa.int64()), "passage": pa.array([own[a:b] for a, b in spans], pa.list_(pa.int64()))}
                )


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair: (score, place in the passage where it ends)."""
    n = len(items)
    score, ends = np.zeros(n, np.int32), np.zeros(n, np.int32)
    order = np.argsort([len(x) for x in passages], kind="stable")
    at = 0
    while at < n:
        to, width = at + 1, len(passages[order[at]])
        while to < n and (to - at + 1) * (width_ := len(passages[order[to]])) <= ALIGN_CELLS and width_ <= 2 * width + 16:
            to += 1
        rows = order[at:to]
        width, height = max(len(passages[r]) for r in rows), max(len(items[r]) for r in rows)
        doc = np.zeros((len(rows), width), np.int64)
        item = np.zeros((len(rows), height), np.int64)
        doc_is, item_is = np.zeros(doc.shape, bool), np.zeros(item.shape, bool)
        for k, r in enumerate(rows):
            doc[k, : len(passages[r])], item[k, : len(items[r])] = passages[r], items[r]
            doc_is[k, : len(passages[r])], item_is[k, : len(items[r])] = True, True
        ramp = (-GAP * np.arange(width + 1)).astype(np.int32)
        above = np.zeros((len(rows), width + 1), np.int32)
        best, where = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for i in range(height):
            same = (doc == item[:, i : i + 1]) & doc_is & item_is[:, i : i + 1]
            here = np.zeros_like(above)
            np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), above[:, 1:] + GAP, out=here[:, 1:])
            np.maximum(here, 0, out=here)
            here = np.maximum.accumulate(here + ramp, axis=1) - ramp
            here[~np.pad(doc_is, ((0, 0), (1, 0)), constant_values=True)] = 0
            top = here.argmax(axis=1)
            value = here[np.arange(len(rows)), top]
            better = value > best
            best[better], where[better] = value[better], top[better]
            above = here
        score[rows], ends[rows] = best, where
        at = to
    return score, ends


@lean
def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passages = [x.values.to_numpy() for x in batch.column("passage")]
        items = [x.values.to_numpy() for x in batch.column("item_words")]
        score, ends = align(items, passages)
        length = np.array([max(1, len(x)) for x in items])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("item_id"), pa.array(score / (MATCH * length)),
             pa.array(batch.column("start").to_numpy() + ends)],
            names=["doc_id", "item_id", "score", "end_word"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                  max_seeds: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, score, end_word) of documents that hold a copy of an item.

    ``score`` is the best local alignment's share of a verbatim copy's score; ``end_word`` is the
    word behind the copy. Null and empty texts and items match nothing, nor do rows with a null
    id. An item of fewer than ``GRAM`` words is sought as a whole. Repeated ids give one row per
    pair, the best. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    plain = texts(docs).where("doc_id IS NOT NULL")
    source = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    items = cut(source.mapInArrow(
        _item_rows, "item_id long, item_words array<long>, run array<long>, at array<long>"
    ))
    seeds = items.select(
        "item_id", F.size("item_words").cast("long").alias("length"), F.explode(F.arrays_zip("run", "at")).alias("s")
    ).select("item_id", "length", "s.run", "s.at")
    schema = "doc_id long, item_id long, start long, passage array<long>"
    if seeds.count() <= max_seeds:
        known = Seeds(seeds.collect(), items.select("item_id", "item_words").collect())
        found = plain.mapInArrow(_passages(spark.sparkContext.broadcast(known), threshold), schema)
    else:
        everything = plain.mapInArrow(_all_runs, "doc_id long, run long, place long")
        hits = everything.join(seeds, "run").groupBy("doc_id", "item_id", "length").agg(
            F.collect_list(F.struct("place", "at")).alias("hits")
        )
        found = plain.join(hits, "doc_id").mapInArrow(_around, schema)
    return (
        found.join(items.select("item_id", "item_words"), "item_id")
        .mapInArrow(_aligned, "doc_id long, item_id long, score double, end_word long")
        .where(F.col("score") >= threshold)
        .groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("best"))
        .select("doc_id", "item_id", "best.score", "best.end_word")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    )


QUERIES = {"op3_decontamination": op3_decontamination}
