"""Packing tokens into sequences by patterns of lengths and non-negative least squares.

Documents become ids with a last id 0; what is longer than a sequence is cut into pieces. Which
piece goes where depends on lengths alone: a histogram of at most ``capacity`` numbers reaches the
driver, whatever the rows. There all patterns of up to three lengths that fill a sequence exactly
are enumerated, repeat counts are fitted to the histogram by non-negative least squares (blocks of
patterns enter an active set), rounded, and what they leave over is packed by best fit decreasing,
with counts in place of single pieces. The result says for ranges of ranks within a length which
sequences and offsets they take: at most a few rows for each length and pattern, so it is shipped
to the tasks. Ranks come from counts by (partition, length), so no length is ever sorted or
collected, and a length that a third of the pieces has is dealt out like any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.lineage import cut
from .tables import lean, table, texts
from .words import hash_spans, slices

CAPACITY = 2048
END = 0
# Rounds in which patterns enter the active set, and the patterns looked at in one.
ROUNDS = 12
TOP = 20_000
# Beyond so many patterns only those of the most frequent lengths are fitted; the rest is residual.
MAX_PATTERNS = 400_000
# Pieces in one Arrow batch, and what a worker remembers of the words it has seen.
BATCH_PIECES = 8192
MAX_KNOWN = 1_000_000
MAX_KNOWN_IDS = 8_000_000
WORD_END = "</w>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# White space 0, letters 1, digits 2, other ASCII 3; bytes that may belong to either neighbour 4.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:] = _CLASS[ord("'")] = 4


class Encoder:
    """Ids of texts by a tokenizer whose words end in ``</w>`` and never reach over white space.

    Such a tokenizer cuts a text where ASCII letters, digits and other characters meet, so each
    such part is encoded once and then looked up. Apostrophes and characters beyond ASCII stay with
    their neighbours. Texts that hold a special token's string are encoded whole, and so are all
    texts of any other tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.by_part = config["model"].get("end_of_word_suffix") == WORD_END
        self.special = [t["content"].encode() for t in config["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for word, i in vocabulary.items():
            self.ends[i] = word.endswith(WORD_END)
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Remember the ids of new parts: words of letters in one go, all others one by one."""
        plain = np.array([p.isalpha() and p.isascii() for p in parts])
        ids, counts = [], np.zeros(len(parts), np.int64)
        chosen = np.flatnonzero(plain)
        for at in range(0, len(chosen), 1000):
            some = chosen[at : at + 1000]
            got = self.whole(" ".join(parts[i].decode() for i in some))
            stops = np.flatnonzero(self.ends[got]) + 1
            ids.append(got)
            counts[some] = np.diff(np.r_[0, stops])
        rest = np.flatnonzero(~plain)
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False)):
            ids.append(np.array(got.ids, np.uint32))
            counts[i] = len(got.ids)
        order = np.r_[chosen, rest]
        first = np.empty(len(parts), np.int64)
        first[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *ids])
        keys = np.r_[self.keys, keys]
        by = np.argsort(keys)
        self.keys, self.first, self.count = keys[by], np.r_[self.first, first][by], np.r_[self.count, counts][by]

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one behind the other with ``END`` after each, and each one's number."""
        n = len(edges) - 1
        text = data.tobytes()
        odd = {}
        if not self.by_part or any(s in text for s in self.special):
            for i in range(n):
                own = text[edges[i] : edges[i + 1]]
                if not self.by_part or any(s in own for s in self.special):
                    odd[i] = self.whole(own.decode())
        kind = _CLASS[data]
        inside = kind > 0
        fresh = np.zeros(len(data), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] < 4) & (kind[:-1] < 4) | (kind[:-1] == 0))
        fresh[edges[:-1][edges[:-1] < len(data)]] = True
        start = np.flatnonzero(inside & fresh)
        last = np.zeros(len(data), bool)
        last[:-1] = fresh[1:] | ~inside[1:]
        last[len(data) - 1 :] = True
        end = np.flatnonzero(inside & last) + 1
        keys, at, place = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MAX_KNOWN or len(self.ids) > MAX_KNOWN_IDS:
            self.forget()
        seen = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[seen] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self._learn(keys[new], [text[a:b] for a, b in zip(start[at[new]], end[at[new]])])
        known = np.searchsorted(self.keys, keys)
        counts = self.count[known][place]
        owner = np.searchsorted(edges, start, "right") - 1
        # Empty texts repeat an edge; the last text that begins there is the one with bytes.
        if odd:
            counts[np.isin(owner, list(odd))] = 0
        total = np.bincount(owner, counts, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
        for i, ids in odd.items():
            total[i] = len(ids)
        out = np.full(int(total.sum()) + n, END, np.uint32)
        begin = np.cumsum(total + 1) - total - 1
        into = np.cumsum(counts) - counts
        shift = np.arange(int(counts.sum()))
        source = np.repeat(self.first[known][place] - into, counts) + shift
        base = np.zeros(n, np.int64)
        own = total.copy()
        own[list(odd)] = 0
        base = begin - (np.cumsum(own) - own)
        out[shift + np.repeat(base[owner], counts)] = self.ids[source]
        for i, ids in odd.items():
            out[begin[i] : begin[i] + len(ids)] = ids
        return out, total + 1


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of all pieces of ``docs`` (doc_id, text; others are left behind).

    ``ids`` are little-endian unsigned 32-bit numbers. A null text is empty, so its one piece is the
    last id alone; null and repeated doc_ids stay.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for at, _, data, edges in slices(batch.column("text")):
                ids, total = encode(data, edges)
                many = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                place = (np.cumsum(total) - total)[doc] + start
                names = batch.column("doc_id").slice(at, len(total))
                for low in range(0, len(doc), BATCH_PIECES):
                    some = slice(low, low + BATCH_PIECES)
                    offsets = (np.r_[place[some], place[some][-1] + length[some][-1]] - place[low]) * 4
                    held = ids[place[low] : place[some][-1] + length[some][-1]].astype("<u4")
                    packed = pa.BinaryArray.from_buffers(
                        pa.binary(), len(doc[some]), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(held)]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(doc[some])), pa.array(piece[some].astype(np.int32)), pa.array(start[some]),
                         pa.array(length[some]), packed],
                        names=["doc_id", "piece", "start", "length", "ids"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def patterns(counts: np.ndarray) -> np.ndarray:
    """Triples of lengths that fill a sequence exactly and occur; 0 stands for no third or second one."""
    capacity = len(counts) - 1
    usable = np.flatnonzero(counts)
    room = int((12 * MAX_PATTERNS) ** 0.5)
    if len(usable) > room:
        usable = np.sort(usable[np.argsort(-counts[usable], kind="stable")[:room]])
    have = np.zeros(capacity + 1, bool)
    have[usable] = have[0] = True
    out = [np.array([[0, 0, capacity]])] if have[capacity] else []
    lows = np.r_[0, usable]
    for low in lows[3 * lows <= capacity]:
        mid = usable[(usable >= low) & (2 * usable <= capacity - low)]
        mid = mid[have[capacity - low - mid]]
        out.append(np.stack([np.full(len(mid), low), mid, capacity - low - mid], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _least_squares(of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the patterns ``of`` that fit ``wanted`` best, none restricted."""
    a = np.zeros((len(wanted), len(of)))
    for column in range(3):
        np.add.at(a, (of[:, column], np.arange(len(of))), 1)
    a[0] = 0
    square = a.T @ a
    square[np.diag_indices(len(of))] += 1e-6
    return np.linalg.solve(square, a.T @ wanted)


def fit(of: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeat counts): a non-negative least-squares fit to the histogram ``wanted``."""
    wanted = wanted.astype(float)
    wanted[0] = 0
    active, x, rest = np.zeros((0, 3), np.int64), np.zeros(0), wanted.copy()
    for _ in range(ROUNDS):
        gain = rest[of].sum(axis=1) if len(of) else np.zeros(0)
        order = np.argsort(-gain, kind="stable")[:TOP]
        order = order[gain[order] > 1e-6]
        taken, fresh = set(), []
        for i in order.tolist():
            own = [v for v in of[i].tolist() if v]
            if taken.isdisjoint(own):
                taken.update(own)
                fresh.append(i)
        if not fresh:
            break
        tried = np.unique(np.concatenate([active, of[fresh]]), axis=0)
        y = _least_squares(tried, wanted)
        while len(tried) and (y <= 1e-9).any():
            tried = tried[y > 1e-9]
            y = _least_squares(tried, wanted) if len(tried) else y[:0]
        left = wanted.copy()
        for column in range(3):
            np.subtract.at(left, tried[:, column], y)
        left[0] = 0
        if np.linalg.norm(left) > 0.999 * np.linalg.norm(rest):
            break
        active, x, rest = tried, y, left
    return active, x


@dataclass(frozen=True)
class Plan:
    """Where ranks of a length go: ``each`` pieces to a sequence from ``sequence`` and ``offset`` on."""

    key: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


RANK_BITS = 44


def _best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing over a histogram: (runs of (length, number), sequences filled like that)."""
    capacity = len(counts) - 1
    open_: dict[int, list] = {}
    have = np.zeros(capacity + 1, bool)

    def put(space: int, group: list, many: int) -> None:
        open_.setdefault(space, []).append((group, many))
        have[space] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(have[length:])
            space = length + int(fits[0]) if len(fits) else capacity
            group, many = open_[space].pop() if len(fits) else ([], n)
            if len(fits) and not open_[space]:
                have[space] = False
            k = space // length
            full = min(many, n // k)
            if full:
                put(space - k * length, [*group, (length, k)], full)
                n -= full * k
                many -= full
            if many and 0 < n < k:
                put(space - n * length, [*group, (length, n)], 1)
                many, n = many - 1, 0
            if many and len(fits):
                put(space, group, many)
    return [g for groups in open_.values() for g in groups]


def plan(counts: np.ndarray) -> Plan:
    """Sequences for a histogram: ``counts[n]`` pieces have length ``n``, the last index is the capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[list[tuple[int, int]], int]] = []
    of, x = fit(patterns(left), left)
    for i in np.argsort(-x, kind="stable").tolist():
        values, number = np.unique(of[i][of[i] > 0], return_counts=True)
        many = int(min(round(float(x[i])), *(left[values] // number)))
        if many > 0:
            left[values] -= many * number
            groups.append(([(int(v), int(k)) for v, k in zip(values, number)], many))
    groups += _best_fit(left)
    next_, rows, base = np.zeros(len(counts), np.int64), [], 0
    for group, many in groups:
        at = 0
        for length, k in group:
            rows.append(((length << RANK_BITS) + int(next_[length]), k, base, at))
            next_[length] += k * many
            at += k * length
        base += many
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*columns, base)


def _numbered(names: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their partition and their number among the partition's rows of the same length."""
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            length = batch.column("_length").to_numpy()
            values, inverse, many = np.unique(length, return_inverse=True, return_counts=True)
            order = np.argsort(inverse, kind="stable")
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(many) - many, many)
            nth += np.array([seen.get(v, 0) for v in values.tolist()], np.int64)[inverse]
            for v, k in zip(values.tolist(), many.tolist()):
                seen[v] = seen.get(v, 0) + k
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(nth)], names=[*names, "_part", "_nth"]
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with the sequence that each row goes to and its place there.

    Rows are any with a ``length`` from 1 to ``capacity``; other columns stay, columns that are
    called sequence_id or offset are replaced. A null length, or one out of range, fails the run.
    """
    spark = pieces.sparkSession
    rows = pieces.drop("sequence_id", "offset")
    bad = F.col(length).isNull() | ~F.col(length).between(1, capacity)
    sized = rows.select(
        F.struct("*").alias("_row"),
        F.when(bad, F.raise_error(F.lit(f"a length is not from 1 to {capacity}")).cast("long")).otherwise(F.col(length)).cast("long").alias("_length"),
    )
    schema = StructType([*sized.schema.fields, StructField("_part", IntegerType()), StructField("_nth", LongType())])
    kept = cut(sized.mapInArrow(_numbered(["_row", "_length"]), schema))
    held = cut(kept.groupBy("_part", "_length").agg(F.count(F.lit(1)).alias("_n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("_length").agg(F.sum("_n").alias("n")).collect():
        counts[row["_length"]] = row["n"]
    shipped = spark.sparkContext.broadcast(plan(counts))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("_part", "_length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = kept.join(bases, ["_part", "_length"]).select("_row", "_length", (F.col("_base") + F.col("_nth")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_ = shipped.value
        for batch in batches:
            size, rank = batch.column("_length").to_numpy(), batch.column("_rank").to_numpy()
            key = (size << RANK_BITS) + rank
            at = np.searchsorted(plan_.key, key, "right") - 1
            over = key - plan_.key[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(plan_.sequence[at] + over // plan_.each[at]),
                 pa.array(plan_.offset[at] + over % plan_.each[at] * size)],
                names=["_row", "sequence_id", "offset"],
            )

    placed = StructType([sized.schema["_row"], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, placed).select("_row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ``ids``; a group never exceeds a sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenized(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


QUERIES = {"op13_pattern_packing": op13_pattern_packing}
