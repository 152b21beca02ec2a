"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary of a merge-type (BPE) model file is read, never trained. Segmentation follows the
merge agenda: of all neighbouring symbols whose union is a piece, the best-ranked pair is merged
first, the leftmost on a tie. With dropout, a candidate is skipped when a keyed hash of the seed,
the text's doc_id, the chunk, its place in the text and the candidate's span falls below the rate;
so the same seed gives the same segmentation anywhere, another seed, document or place another one,
and rate 0 the model's own.

No piece holds a space behind another character, so a text falls into chunks at spaces that are
segmented alone. Without dropout, equal chunks of a slice are segmented once; with it, each
occurrence is. The agendas of a slice's chunks advance together in array steps; long chunks have an agenda of their own with a heap.

Characters without a piece become byte pieces. The space mark itself, when a text contains it, is
written in bytes too, so decoding restores every text exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import lean, table
from .words import PLACES, U64, hash_spans, mix

MARK = "▁"
RATE = 0.1
# Longer chunks are segmented with a heap, one by one.
LONG_CHUNK = 64
# Bytes of one step; a longer text is a step of its own.
SLICE_CHARS = 1 << 18
NO_RANK = np.int32(2**31 - 1)
DEFAULT_FILE = "piece_bpe_32k.model"


_FULL = 2**64 - 1
_PLACES = [int(x) for x in PLACES[:3]]


def _mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _FULL
    return x ^ x >> 31


@dataclass(frozen=True)
class Vocabulary:
    """Array form of a model; ids from ``size`` on stand for characters that are no pieces."""

    size: int
    chars: dict[int, int]
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    pair_ranks: np.ndarray
    byte_ids: np.ndarray
    spelled: np.ndarray
    spelled_at: np.ndarray


def load(path: str) -> Vocabulary:
    """Read a merge-type model with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    piece = {i: model.id_to_piece(i) for i in plain}
    if any(MARK in p.lstrip(MARK) for p in piece.values()):
        raise ValueError("a piece holds a space behind another character")
    ids = {p: i for i, p in piece.items()}
    letters = sorted({c for p in piece.values() for c in p})
    symbol = dict(ids)
    for c in letters:
        symbol.setdefault(c, size + len(symbol) - len(ids))
    # Rank by falling score; equal scores by id, as one of them only ever meets itself on a tie.
    ranked = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
    pairs = [
        (symbol[p[:k]] << 20 | symbol[p[k:]], i, ranked[i])
        for i, p in piece.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol
    ]
    keys, merged, ranks = (np.array(x, kind) for x, kind in zip(zip(*sorted(pairs)), (np.int64, np.int32, np.int32)))
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    if not all(model.is_byte(int(i)) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    spelling = [b""] * size
    for i, p in piece.items():
        spelling[i] = p.replace(MARK, " ").encode()
    for b, i in enumerate(byte_ids):
        spelling[i] = bytes([b])
    chars = {ord(c): symbol[c] for c in letters if c != MARK} | {0x20: symbol[MARK]}
    at = np.r_[0, np.cumsum([len(x) for x in spelling])]
    return Vocabulary(size, chars, keys, merged, ranks, byte_ids, np.frombuffer(b"".join(spelling), np.uint8), at)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, rate: float = RATE, seed: int = 0):
        self.v, self.seed = vocabulary, seed
        self.bound = U64(min(int(rate * 2.0**64), 2**64 - 1))
        self.threshold = int(self.bound)
        rows = zip(vocabulary.pair_keys.tolist(), vocabulary.pair_ranks.tolist(), vocabulary.pair_ids.tolist())
        self.pairs = {key: (rank, merged) for key, rank, merged in rows}
        self.symbols = np.full(0x110000, -1, np.int32)
        self.symbols[list(vocabulary.chars)] = list(vocabulary.chars.values())

    def _candidates(self, left, right, chunk, start, middle, end) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; no rank where they form no piece or are skipped."""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.v.pair_keys, key), len(self.v.pair_keys) - 1)
        found = (self.v.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        if self.bound:
            some = np.flatnonzero(found)
            span = (start[some].astype(U64) * PLACES[0]) ^ (middle[some].astype(U64) * PLACES[1]) ^ (end[some].astype(U64) * PLACES[2])
            found[some] = mix(chunk[some] ^ mix(span + U64(self.seed & (2**64 - 1)))) >= self.bound
        return np.where(found, self.v.pair_ranks[at], NO_RANK), self.v.pair_ids[at]

    def _together(self, symbols, chunk_hash, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments all chunks at once: (symbols, starts inside the chunk, number of the chunk)."""
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        chunk = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        start = (np.arange(len(symbols)) - first[chunk]).astype(np.int32)
        rank, merged = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int32)

        def look(at: np.ndarray) -> None:
            """Ranks anew the candidates that begin at these symbols."""
            rank[at] = NO_RANK
            at = at[at + 1 < len(chunk)]
            at = at[chunk[at] == chunk[at + 1]]
            own = chunk[at]
            behind = np.minimum(at + 2, len(chunk) - 1)
            inner = (at + 2 < len(chunk)) & (chunk[behind] == own)
            end = np.where(inner, start[behind], lengths[own])
            rank[at], merged[at] = self._candidates(symbols[at], symbols[at + 1], chunk_hash[own], start[at], start[at + 1], end)

        look(np.arange(len(symbols)))
        done = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(chunk)])
            kept = best < NO_RANK
            if not kept.all():
                live = np.repeat(kept, sizes)
                done.append((symbols[~live], start[~live], chunk[~live]))
                symbols, start, chunk, rank, merged = (x[live] for x in (symbols, start, chunk, rank, merged))
                if not len(symbols):
                    break
                best, sizes = best[kept], sizes[kept]
            wins = np.flatnonzero(rank == np.repeat(best, sizes))
            wins = wins[np.r_[True, chunk[wins[1:]] != chunk[wins[:-1]]]]  # the leftmost of a chunk
            symbols[wins] = merged[wins]
            keep = np.ones(len(symbols), bool)
            keep[wins + 1] = False
            at = wins - np.arange(len(wins))  # one symbol of each earlier chunk is gone
            symbols, start, chunk, rank, merged = (x[keep] for x in (symbols, start, chunk, rank, merged))
            look(np.concatenate([at, at[at > 0] - 1]))
        if not done:
            return symbols, start, chunk
        symbols, start, chunk = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((start, chunk))
        return symbols[order], start[order], chunk[order]

    def alone(self, symbols: np.ndarray, chunk_hash) -> tuple[np.ndarray, np.ndarray]:
        """Segments one chunk by a heap: (symbols, starts)."""
        n = len(symbols)
        symbols = symbols.tolist()
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        agenda: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                known = self.pairs.get(symbols[i] << 20 | symbols[j])
                if known and not (self.bound and self._skips(int(chunk_hash), i, end[i], end[j])):
                    heapq.heappush(agenda, (known[0], i, end[i], end[j], known[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, middle, stop, new = heapq.heappop(agenda)
            j = after[i] if alive[i] else n
            if j >= n or end[i] != middle or end[j] != stop:
                continue
            symbols[i], end[i], after[i] = new, end[j], after[j]
            alive[j] = False
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        starts = np.flatnonzero(alive)
        return np.array(symbols, np.int32)[starts], starts

    def _skips(self, chunk: int, start: int, middle: int, end: int) -> bool:
        """The same decision as in ``_candidates``, for one candidate."""
        span = start * _PLACES[0] & _FULL ^ middle * _PLACES[1] & _FULL ^ end * _PLACES[2] & _FULL
        return _mix(chunk ^ _mix(span + self.seed & _FULL)) < self.threshold

    def _spell(self, symbols: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each symbol gives); ``code`` is the symbol's first character."""
        rough = (symbols < 0) | (symbols >= self.v.size)
        width = np.ones(len(symbols), np.int64)
        c = code[rough].astype(np.int64)
        width[rough] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        ids = np.repeat(symbols, width)
        where = np.repeat(np.arange(len(symbols)), width)
        at = np.flatnonzero(np.repeat(rough, width))
        if len(at):
            first = np.r_[0, np.cumsum(width)[:-1]]
            back = (first + width)[where[at]] - 1 - at  # bytes of the character behind this one
            c, w = code[where[at]].astype(np.int64), width[where[at]]
            tail = 0x80 | (c >> (6 * back)) & 0x3F
            head = np.where(w == 1, c, (0xF00 >> w & 0xFF) | c >> (6 * (w - 1)))
            ids[at] = self.v.byte_ids[np.where(back == w - 1, head, tail)]
        return ids.astype(np.int32), width

    def encode(self, texts: list[str], variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the number of each text's ids."""
        counts = np.zeros(len(texts), np.int64)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        code = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.zeros(0, np.int32), counts
        text_at = np.r_[0, np.cumsum(sizes)]
        new = np.zeros(len(code), bool)
        new[1:] = (code[1:] == 0x20) & (code[:-1] != 0x20)
        new[text_at[:-1][sizes > 0]] = True
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(code)]
        owner = np.searchsorted(text_at, first, "right") - 1
        hashes = hash_spans(code, first, last)
        if self.bound:
            place = (first - text_at[owner]).astype(U64)
            hashes = mix(hashes + variants[owner].astype(U64) * PLACES[4] + place * PLACES[5])
        _, which, back = np.unique(hashes, return_index=True, return_inverse=True)
        length = (last - first)[which]
        symbols, starts, chunk = [], [], []
        short = np.flatnonzero(length <= LONG_CHUNK)
        span = length[short]
        at = np.repeat(first[which[short]] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
        s, p, c = self._together(self.symbols[code[at]], hashes[which[short]], span)
        symbols.append(s), starts.append(p), chunk.append(short[c])
        for u in np.flatnonzero(length > LONG_CHUNK):
            low = first[which[u]]
            s, p = self.alone(self.symbols[code[low : low + length[u]]], hashes[which[u]])
            symbols.append(s), starts.append(p), chunk.append(np.full(len(s), u))
        symbols, starts, chunk = (np.concatenate(x) for x in (symbols, starts, chunk))
        order = np.argsort(chunk, kind="stable")
        symbols, starts, chunk = symbols[order], starts[order], chunk[order]
        ids, width = self._spell(symbols, code[first[which[chunk]] + starts])
        many = np.bincount(chunk, width, len(which)).astype(np.int64)
        id_at = np.r_[0, np.cumsum(many)[:-1]]
        taken = many[back]
        place = np.repeat(id_at[back] - np.r_[0, np.cumsum(taken)[:-1]], taken) + np.arange(taken.sum())
        counts += np.bincount(owner, taken, len(texts)).astype(np.int64)
        return ids[place], counts


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of runs of ids. Each begins with the space that encoding put there."""
    width = (v.spelled_at[1:] - v.spelled_at[:-1])[ids]
    total = np.r_[0, np.cumsum(width)]
    place = np.repeat(v.spelled_at[ids] - total[:-1], width) + np.arange(total[-1])
    data = v.spelled[place].tobytes()
    edges = total[np.r_[0, np.cumsum(counts)]]
    return [data[a + 1 : b].decode("utf-8") if b > a else "" for a, b in zip(edges, edges[1:])]


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    total = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_CHARS, "right")) - 1)
        yield at, to
        at = to


def encode(docs: DataFrame, path: str, rate: float = RATE, seed: int = 0,
           decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` array<int> in place of ``text``; a null or empty text has no ids.

    With ``decoded`` the text that the ids decode to comes along as ``text``, in the same pass.
    Every row is encoded alone, so repeated rows have equal ids; a null doc_id has variant 0.
    An empty table gives an empty result. Other columns pass through; a column named ``ids`` is
    replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    shipped = docs.sparkSession.sparkContext.broadcast(load(path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value, rate, seed)
        for batch in batches:
            column, variant = batch.column("_text"), batch.column("_variant").to_numpy()
            for a, b in _steps(np.asarray(pc.binary_length(column), np.int64) + 1):
                ids, counts = encoder.encode(column.slice(a, b - a).to_pylist(), variant[a:b])
                edges = np.r_[0, np.cumsum(counts)].astype(np.int32)
                out = [*(batch.column(c).slice(a, b - a) for c in kept), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))]
                if decoded:
                    out.append(pa.array(decode_ids(shipped.value, ids, counts), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, "ids", "text"][: len(out)])

    variant = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.xxhash64("doc_id"))
    source = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text"), variant.alias("_variant"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "ids array<int>"])
    return source.mapInArrow(run, f"{schema}, text string" if decoded else schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text`` from its ``ids``; null ids give an empty text."""
    kept = [c for c in encoded.columns if c != "text"]
    shipped = encoded.sparkSession.sparkContext.broadcast(load(path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            edges = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            out: list[str] = []
            for a, b in _steps(np.diff(edges) * 4):
                out += decode_ids(shipped.value, values[edges[a] : edges[b]], np.diff(edges[a : b + 1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, "text"])

    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept), "text string"])
    return encoded.withColumn("ids", F.coalesce("ids", F.expr("array()").cast("array<int>"))).mapInArrow(run, schema)


def model_path() -> str:
    """Where the installed public vocabulary files keep the default model."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and whether they decode to the text: doc_id, n_pieces, ids_xxhash64, lossless."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    source = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    read = encode(source, model_path(), decoded=True)
    return read.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
        (F.sha2("text", 256) == F.col("sha")).alias("lossless"),
    )


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
