"""Words of a batch of texts as arrays of hashes.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A whole Arrow batch is handled at once:
no Python object is made for a word, so a pass costs a few nanoseconds for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Texts are handled in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# Letters and digits only; all bytes beyond ASCII count as letters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[128:] = LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = True
# Odd multipliers that give the place in an n-gram its weight.
PLACES = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
     0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25],
    dtype=U64,
)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers at least of the rolling hash's base, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """``hashes`` of all words in order; those of text ``i`` are ``first[i]:first[i + 1]``.

    ``start`` and ``end`` are byte places in ``data``, the texts' bytes one behind the other.
    """

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    edges: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the place where each begins (and the last ends); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def words(data: np.ndarray, edges: np.ndarray, fold: bool = True, kept: np.ndarray = _IS_WORD) -> Words:
    """Words of texts given as bytes; ``kept`` says which bytes belong to words."""
    n = len(data)
    inside = kept[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edges[:-1][edges[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[1:][edges[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    hashes = hash_spans(_LOWER[data] if fold else data, start, end)
    return Words(hashes, np.searchsorted(start, edges), start, end, data, edges)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings ``data[start:end]``; equal strings have equal hashes."""
    n = len(data)
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, U64)
    terms = data.astype(U64)
    terms += U64(1)
    terms *= power[:n]
    np.cumsum(terms, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, their bytes, their edges) for slices of bounded size."""
    data, edges = raw(texts)
    at, n = 0, len(edges) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICE_BYTES, "right")) - 1)
        yield at, to, data[edges[at] : edges[to]], edges[at : to + 1] - edges[at]
        at = to


def ngrams(found: Words, n: int, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and the place of each one's first word.

    With ``gap``, so many words are left out behind the first one. Runs stay inside their text.
    """
    reach = n + gap
    count = len(found.hashes) - reach + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.full(count, U64(n * 31 + gap), U64)
    for place in range(n):
        shift = place + (gap if place else 0)
        total += found.hashes[shift : shift + count] * PLACES[place]
    owner = found.owner()
    kept = np.flatnonzero(owner[:count] == owner[reach - 1 :])
    return mix(total[kept]), kept


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``n``-word runs.

    A text of fewer words has its whole word sequence as its only shingle; one without words
    has none.
    """
    for at, to, data, edges in slices(texts):
        found = words(data, edges)
        grams, place = ngrams(found, n)
        bounds = np.searchsorted(place, found.first)
        for i in range(to - at):
            if bounds[i] < bounds[i + 1]:
                yield np.unique(grams[bounds[i] : bounds[i + 1]])
            else:
                own = found.hashes[found.first[i] : found.first[i + 1]]
                total = np.zeros(1, U64)
                total += U64(7919 + len(own)) + np.sum(own * PLACES[: len(own)], dtype=U64)
                yield mix(total) if len(own) else total[:0]
