import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from notelode.llm import packing
from notelode.llm.words import slices
from tokenizers import Tokenizer


def encoded(texts, encoder=None):
    encoder = encoder or packing.Encoder(packing.tokenizer_path())
    out = []
    for _, _, data, edges in slices(pa.array(texts, pa.string())):
        ids, total = encoder.encode(data, edges)
        ends = np.cumsum(total)
        out += [ids[e - n : e].tolist() for e, n in zip(ends, total)]
    return out


def plain(texts):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


ODD = [
    None, "", " \t\n", "don't we'll they're I'd 'S 's x's,'s 'sword", "a1b22c3 4.5e-6", "é ≠ a,́b 1́", "É ß　x\u0085y",
    "x<|endoftext|>y", "<|startoftext|>", "<|endoftext|", "ＡＢＣ １２３ ½ ²", "İstanbul ΣΑΣ ς", "日本語のテキスト 中文,测试", "👍🏽👨‍👩‍👧 ok", "\x00\x1c\x1f a\x7fb",
    "</w> a</w>b <//w>", "word" * 2000, "क्षत्रिय ภาษาไทย", " a b​", "'" * 50, "_a_b-c+d=e",
]


def test_ids_equal_the_tokenizer():
    assert encoded(ODD) == plain(ODD)


def test_ids_of_random_texts():
    rng = random.Random(3)
    letters = "ab Z'.,;19\t\ńé ñ中̸=<|>_-/w"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert encoded(texts) == plain(texts)


def test_ids_after_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "MAX_KNOWN", 3)
    encoder = packing.Encoder(packing.tokenizer_path())
    assert encoded(ODD, encoder) == plain(ODD) == encoded(ODD, encoder)


def best_fit_plain(lengths, capacity):
    spaces = []
    for length in sorted(lengths, reverse=True):
        fits = [s for s in spaces if s >= length]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - length)
        else:
            spaces.append(capacity - length)
    return len(spaces)


def laid_out(counts, found):
    """All pieces at their places, by the plan alone."""
    out = {}
    for length in np.flatnonzero(counts).tolist():
        for rank in range(int(counts[length])):
            key = (length << packing.RANK_BITS) + rank
            at = int(np.searchsorted(found.key, key, "right")) - 1
            over = key - int(found.key[at])
            out.setdefault(int(found.sequence[at] + over // found.each[at]), []).append((int(found.offset[at] + over % found.each[at] * length), length))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 64, 200]))
    lengths = np.minimum(rng.geometric(rng.choice([0.02, 0.1, 0.5]), int(rng.choice([1, 5, 300, 3000]))), capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    found = packing.plan(counts)
    filled = laid_out(counts, found)
    assert len(filled) == found.sequences and set(filled) == set(range(found.sequences))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    assert least <= found.sequences <= best_fit_plain(lengths.tolist(), capacity) + 2 + least // 100


def test_residual_equals_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(40):
        capacity = int(rng.integers(5, 90))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 200)))
        counts = np.bincount(lengths, minlength=capacity + 1)
        assert sum(many for _, many in packing._best_fit(counts)) == best_fit_plain(lengths.tolist(), capacity)


def test_fit_reaches_an_exact_histogram():
    of = np.array([[2, 3, 5], [0, 4, 6], [1, 1, 8], [0, 5, 5]])
    counts = np.zeros(11, np.int64)
    for pattern, many in zip(of, (70, 50, 30, 20)):
        np.add.at(counts, pattern, many)
    counts[0] = 0
    assert packing.plan(counts).sequences == 170


def check(rows, texts, capacity):
    ids = {}
    for t, own in zip(texts, plain(t for _, t in texts)):
        ids.setdefault(t[0], []).append(own)
    filled = {}
    got = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, docs in ids.items():
        want = []
        for own in docs:
            for piece, at in enumerate(range(0, len(own), capacity)):
                part = np.array(own[at : at + capacity], "<u4")
                want.append((piece, at, len(part), zlib.crc32(part.tobytes())))
        assert sorted(got[doc_id]) == sorted(want)
    assert set(got) == set(ids)


def test_query_and_sequences(spark, frame, tmp_path):
    rng = random.Random(4)
    texts = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again")]
    texts += [(100 + i, " ".join(rng.choice(["wörd", "alpha", "x,y", "12"]) for _ in range(rng.choice([1, 5, 300, 5000])))) for i in range(200)]
    made = frame(texts, "doc_id long, text string").selectExpr("*", "'a' AS length", "1 AS ids", "2 AS sequence_id", "3 AS _row")
    made.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op13_pattern_packing(spark, str(tmp_path)).collect()
    check(rows, texts, packing.CAPACITY)
    packed = packing.pack(packing.tokenized(made, packing.tokenizer_path(), 64), 64)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert (whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4")).all()
    assert sum(map(len, whole.values())) == sum(map(len, plain(t for _, t in texts)))


def test_empty_table_and_bad_lengths(frame):
    assert packing.pack(frame([], "length long, offset string")).columns == ["length", "sequence_id", "offset"]
    assert packing.pack(frame([], "length long")).count() == 0
    for bad in (0, 2049, None):
        with pytest.raises(Exception, match="a length is not from 1"):
            packing.pack(frame([(bad,)], "length long")).count()
