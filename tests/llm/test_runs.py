import hashlib
import random
import zlib

import numpy as np
from notelode.llm import runs


def brute(ids):
    """All runs by trying every period at every place."""
    n, out = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def ids(values):
    return (np.array(values, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def made(rng):
    out = []
    while len(out) < rng.randrange(10, 400):
        kind = rng.randrange(4)
        letters = rng.choice([1, 2, 3, 50])
        base = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 5, 6, 7, 11, 12, 13, 23, 24, 25, 40, 60]))]
        if kind == 0:
            out += base
        elif kind == 1:
            out += base * rng.randrange(2, 6) + base[: rng.randrange(len(base) + 1)]
        elif kind == 2:
            # A period that is itself periodic, but for its end.
            out += (base[:3] * 9 + base[:1]) * rng.randrange(2, 4)
        else:
            inner = base * 3 + [99]
            out += inner * rng.randrange(2, 4)
    return out


def test_against_every_period():
    rng = random.Random(5)
    for _ in range(600):
        values = made(rng)
        assert runs.find_runs(ids(values)) == brute(values), values


def test_binary_and_unary_words():
    rng = random.Random(6)
    for n in [*range(0, 30), 200, 500]:
        for letters in (1, 2):
            values = [rng.randrange(letters) for _ in range(n)]
            assert runs.find_runs(ids(values)) == brute(values)


def test_long_texts_end_soon():
    assert runs.find_runs(ids([7] * 300_000)) == [(0, 300_000, 1)]
    line = list(range(40))
    spread = [x for i in range(4000) for x in (*line, 1000 + i)]
    assert runs.find_runs(ids(spread)) == []
    assert runs.find_runs(ids(line * 5000)) == [(0, 200_000, 40)]


def test_thue_morse_words_are_told_apart():
    word = [0]
    for _ in range(12):
        word += [1 - x for x in word]
    assert runs.find_runs(ids(word)) == brute(word[:4096])


def plain(doc_id, text):
    """The query's row by the definition alone."""
    own = (text or "").encode().split()
    n = len(own)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    number = {w: i for i, w in enumerate(dict.fromkeys(own))}
    found = brute([number[w] for w in own])
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    return (
        doc_id, len(found), *((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(own) if i not in gone)).hexdigest(),
    )


def test_query_against_the_definition(spark, frame, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(f"wé{x}" for x in made(rng))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, " \t\n\x0b"), (None, "a b " * 9), (153, "a\tb\n" * 9), (153, "a\tb\n" * 9), (154, "x y " * 13)]
    frame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS own", "2 AS collapsed").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(*r)) for r in rows)


def test_empty_table(spark, docs):
    assert runs.periodic_runs(docs([])).count() == 0
