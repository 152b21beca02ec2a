import random
import re

import numpy as np
import pytest

from notelode.llm.components import components
from notelode.llm.near_dup import DEPTH, candidates, near_duplicates, neighbours

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    if len(found) < n:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text, n))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in ids}


def family(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, at = [], 0
    for size in (1, 2, 3, 60):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            rows.append((at, family(rng, base, rng.randrange(0, 5))))
            at += 1
    shared = " ".join(rng.choice(vocabulary) for _ in range(50))
    for _ in range(40):
        rows.append((at, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(100))))
        at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \t\n"), (at + 3, "one two"), (at + 4, "ONE two"), (at + 5, "ONE two")]
    rows += [(at + 6, "É" * 3 + " a b c d"), (at + 7, "é" * 3 + " a b c d"), (at + 8, "long " * 30_000)]
    return rows


def test_equals_brute_force(docs):
    rows = made()
    got = near_duplicates(docs(rows), words=4).collect()
    want = brute(rows, 4, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, 4)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_open_regions_lose_no_link(docs, monkeypatch):
    """With a window of two, regions stay open and only the block comparison finds their links."""
    monkeypatch.setattr("notelode.llm.near_dup.WINDOW", 2)
    monkeypatch.setattr("notelode.llm.near_dup.BLOCK", 8)
    rows = made(2)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows), words=4).collect()}
    assert got == brute(rows, 4, 80)


def test_repeated_and_null_ids(docs):
    text = "a b c d e f g h"
    got = near_duplicates(docs([(5, text), (5, "p q r s t u"), (7, "p q r s t u"), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(5, 5), (5, 5), (7, 5)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_empty_table(docs, spark):
    assert near_duplicates(docs([(1, "x")]).limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(frame):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (3, 4), (4, 3)]
    got = {r.id: r.root for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(frame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("partitions, room", [(1, 50), (1, 10**6), (13, 50), (211, 50)])
def test_regions_are_whole_wherever_they_are_cut(frame, spark, partitions, room):
    """Pairs of the whole order are found, and an open region is tied together, across every cut."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        deep = [rng.choice([1, 1, 1, 2])] * 3 + [rng.choice([1, 1, 1, 1, 3]) for _ in range(DEPTH - 3)]
        if i % 10 == 0:
            deep[2] = rng.randrange(100)
        key = bytes([rng.randrange(2)]) + b"".join(v.to_bytes(4, "big") for v in deep)
        rows.append((bytearray(key), i, rng.choice([90, 100])))
    order = sorted(rows, key=lambda r: (bytes(r[0]), r[1]))
    place = np.array([list(r[0]) for r in order], np.uint8)
    whole = neighbours(place, np.array([r[1] for r in order]), np.array([r[2] for r in order]), 80)
    pairs, ties = set(), {}
    for a, b, open_ in whole:
        for x, y, o in zip(a.tolist(), b.tolist(), open_.tolist()):
            if o:
                ties[x] = y
            else:
                pairs.add((min(x, y), max(x, y)))
    assert pairs and len(set(ties.values())) > 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = candidates(frame(rows, "place binary, doc_id long, n_shingles long"), 80, partitions, room).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs <= {(r.a, r.b) for r in got if not r.open}
    root = {r.id: r.root for r in components(frame([(r.a, r.b) for r in got if r.open], "a long, b long")).collect()}
    groups = {}
    for member, first in ties.items():
        groups.setdefault(first, set()).add(root.get(member, member))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
