import random
import re
from collections import Counter

import numpy as np
import pytest
from notelode.llm import collocations
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, limit, percent):
    """Phrases by counting every run of words."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for size in (1, 2, 3, 4):
                counts.update((lang, tuple(own[i : i + size])) for i in range(len(own) - size + 1))
    out = []
    for (lang, g), a in counts.items():
        if len(g) < 2 or a < least:
            continue
        longer = [f for (o, h), f in counts.items() if o == lang and len(g) < len(h) and any(h[i : i + len(g)] == g for i in range(len(h)))
                  and f >= least]
        if any(100 * f >= percent * a for f in longer):
            continue
        score, _, l, r = min(
            (2_000_000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k, counts[lang, g[:k]], counts[lang, g[k:]]) for k in range(1, len(g))
        )
        out.append((lang, score, a, " ".join(g), l, r))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        ranked += [(lang, i + 1, p, a, l, r, n[lang], score) for i, (_, score, a, p, l, r) in enumerate(own[:limit])]
    return sorted(ranked)


def made(rng, many):
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "İx", "日本", "ZZ"]
    line = " ".join(f"line{i}" for i in range(25))
    rows = []
    for _ in range(many):
        own = [rng.choice(vocabulary[: rng.choice([4, 34])]) + rng.choice(["", "", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.4:
            own.insert(rng.randrange(len(own) + 1), line)
        if rng.random() < 0.2:
            own += ["loop loop loop loop loop loop loop"]
        rows.append((rng.choice(["en", "fr", None, "und"]), " ".join(own)))
    return rows


@pytest.mark.parametrize("least,limit", [(3, 2000), (12, 7)])
def test_against_plain_counting(frame, least, limit):
    rows = made(random.Random(least), 250) + [("en", None), ("en", ""), ("xx", " .,"), ("de", "only once")]
    docs = frame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'x' AS h1", "2 AS phrase").repartition(6)
    got = sorted(map(tuple, collocations.collocations(docs, least, limit).collect()))
    assert got == plain(rows, least, limit, 80)


def test_false_bits_cost_rows_only(frame, monkeypatch):
    rows = made(random.Random(9), 150)
    docs = frame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "frequent_bits", lambda docs, least: np.full(1 << 17, 255, np.uint8))
    monkeypatch.setattr(collocations, "SEGMENT", 3)
    monkeypatch.setattr(collocations, "MAX_WORDS", 5)
    assert sorted(map(tuple, collocations.collocations(docs, 4).collect())) == plain(rows, 4, 2000, 80)


def test_paths_hold_the_edges(frame):
    line = [("a", i, i + 1, i + 2, i + 3, 5) for i in range(1, 40)] + [("a", 100, 100, 100, 100, 9)]
    branch = [("a", 20, 21, 22, 99, 3), ("b", 1, 2, 3, 4, 2)]
    ring = [("c", 1, 2, 3, 1, 7), ("c", 2, 3, 1, 2, 7), ("c", 3, 1, 2, 3, 7)]
    edges = frame(line + branch + ring, "lang string, h1 long, h2 long, h3 long, h4 long, n long")
    compact = collocations.paths(edges).collect()
    assert sorted(map(tuple, collocations.edges_of(collocations.paths(edges)).collect())) == sorted(line + branch + ring)
    assert sorted(len(r["weights"]) for r in compact if r["lang"] == "a") == [1, 1, 19, 20]


def test_empty_table_and_flows(frame):
    empty = frame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    docs = frame([("en", "a b c d e. a b c. a b. a")] * 3, "lang string, text string")
    whole = collocations.graph(docs, 3)
    found = collocations.counts(collocations.paths(whole.where("h4 != 0")), whole.where("h4 = 0"), 3)
    size = sum((F.col(c) != 0).cast("int") for c in collocations.GRAM)
    got = sorted((r["size"], r["f"]) for r in found.withColumn("size", size).collect())
    assert got == [(1, 3), (1, 3), (1, 6), (1, 9), (1, 12), (2, 3), (2, 3), (2, 6), (2, 9), (3, 3), (3, 3), (3, 6), (4, 3), (4, 3)]
