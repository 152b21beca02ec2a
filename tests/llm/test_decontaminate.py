import random

import numpy as np
import pytest

from notelode.llm.decontaminate import DOC_SHAPES, ITEM_SHAPES, align, contamination


def texts(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(12)]
    items += [(90, "two words"), (91, None), (92, ""), (93, items[0][1])]
    docs, want = [], set()
    for i in range(150):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            k = rng.randrange(12)
            copy = items[k][1].split()
            for _ in range(len(copy) // 12):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [word(), copy[at]]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," for w in copy]
            want.add((i, k))
            if k == 0:
                want.add((i, 93))
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, (items[5][1] + " ") * 400), (502, "x")]
    want.add((502, 5))
    return docs, items, want


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_finds_edited_copies_and_nothing_else(docs, frame, most):
    rows, items, want = texts()
    table = frame([(*r, "clash") for r in items], "item_id long, text string, score string")
    got = contamination(docs(rows), table, max_seeds=most).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0.5 <= r.score <= 1 for r in got) and len(got) == len(want)


def test_short_items_and_empty_tables(docs, frame):
    items = frame([(1, "Two  words!")], "item_id long, text string")
    got = contamination(docs([(1, "here two words there"), (2, "two other words")]), items).collect()
    assert [(r.doc_id, r.score, r.end_word) for r in got] == [(1, 1.0, 3)]
    assert contamination(docs([(1, "a")]).limit(0), items).count() == 0
    assert contamination(docs([(1, "a")]), items.limit(0)).count() == 0


def test_alignment_equals_the_plain_programme():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 6, rng.integers(1, 12)) for _ in range(60)]
    passages = [rng.integers(0, 6, rng.integers(0, 30)) for _ in range(60)]
    score, _ = align(items, passages)
    for got, a, b in zip(score, items, passages):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert got == h.max()


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("verbatim", [0, 3])
@pytest.mark.parametrize("every", [3, 4, 5])
def test_finds_copies_with_every_nth_word_replaced(docs, frame, every, verbatim, most):
    items = frame([(1, " ".join(f"w{i}" for i in range(41)))], "item_id long, text string")
    edited = " ".join(f"x{i}" if i % every == every - 1 else f"w{i}" for i in range(41))
    whole = " ".join(f"w{i}" for i in range(41))
    rows = [(0, f"before it {edited} behind it")] + [(i + 1, f"other {whole} words") for i in range(verbatim)]
    got = {r.doc_id: r.score for r in contamination(docs(rows), items, max_seeds=most).collect()}
    assert sorted(got) == list(range(verbatim + 1))
    assert 0.5 <= got[0] < 0.8 and all(got[i + 1] == 1 for i in range(verbatim))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_finds_copies_with_added_words(docs, frame, most):
    items = frame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    single = " ".join(f"w{i} x{i}" for i in range(30))
    double = " ".join(f"w{i}" if i % 2 == 0 else f"w{i} x{i} y{i}" for i in range(30))
    got = contamination(docs([(1, single), (2, f"other words {double}"), (3, "w1 w2 w3 and no more")]), items, max_seeds=most)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_alignments_of_half_the_score_hold_a_seed():
    rng = random.Random(5)
    shared = {tuple(p) for p in ITEM_SHAPES}, {tuple(p) for p in DOC_SHAPES}
    checked = 0
    for _ in range(20_000):
        n, p, q = rng.randrange(9, 30), rng.random(), rng.random()
        item, doc, pairs, at, edits = n, 0, [], 0, 0
        while at < item:
            if rng.random() > p:
                pairs.append((at, doc))
                at, doc = at + 1, doc + 1
            else:
                kind = rng.random()
                at, doc = at + (kind < q), doc + (kind > q / 2)
                edits += 1
        if 2 * len(pairs) - edits < n:
            continue
        checked += 1
        steps = lambda three, k: tuple(x[k] - three[0][k] for x in three)
        triples = [pairs[i : i + 3] for i in range(len(pairs) - 2)]
        assert any(steps(t, 0) in shared[0] and steps(t, 1) in shared[1] for t in triples)
    assert checked > 3_000
