import random

import numpy as np

from notelode.llm.quality import BAD, GOOD, LABELLERS, fit_labels, quality


def texts(n=240):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutrns") for _ in range(rng.randrange(3, 9)))
    rows, good = [], {}
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 120))]
        kind = i % 6
        text = {
            0: lambda: " ".join(w + rng.choice(["***", "%%%", "###"]) for w in words),
            1: lambda: " ".join([words[0]] * 60),
        }.get(kind, lambda: " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)))()
        rows.append((i, text))
        good[i] = kind > 1
    return rows, good


def test_separates_without_labels(docs):
    rows, good = texts()
    got = {r.doc_id: r for r in quality(docs(rows)).collect()}
    assert {i for i, r in got.items() if r.keep} == {i for i, g in good.items() if g}


def test_nulls_repeats_long_and_empty(docs):
    rows, _ = texts(60)
    edge = [(900, None), (901, ""), (902, "word " * 30_000), (902, "word " * 30_000), (None, "A fine text. " * 9), (None, None)]
    got = quality(docs(rows + edge)).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    assert not any(r.keep for r in got if r.doc_id == 902)
    assert quality(docs(rows).limit(0)).count() == 0
    assert quality(docs([(1, "one text")])).count() == 1


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(2)
    accuracy = np.array([0.95, 0.9, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.6])
    truth = rng.random(20_000) < 0.7
    right = rng.random((len(truth), LABELLERS)) < accuracy
    vote = np.where(right == truth[:, None], GOOD, BAD)
    vote[rng.random(vote.shape) < 0.2] = 0
    codes, counts = np.unique(vote @ 3 ** np.arange(LABELLERS), return_counts=True)
    model = fit_labels(codes, counts.astype(float))
    assert abs(model.good - truth.mean()) < 0.03
    assert np.abs(model.chance[1, :, GOOD] - accuracy).max() < 0.04
    assert fit_labels(np.zeros(0, np.int64), np.zeros(0)).good == 0.5
