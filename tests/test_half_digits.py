"""Scores screened in half the digits: the same hits as all products, near ties, boosts and large numbers included."""

import numpy as np
import pyarrow as pa
import pytest

from notelode.operators import vector


def batch(keys, vectors, boost):
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float64())), pa.array(boost, pa.float64())],
        names=["key", "embedding", "boost"],
    )


def best(questions, batches, k, metric, per_key_max):
    held = vector._Best(questions, k, metric, per_key_max)
    for one in batches:
        held.add(*vector._worth(one, k, per_key_max).columns)
    return held.result().to_pydict()


@pytest.mark.parametrize("metric", ["dot", "cosine"])
@pytest.mark.parametrize("per_key_max", [False, True])
@pytest.mark.parametrize("kind", ["plain", "ties", "large", "boost", "odd", "bare"])
def test_hits_are_those_of_all_products(metric, per_key_max, kind, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(vector, "FIRST_ROWS", 64)
    monkeypatch.setattr(vector, "CELLS_PER_STEP", 2000)
    rows = rng.normal(size=(3000, 16))
    asked = rng.normal(size=(10, 16))
    boost = np.zeros(len(rows))
    if kind == "ties":  # differences that half the digits do not hold
        rows = np.repeat(rows[:300], 10, axis=0) + rng.normal(size=(3000, 16)) * 1e-9
        rng.shuffle(rows)
    elif kind == "large":
        rows[::5] *= 1e9
        asked[::2] *= 1e-9
    elif kind == "boost":
        boost = rng.normal(size=len(rows)) * 1e6
    elif kind == "odd":
        rows[7], rows[900, 3], rows[1500] = 0, np.nan, 1e200
        asked[3] = 0
        boost[2000] = np.nan
    keys = [f"f{i}" for i in rng.integers(0, 12 if per_key_max else 3000, len(rows))]
    questions = vector._Questions([f"q{i}" for i in range(10)], asked.tolist(), [f"f{i}" if per_key_max else None for i in range(10)])
    rows = [[] if kind == "bare" and at % 7 == 0 else row for at, row in enumerate(rows.tolist())]
    batches = [batch(keys[at : at + 500], rows[at : at + 500], boost[at : at + 500]) for at in range(0, 3000, 500)]
    got = best(questions, batches, 4, metric, per_key_max)
    monkeypatch.setattr(vector._Best, "_close", lambda *_: None)
    want = best(questions, batches, 4, metric, per_key_max)
    assert got["query_id"] == want["query_id"] and got["key"] == want["key"]
    assert np.allclose(got["score"], want["score"], rtol=1e-12, atol=1e-11, equal_nan=True)
    if kind == "plain":
        rows = np.array(rows)
        scores = rows @ asked.T if metric == "dot" else rows @ asked.T / np.outer(np.sqrt((rows**2).sum(1)), np.sqrt((asked**2).sum(1)))
        for i in range(10):
            each = {}
            for key, score in zip(keys, scores[:, i]):
                each.setdefault(key, []).append(round(score, 12))
            ranked = [(-max(s), key) for key, s in each.items() if key != f"f{i}"] if per_key_max else [(-x, key) for key, s in each.items() for x in s]
            assert [key for q, key in zip(got["query_id"], got["key"]) if q == f"q{i}"] == [key for _, key in sorted(ranked)[:4]]


def test_once_every_question_has_its_hits_products_are_not_made_in_all_digits(monkeypatch):
    rng = np.random.default_rng(3)
    rows, made = rng.normal(size=(20_000, 32)).tolist(), []
    rows[::50] = [[] for _ in rows[::50]]
    whole = vector._Questions.scores
    monkeypatch.setattr(vector._Questions, "scores", lambda self, v, m: made.append(len(v)) or whole(self, v, m))
    questions = vector._Questions([f"q{i}" for i in range(50)], rng.normal(size=(50, 32)).tolist(), [None] * 50)
    keys = [f"f{i % 9}" for i in range(len(rows))]
    held = best(questions, [batch(keys, rows, np.zeros(len(rows)))], 3, "cosine", True)
    assert len(held["key"]) == 150 and sum(made) < len(rows) / 4
