import numpy as np
import pytest

from notelode.llm.embedding_dedup import linked_vectors

SCHEMA = "vec_id long, embedding array<{}>, label int, n_links string, key string"


def made(seed=0, size=24):
    rng = np.random.default_rng(seed)
    vectors, labels = [], []
    for group in (1, 1, 1, 2, 5, 40):
        base = rng.normal(size=size)
        for _ in range(group):
            vectors.append(base + rng.normal(size=size) * rng.choice([0.05, 0.12, 0.2]) * 1.0)
            labels.append(int(rng.integers(0, 2)) if group < 40 else 1)
    vectors += list(rng.normal(size=(200, size)))
    labels += rng.integers(0, 3, 200).tolist()
    rows = [(i, [float(x) for x in v], y) for i, (v, y) in enumerate(zip(vectors, labels))]
    same = rows[5][1]
    rows += [(1000 + i, same, rows[5][2]) for i in range(7)] + [(1100, [2 * x for x in same], rows[5][2]), (1101, same, None)]
    rows += [(1200, None, 1), (1201, [0.0] * size, 1), (1202, [float("nan")] + same[1:], 1), (1203, [None] + same[1:], 1)]
    rows += [(1204, [float("inf")] + same[1:], 1), (1205, same[:3], 1), (1206, same[:3], 1), (1207, [], 1), (None, same, rows[5][2])]
    return rows


def brute(rows):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v)
        return v / np.linalg.norm(v)

    known = [(i, unit(v), y) for i, v, y in rows if i is not None]
    links = {i: set() for i, _, _ in known}
    for i, a, y in known:
        for j, b, z in known:
            if i != j and a is not None and b is not None and y is not None and y == z and len(a) == len(b) and a @ b >= 0.93:
                links[i].add(j)
    root = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += links[k]
    return {i: (len(x), root[i]) for i, x in links.items()}


@pytest.mark.parametrize(("kind", "block"), [("double", 1024), ("double", 8)])
def test_equals_brute_force(frame, kind, block):
    rows = made()
    table = frame([(*r, "x", "y") for r in rows], SCHEMA.format(kind))
    got = linked_vectors(table, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == brute(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert len(got) == len(rows)


def test_recall_at_the_threshold(frame):
    """Pairs just above the threshold in 64 dimensions, among vectors that have enough pivots."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.932 * x + np.sqrt(1 - 0.932**2) * z
    rows = [(i, v.tolist(), 1, "", "") for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r.component_id for r in linked_vectors(frame(rows, SCHEMA.format("float"))).collect()}
    found = sum(got[600 + i] == got[i] == i for i in range(600))
    assert found >= 0.99 * 600


def test_empty_table(frame):
    assert linked_vectors(frame([], SCHEMA.format("float"))).count() == 0
