import random
import zlib

import numpy as np

from notelode.llm import toxicity
from notelode.llm.toxicity import Model, Rates, ftrl, score, score_texts, train, weights_of


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Grub,", "grub!", "worm wort"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), "extra"))
    return rows, labels


def test_held_out_rows_are_told_apart_and_never_learned(docs, frame):
    rows, labels = corpus()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = [(i, 1 - y if i in held else y, x) for i, y, x in labels]
    table = frame(wrong, "doc_id long, toxic int, text string")
    model = train(docs(rows), table)
    got = {r.doc_id: r.score for r in score(docs(rows), model, "doc_id").collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, y, _ in labels)
    assert 0 < len(model.keys) < 200


def test_nulls_long_texts_and_missing_labels(docs, frame):
    rows, labels = corpus(60)
    none = frame([], "doc_id long, toxic int")
    flat = train(docs(rows), none)
    edge = [(None, None), (1, ""), (1, ""), (2, "grub " * 20_000)]
    got = score(docs(edge), flat, "doc_id").collect()
    assert len(got) == 4 and all(r.score < 1e-6 for r in got)
    same = train(docs(rows), frame([(i, 1, None) for i, _, _ in labels], "doc_id long, toxic int, text string"))
    assert all(r.score > 0.99 for r in score(docs(edge), same, "doc_id").collect())
    nulls = frame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert train(docs(rows), nulls).bias == flat.bias
    assert score(docs(edge).limit(0), flat, "doc_id").count() == 0


def test_ftrl_equals_the_plain_loop():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 12, 5)), float(rng.integers(0, 2))) for _ in range(50)]
    z, n = np.zeros(12), np.zeros(12)
    rates = Rates(0.7, 1.0, 0.3, 0.1)
    ftrl(rows, z, n, rates)
    pz, pn = [0.0] * 12, [0.0] * 12
    for own, label in rows:
        w = {}
        for i in own:
            sign = -1 if pz[i] < 0 else 1
            w[i] = 0.0 if abs(pz[i]) <= 0.3 else -(pz[i] - sign * 0.3) / ((1.0 + pn[i] ** 0.5) / 0.7 + 0.1)
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in own:
            sigma = ((pn[i] + g * g) ** 0.5 - pn[i] ** 0.5) / 0.7
            pz[i] += g - sigma * w[i]
            pn[i] += g * g
    assert np.allclose(z, pz) and np.allclose(n, pn)
    assert weights_of(np.zeros(3), np.ones(3), rates).tolist() == [0, 0, 0]


def test_repeated_features_count_once():
    import pyarrow as pa

    grams, _ = toxicity.features(np.frombuffer(b"grub", np.uint8), np.array([0, 4]))[0]
    model = Model(grams.astype(np.int64), np.array([2.0]), -1.0)
    one, many = score_texts(pa.array(["grub", "GRUB grub. grub"]), model)
    assert one == many == 1 / (1 + np.exp(-1.0))


def test_words_of_four_training_texts_are_learned_whatever_shard_they_are_in(docs, frame):
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20)) + (f" bad{k // 4}" if k < 80 else "")) for k, i in enumerate(ids)]
    labels = frame([(i, int(k < 80)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = train(docs(rows), labels)
    data = " ".join(f"bad{k}" for k in range(20)).encode()
    (grams, _), *_ = toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    weight = dict(zip(model.keys.tolist(), model.weights))
    assert all(weight.get(g, 0) > 0 for g in grams.astype(np.int64).tolist())
