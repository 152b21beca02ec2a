import random

import numpy as np
import pytest

from notelode.llm import pieces
from notelode.llm.pieces import Encoder, decode, decode_ids, encode, load, model_path


@pytest.fixture(scope="module")
def vocabulary():
    return load(model_path())


def made():
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "é", "中文", "\U0001F600", "the", "x" * 70, "\t", "hello", "\U0001F9D0", "ß", " world", "<0x0A>", "</s>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + ["", " ", "a" * 500]


def runs(ids, counts):
    at = np.r_[0, np.cumsum(counts)]
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_without_dropout_it_is_the_model_s_own_segmentation(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = made()
    assert runs(*Encoder(vocabulary, 0.0).encode(texts, np.zeros(len(texts), int))) == model.encode(texts)


def test_dropout_decodes_and_varies_by_seed_and_variant(vocabulary):
    texts = made() + ["▁", "a▁ ▁b", " ▁▁"]
    seen = []
    for seed, variant in ((0, 0), (1, 0), (0, 1)):
        ids, counts = Encoder(vocabulary, 0.2, seed).encode(texts, np.full(len(texts), variant))
        assert decode_ids(vocabulary, ids, counts) == texts
        seen.append(ids.tolist())
        again, _ = Encoder(vocabulary, 0.2, seed).encode(texts, np.full(len(texts), variant))
        assert again.tolist() == seen[-1]
    assert seen[0] != seen[1] != seen[2] != seen[0]
    everything, counts = Encoder(vocabulary, 1.0).encode(["hello there"], np.zeros(1, int))
    assert len(everything) == len("hello there") + 1


def test_agendas_of_arrays_and_of_a_heap_agree(vocabulary, monkeypatch):
    encoder, texts = Encoder(vocabulary, 0.15, 9), [t for t in made() if t]
    together = runs(*encoder.encode(texts, np.zeros(len(texts), int)))
    monkeypatch.setattr(pieces, "LONG_CHUNK", 1)
    assert runs(*encoder.encode(texts, np.zeros(len(texts), int))) == together


def test_tables(docs):
    rows = [(1, "a text"), (1, "a text"), (2, None), (3, ""), (None, "é"), (4, "w" * 100_000), (5, "words " * 30_000)]
    source = docs(rows)
    read = decode(encode(source, model_path()), model_path())
    assert set(read.columns) == {*source.columns, "ids"}
    got = read.collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t or "") for i, t in rows)
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 1
    both = encode(source, model_path(), decoded=True).select(*read.columns).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    assert decode(encode(source.limit(0), model_path()), model_path()).count() == 0


def test_every_occurrence_and_document_has_its_own_dropout(vocabulary, docs):
    ids, counts = Encoder(vocabulary, 0.2).encode([" ".join(["segmentation"] * 300)], np.zeros(1, int))
    spelled = [vocabulary.spelled[vocabulary.spelled_at[i] : vocabulary.spelled_at[i + 1]].tobytes() for i in ids]
    cuts = "|".join(x.decode() for x in spelled).split(" ")
    assert len({c.strip("|") for c in cuts}) > 10
    read = encode(docs([(i, "a longer segmentation of words") for i in range(100)]), model_path(), 0.2).collect()
    assert len({tuple(r.ids) for r in read}) > 20
