"""Retrieval operators: worked cases, brute force, and both size paths against each other."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notelode.config import Config, Features, Retrieval
from notelode.functions.text import index_tokens
from notelode.models import StandIn
from notelode.operators import evaluate, fusion, lexical, packing, postings, sizing
from notelode.operators.filters import Filters
from notelode.operators.mmr import diversify
from notelode.operators.rerank import rerank
from notelode.operators.vector import related_files, vector_top_k
from notelode.plans.answer import answer, evaluate as run_evaluation
from notelode.plans.retrieve import retrieve

CHUNK = (
    "chunk_id string, file_path string, heading_path array<string>, content string, tokens int,"
    " chunk_type string, tags array<string>, mtime long, embedding array<double>"
)


def unit(rng, n=8):
    v = [rng.gauss(0, 1) for _ in range(n)]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


@pytest.fixture(scope="module")
def library(spark):
    """Sixty chunks over a skewed set of files, with identical copies among them."""
    rng = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "delta", "naïve", "foo_bar", "omega"]
    rows = []
    for i in range(60):
        same = i >= 40  # a third are copies of one chunk
        content = "alpha beta foo_bar" if same else " ".join(rng.choices(vocabulary, k=12))
        vector = [1.0] + [0.0] * 7 if same else unit(rng)
        path = "hot.md" if i % 3 == 0 else f"f{i % 7}.md"
        tags, kind = ["t" + str(i % 2)], "code" if i % 5 == 0 else "text"
        rows.append((f"c{i:02}", path, ["H"], content, len(content.split()), kind, tags, i, vector))
    return rows, spark.createDataFrame(rows, CHUNK).repartition(5)


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(3)
    texts = ["alpha", "alpha beta", "foo_bar alpha", "naive", "absent alpha", "___", "?", "beta beta gamma"]
    rows = [(f"q{i}", text, unit(rng)) for i, text in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "query_id string, question string, vector array<double>")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in ("query_id", *columns)) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"max_questions": 3}])
def test_vector_top_k_is_exact_on_both_paths(library, questions, limits):
    rows, chunks = library
    asked, df = questions
    got = vector_top_k(chunks, df, 5, **limits)
    want = []
    for query_id, _, q in asked:
        scored = sorted((-round(sum(a * b for a, b in zip(r[8], q)), 12), r[0]) for r in rows)[:5]
        want += [(query_id, chunk_id, rank) for rank, (_, chunk_id) in enumerate(scored, 1)]
    assert pairs(got, "chunk_id", "rank") == sorted(want)


@pytest.mark.parametrize("limits", [{}, {"max_questions": 3}])
def test_related_files_is_exact_on_both_paths(spark, library, questions, limits):
    rows, chunks = library
    notes = [(f"f{i}.md", f"f{i}.md", questions[0][i][2]) for i in range(7)]
    df = spark.createDataFrame(notes, "query_id string, path string, vector array<double>")
    want = []
    for query_id, path, q in notes:
        best = {}
        for r in rows:
            if r[1] != path:
                best[r[1]] = max(best.get(r[1], -9), round(sum(a * b for a, b in zip(r[8], q)), 12))
        ranked = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        want += [(query_id, p, rank) for rank, (p, _) in enumerate(ranked, 1)]
    assert pairs(related_files(chunks, df, 3, **limits), "path", "rank") == sorted(want)


def test_related_worked_case(spark):
    chunks = spark.createDataFrame(
        [("1", "Self.md", [1.0, 0.0]), ("2", "A.md", [0.9, 0.0]), ("3", "B.md", [0.0, 1.0])],
        "chunk_id string, file_path string, embedding array<double>",
    )
    note = spark.createDataFrame([("n", "Self.md", [1.0, 0.0])], "query_id string, path string, vector array<double>")
    rows = related_files(chunks, note, 5).orderBy("rank").collect()
    assert [r["path"] for r in rows] == ["A.md", "B.md"]
    assert related_files(chunks, note, 1).count() == 1


def test_ragged_vectors_use_the_shared_length(spark):
    chunks = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("b", [1.0, 2.0, 5.0, 9.0]), ("c", None)], "chunk_id string, embedding array<double>"
    )
    q = spark.createDataFrame([("q", [1.0, 1.0, 1.0])], "query_id string, vector array<double>")
    rows = vector_top_k(chunks, q, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [("b", 8.0), ("a", 3.0), ("c", 0.0)]


def brute_bm25(docs, question):
    tokens = {i: re.findall(r"[a-z0-9]+", text.lower().replace("ï", "i")) for i, text in docs}
    asked = [tuple(p for p in w.lower().split("_") if p) for w in re.findall(r"[A-Za-z0-9_]+", question)]
    if not asked or () in asked:
        return {}

    def tf(words, parts):
        return sum(tuple(words[i : i + len(parts)]) == parts for i in range(len(words) - len(parts) + 1))

    average = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for i, ws in tokens.items():
        if all(tf(ws, p) for p in asked):
            score = 0.0
            for p, n in Counter(asked).items():
                df = sum(tf(w, p) > 0 for w in tokens.values())
                idf = max(math.log((len(tokens) - df + 0.5) / (df + 0.5)), 0) or 1e-6
                f = tf(ws, p)
                score += n * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / average))
            out[i] = -score
    return out


@pytest.mark.parametrize("limits", [{}, {"max_questions": 1}, None])
def test_lexical_hits_match_brute_force_on_all_paths(library, questions, limits):
    """Token arrays with few and many questions, and stored postings (None)."""
    rows, chunks = library
    asked, df = questions
    index = postings.postings(chunks) if limits is None else lexical.index_chunks(chunks)
    hits = lexical.lexical_hits(index, df, **limits or {}).collect()
    docs = [(r[0], r[3]) for r in rows]
    want = {(q, c): s for q, text, _ in asked for c, s in brute_bm25(docs, text).items()}
    got = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in hits}
    assert got.keys() == want.keys() and len(hits) == len(got) > 60
    for key, score in want.items():
        assert got[key] == pytest.approx(score, abs=1e-12)
    assert {q for q, _ in got} == {"q0", "q1", "q2", "q3", "q7"}


def test_many_question_terms_leave_the_literal_path(library, questions, monkeypatch):
    _, chunks = library
    index = lexical.index_chunks(chunks)
    plain = pairs(lexical.lexical_hits(index, questions[1]), "chunk_id")
    monkeypatch.setattr(lexical, "MAX_LITERAL_TERMS", 1)
    assert pairs(lexical.lexical_hits(index, questions[1]), "chunk_id") == plain


def test_punctuation_heavy_questions(spark):
    chunks = spark.createDataFrame([("c", "Leadership principles and team alignment.")], "chunk_id string, content string")
    df = spark.createDataFrame([("a", "`"), ("b", '`leadership` "team"')], "query_id string, question string")
    assert pairs(lexical.lexical_top_k(lexical.index_chunks(chunks), df, 5), "chunk_id") == [("b", "c")]


def test_term_statistics(spark):
    index = spark.createDataFrame([("1", ["a", "b", "a"]), ("2", ["a"])], "chunk_id string, doc_tokens array<string>")
    rows = {r["term"]: (r["df"], r["cf"]) for r in lexical.term_statistics(index).collect()}
    assert rows == {"a": (2, 3), "b": (1, 1)}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def test_fusion_uses_ranks_only(spark):
    vector = ranked(spark, [("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("q", "v", 0.1, 3)])
    words = ranked(spark, [("q", "b", 0.8, 1), ("q", "a", 0.7, 2), ("q", "w", 0.1, 3)])
    fused = fusion.fuse(vector, words, 0.3, 0.7).orderBy("rank").collect()
    assert [r["chunk_id"] for r in fused] == ["b", "a", "w", "v"]
    assert fused[0]["score"] == pytest.approx(0.3 / 2 + 0.7)
    tied = fusion.fuse(vector, words, 0.5, 0.5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tied] == ["a", "b", "v", "w"]


def test_cap_per_file(spark):
    rows = [("q", c, f, r) for r, (c, f) in enumerate([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], 1)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, file_path string, rank int")
    assert pairs(fusion.cap_per_file(df), "chunk_id", "rank") == [("q", "a", 1), ("q", "b", 2), ("q", "d", 3)]


def test_mmr_prefers_diversity_and_passes_small_pools(spark):
    pool = spark.createDataFrame(
        [("q", "a", 0.9, 1, [1.0, 0.0]), ("q", "b", 0.85, 2, [0.99, 0.0]), ("q", "c", 0.8, 3, [0.0, 1.0]),
         ("p", "x", 0.1, 1, [1.0]), ("p", "y", 0.9, 2, [1.0])],
        "query_id string, chunk_id string, score double, rank int, embedding array<double>",
    )
    got = pairs(diversify(pool, 2, 0.5), "rank", "chunk_id")
    assert got == [("p", 1, "x"), ("p", 2, "y"), ("q", 1, "a"), ("q", 2, "c")]


def brute_pack(rows, budget):
    left, taken, seen = budget, [], set()
    for _, chunk_id, cost in sorted(rows):
        if chunk_id in seen or (taken and left - cost < 0):
            continue
        taken.append(chunk_id)
        seen.add(chunk_id)
        left -= cost
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_packing_matches_a_sequential_fold(spark, seed):
    rng = random.Random(seed)
    lists = {f"q{n}": [(r, f"c{rng.randrange(150)}", rng.choice([1, 1, 3, 7, 30, 90])) for r in range(200)] for n in range(3)}
    lists["big"] = [(0, "first", 500), (1, "second", 1)]
    costs = {}
    rows = []
    for q, entries in lists.items():
        lists[q] = [(r, c, costs.setdefault((q, c), cost)) for r, c, cost in entries]
        rows += [(q, c, r, cost, "x") for r, c, cost in lists[q]]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, tokens int, content string")
    got = packing.pack(df, 60).orderBy("query_id", "label").collect()
    for q, entries in lists.items():
        assert [r["chunk_id"] for r in got if r["query_id"] == q] == brute_pack(entries, 60)


def test_packing_counts_content_without_token_count(spark):
    df = spark.createDataFrame(
        [("q", "a", 1, 0, "one two three"), ("q", "b", 2, 0, "x"), ("q", "c", 3, 5, "y")],
        "query_id string, chunk_id string, rank int, tokens int, content string",
    )
    assert pairs(packing.pack(df, 4), "chunk_id", "label") == [("q", "a", 1), ("q", "b", 2)]


def test_context_text_and_citations(spark):
    df = spark.createDataFrame(
        [("q", "a", "f.md", ["T", "H"], "one", 1), ("q", "b", "g.md", ["G"], "two", 2)],
        "query_id string, chunk_id string, file_path string, heading_path array<string>, content string, label int",
    )
    row = packing.contexts(df).first()
    assert row["context"] == "[C1] f.md | T > H\none\n\n---\n\n[C2] g.md | G\ntwo"
    assert row["citation_lines"] == "[C1] f.md | T > H\n[C2] g.md | G"
    assert row["citations"] == {"a": "C1", "b": "C2"} and row["paths"] == ["f.md", "g.md"]


def test_merging_takes_the_best_score_and_first_position(spark):
    base = ranked(spark, [("q", "a", 0.5, 1), ("q", "b", 0.4, 2)])
    extra = ranked(spark, [("q", "c", 0.5, 1), ("q", "b", 0.9, 2), ("q", "a", 0.1, 3)])
    got = pairs(fusion.merge_results(base, extra), "rank", "chunk_id", "score")
    assert got == [("q", 1, "b", 0.9), ("q", 2, "a", 0.5), ("q", 3, "c", 0.5)]
    waves = base.withColumn("wave", F.lit(0)).unionByName(extra.withColumn("wave", F.lit(2)))
    assert pairs(fusion.merge_waves(waves), "rank", "chunk_id", "score") == got
    alone = ranked(spark, [("q", "x", 0.1, 1), ("q", "y", 0.9, 2)]).withColumn("wave", F.lit(0))
    assert pairs(fusion.merge_waves(alone), "rank", "chunk_id") == [("q", 1, "x"), ("q", 2, "y")]


class Ranker(StandIn):
    def generate(self, prompt, model, options):
        return '["c", "nobody", "a", "c"]' if "Content:" in prompt else "not json"


def test_rerank_orders_by_response_and_keeps_the_rest(spark):
    df = spark.createDataFrame(
        [("q", i, 0.1, n, "f", ["H"], i, 1) for n, i in enumerate("abcd", 1)] + [("one", "z", 0.1, 1, "f", ["H"], "z", 1)],
        "query_id string, chunk_id string, score double, rank int, file_path string, heading_path array<string>,"
        " content string, tokens int",
    )
    asked = spark.createDataFrame([("q", "?"), ("one", "?")], "query_id string, question string")
    got = pairs(rerank(df, asked, "{{chunks}}", Ranker()), "rank", "chunk_id")
    assert got == [("one", 1, "z"), ("q", 1, "c"), ("q", 2, "a"), ("q", 3, "c"), ("q", 4, "b"), ("q", 5, "d")]


def test_top_k_and_salted_joins_with_a_hot_key(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i}", f"r{i:03}", i % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id string, v int")
    got = sizing.top_k(df, ["g"], [F.desc("v"), F.asc("id")], 4, spread="id").where("g = 'hot'").orderBy("rank")
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))[:4]
    assert [r["id"] for r in got.collect()] == [r[1] for r in want]
    small = df.select("g").distinct().withColumn("name", F.upper("g"))
    plain = sorted(map(tuple, df.join(small, "g").select("g", "id", "name").collect()))
    salted = sizing.salted_join(df, small, ["g"], "id").select("g", "id", "name")
    assert sorted(map(tuple, salted.collect())) == plain
    monkeypatch.setattr(sizing, "HOT_ROWS", 10)
    hot = sizing.hot_join(df, small, ["g"], "id").select("g", "id", "name")
    assert sorted(map(tuple, hot.collect())) == plain


def test_filters_apply_before_the_vector_cut_and_after_the_lexical_one(library, questions):
    rows, chunks = library
    config = Config(
        features=Features(mmr_diversification=False),
        retrieval=Retrieval(vector_top_k=3, lexical_top_k=5, rerank_top_n=50),
    )
    only_code = retrieve(chunks, questions[1].where("query_id = 'q0'"), config, 10**12, Filters(chunk_types=["code"]))
    docs = [(r[0], r[3]) for r in rows]
    best = sorted(brute_bm25(docs, "alpha").items(), key=lambda kv: (round(kv[1], 12), kv[0]))[:5]
    kinds = {r[0]: r[5] for r in rows}
    lexical_ids = {c for c, _ in best if kinds[c] == "code"}
    got = {r["chunk_id"] for r in only_code.collect()}
    assert all(kinds[c] == "code" for c in got)
    assert len(got - lexical_ids) <= 3 and (lexical_ids - got) == set() or len(got) >= 3
    prefix = Filters(path_prefix="hot", tags=["t0", "t1"])
    assert {r["file_path"] for r in retrieve(chunks, questions[1], config, 0, prefix).collect()} == {"hot.md"}


def test_evaluation_rules(spark):
    cases = spark.createDataFrame(
        [("a", ["x", "y", "x"], ["x", "z"]), ("b", ["x"], []), ("c", [], ["x"]), ("d", [], [])],
        "query_id string, paths array<string>, expected_paths array<string>",
    )
    got = {r["query_id"]: (r["recall"], r["citation_accuracy"]) for r in evaluate.score_cases(cases, 2).collect()}
    assert got == {"a": (0.5, 2 / 3), "b": (1, 1), "c": (0, 0), "d": (1, 0)}
    none = evaluate.metrics(evaluate.score_cases(cases.limit(0), 2)).first()
    assert tuple(none) == (0, 0)


class Talker(StandIn):
    """Rewrites to one other search and asks one follow-up."""

    def generate(self, prompt, model, options):
        if prompt.startswith("REWRITE"):
            return '["beta gamma"]'
        if prompt.startswith("GAP"):
            return "* omega\n\n"
        return "ANSWER " + prompt


def test_answer_loop_merges_waves_and_sorts_by_score(spark, library):
    from dataclasses import replace

    rows, chunks = library
    prompts = replace(Config().prompts, query_rewrite="REWRITE {{question}}", iterative_gap="GAP {{context}}", qa="{{question}}|{{context}}|C{{index}}")
    config = Config(prompts=prompts, features=Features(reranking=False))
    client = Talker(dimension=8)
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, question string")
    row = answer(chunks, asked, client, config, 10**12).first()
    texts = spark.createDataFrame([("1", "alpha"), ("2", "beta gamma"), ("3", "omega")], "query_id string, question string")
    from notelode.models import embed_questions

    found = retrieve(chunks, embed_questions(texts, client), config, 10**12).collect()
    best = {}
    for wave in "123":
        for r in sorted((r for r in found if r["query_id"] == wave), key=lambda r: r["rank"]):
            if r["chunk_id"] not in best or r["score"] > best[r["chunk_id"]][0]:
                best[r["chunk_id"]] = (r["score"], r)
        if wave != "1":
            best = dict(sorted(best.items(), key=lambda kv: -kv[1][0]))
    order = [(n, c, r["tokens"]) for n, (c, (_, r)) in enumerate(best.items())]
    want = brute_pack(order, 1800)
    labels = sorted(row["citations"].items(), key=lambda kv: int(kv[1][1:]))
    assert [c for c, _ in labels] == want
    assert row["answer"].startswith("ANSWER alpha|[C1] ") and row["answer"].endswith("|C")
    cases = spark.createDataFrame([("q", "alpha", row["paths"])], "query_id string, question string, expected_paths array<string>")
    scores = run_evaluation(chunks, cases, client, config, 10**12).first()
    assert scores["citation_accuracy"] == 1.0 and 0 < scores["recall_at_k"] <= 1
