"""Small probes of single failures that the catalogue's data do not hold."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from notelode.config import Config, Models
from notelode.functions import frontmatter as fm
from notelode.models import StandIn, ask, embed_questions
from notelode.operators.packing import pack
from notelode.operators.rerank import rerank
from notelode.operators.vector import vector_top_k
from notelode.plans import writers
from notelode.plans.index_run import index_notes
from notelode.sources.store import NoteStore

RANKED = "query_id string, chunk_id string, rank int, tokens int, content string"
NOTE = "file_path string, mtime long, markdown string"
LONG = "words that make a note long enough to be taken up by every writer " * 8


class Counting(StandIn):
    """Writes a line for each call to a file; texts with ``fail`` in them raise."""

    def __init__(self, log, fail="never so"):
        super().__init__(8)
        object.__setattr__(self, "log", log)
        object.__setattr__(self, "fail", fail)

    def _note(self, what, text):
        with open(self.log, "a") as out:
            out.write(what + "\n")
        if self.fail in text:
            raise RuntimeError("down for this one\nmore")

    def embed(self, texts, model):
        self._note("embed", " ".join(texts))
        return super().embed(texts, model)

    def generate(self, prompt, model, options):
        self._note("generate", prompt)
        return json.dumps(["b", "a"]) if prompt.startswith("ID: ") else super().generate(prompt, model, options)


@pytest.fixture
def log():
    path = os.path.join(tempfile.mkdtemp(), "log")
    open(path, "w").close()
    return path


def calls(path, what):
    return sum(line.strip() == what for line in open(path))


def loop(rows, budget):
    left, taken = budget, []
    for chunk, cost in rows:
        if not taken or left - cost >= 0:
            left -= cost
            taken.append(chunk)
    return taken


@pytest.mark.parametrize("first", [1, 100, 101])
def test_rows_without_cost_are_all_admitted_unless_the_first_overdraws(spark, first):
    rows = [("first", first)] + [(f"z{i}", 0) for i in range(3000)] + [(f"c{i}", 1 + i % 40) for i in range(60)]
    df = spark.createDataFrame([("q", c, i, n, " " if n == 0 else "x") for i, (c, n) in enumerate(rows)], RANKED)
    got = pack(df, 100).orderBy("label").collect()
    assert [r.chunk_id for r in got] == loop(rows, 100)
    assert [r.label for r in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("limit", [2048, 1])
def test_null_elements_count_as_zero_and_nan_scores_come_last(spark, limit):
    nan = float("nan")
    rows = [(f"c{i:03}", [float(i), 1.0]) for i in range(100)] + [(f"n{i}", [nan, 1.0]) for i in range(5)] + [("null", [250.0, None])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, vector array<double>")
    got = vector_top_k(chunks, asked, 5, max_questions=limit).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got if r.query_id == "a"] == ["null", "c099", "c098", "c097", "c096"]
    whole = vector_top_k(chunks, asked, 200, max_questions=limit).where("query_id = 'a'").orderBy("rank").collect()
    assert len(whole) == 106 and [r.chunk_id for r in whole[-5:]] == [f"n{i}" for i in range(5)]
    assert all(r.score != r.score for r in whole[-5:])


def test_a_list_is_reranked_by_one_call(spark, log):
    rows = [(q, c, 0.1, n, "f", ["H"], c, 1) for q in ("q1", "q2") for n, c in enumerate("abc", 1)]
    df = spark.createDataFrame(
        rows, "query_id string, chunk_id string, score double, rank int, file_path string, heading_path array<string>,"
        " content string, tokens int",
    )
    asked = spark.createDataFrame([("q1", "?"), ("q2", "?")], "query_id string, question string")
    done = rerank(df, asked, "{{chunks}}", Counting(log))
    packed = pack(done, 100)
    got = sorted((r.query_id, r.label, r.chunk_id) for r in packed.collect())
    assert got == [(q, n, c) for q in ("q1", "q2") for n, c in enumerate("bac", 1)]
    assert calls(log, "generate") == 2


@pytest.mark.parametrize("limit", [2048, 1])
def test_notes_are_embedded_once_whatever_their_number(spark, log, monkeypatch, limit):
    monkeypatch.setattr("notelode.operators.vector.related_files.__defaults__", (limit,))
    notes = spark.createDataFrame([(f"n{i}.md", 1, LONG + str(i)) for i in range(4)], NOTE)
    chunks = spark.createDataFrame([("c", "x.md", [1.0] * 8)], "chunk_id string, file_path string, embedding array<double>")
    config = Config(models=Models(embedding_batch_size=1))
    got = writers.related(notes, chunks, Counting(log), 0, config).collect()
    assert {r.status for r in got} == {"updated"} and calls(log, "embed") == 4 and calls(log, "generate") == 4


def test_questions_are_embedded_once(spark, log):
    asked = spark.createDataFrame([("a", "one"), ("b", "two")], "query_id string, question string")
    df = embed_questions(asked, Counting(log), batch_size=1)
    assert df.count() == 2 and len(df.collect()) == 2 and calls(log, "embed") == 2


def test_a_failing_call_fails_its_own_note(spark, log):
    notes = spark.createDataFrame([("good.md", 1, LONG), ("bad.md", 1, LONG + "unlucky")], NOTE)
    for step in (
        lambda client: writers.summarize(notes, client, 0),
        lambda client: writers.tag(notes, client),
        lambda client: writers.rework(notes.withColumn("mtime_ms", F.lit(0.0)).withColumn("birth_ms", F.lit(0.0)), client),
    ):
        got = {r.file_path: (r.status, r.message) for r in step(Counting(log, "unlucky")).collect()}
        assert got["good.md"][0] == "updated" and got["bad.md"] == ("failed", "down for this one")
    one = ask(notes, F.col("markdown"), Counting(log, "unlucky")).collect()
    assert {r.file_path: r.reply_error for r in one} == {"good.md": None, "bad.md": "down for this one"}


def test_an_index_run_goes_on_past_a_failing_note(spark, log):
    store = NoteStore(spark, tempfile.mkdtemp() + "/index", buckets=4)
    notes = spark.createDataFrame([("good.md", 1, "# A\nfine"), ("bad.md", 1, "# A\nunlucky")], NOTE)
    config = Config(models=Models(embedding_batch_size=1))
    stats = index_notes(store, notes, Counting(log, "unlucky"), config).first()
    assert (stats.total_files, stats.failed, stats.chunks_upserted) == (2, 1, 1) and stats.duration_ms > 0
    assert [r.path for r in store.files().collect()] == ["good.md"]
    index_notes(store, notes, Counting(log), config)
    assert sorted(r.path for r in store.files().collect()) == ["bad.md", "good.md"]


def test_odd_frontmatter_is_an_error_of_its_note(spark):
    sources = ["a: !!int foo", "a: &a [*a]", 'a: "\\ud800"', "a: 1\na: 2", "a: .inf\nb: .nan\nc: 1", "ok: yes"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string")
    got = {r.i: r.f for r in df.select("i", fm.yaml_facets(F.col("s")).alias("f")).collect()}
    assert all(got[i]["error"] for i in range(4))
    assert json.loads(got[4]["json"]) == {"a": None, "b": None, "c": 1} and got[4]["error"] is None
    assert got[5]["error"] is None


def test_the_stored_number_of_buckets_is_followed(spark):
    root = tempfile.mkdtemp() + "/index"
    notes = spark.createDataFrame([(f"n{i}.md", 1, f"# A\nword{i}") for i in range(20)], NOTE)
    index_notes(NoteStore(spark, root, buckets=4), notes, StandIn(4))
    again = NoteStore(spark, root, buckets=64)
    assert again.buckets == 4
    changed = notes.withColumn("mtime", F.when(F.col("file_path") == "n3.md", 2).otherwise(1))
    index_notes(again, changed.withColumn("mtime", F.col("mtime").cast("long")), StandIn(4))
    assert again.chunks().count() == again.files().count() == 20
    assert again.chunks_by_file("n7.md").count() == 1


def test_commits_keep_the_former_state_readable_and_prune_buckets(spark):
    store = NoteStore(spark, tempfile.mkdtemp() + "/index", buckets=8)
    notes = spark.createDataFrame([(f"n{i}.md", 1, f"# A\nword{i} common") for i in range(20)], NOTE)
    index_notes(store, notes, StandIn(4))
    before = store.chunks()
    index_notes(store, notes.withColumn("mtime", F.col("mtime") + 1), StandIn(4))
    assert before.count() == 20
    one = store.chunks_of(spark.createDataFrame([("n3.md",)], "file_path string"))
    paths = {f.rsplit("/", 2)[1] for f in one.inputFiles()}
    assert len(paths) == 1 and one.count() == 1
    index = store.lexical_index()
    assert index.where("term = 'common'").count() == 20 and index.where("term = 'word3'").count() == 1
    store.delete_files(spark.createDataFrame([("n3.md",)], "path string"))
    assert store.lexical_index().where("term = 'word3'").count() == 0


def test_written_notes_keep_their_mode(spark):
    root = tempfile.mkdtemp()
    path = os.path.join(root, "a.md")
    open(path, "w").close()
    os.chmod(path, 0o640)
    rows = [("a.md", "updated", None, "new"), ("../b.md", "updated", None, "out"), ("sub/c.md", "updated", None, "made")]
    df = spark.createDataFrame(rows, "file_path string, status string, message string, new_markdown string")
    got = {r.file_path: r.status for r in writers.write_notes(df, root).collect()}
    assert got == {"a.md": "updated", "../b.md": "failed", "sub/c.md": "updated"}
    assert open(path).read() == "new" and os.stat(path).st_mode & 0o777 == 0o640
    assert sorted(os.listdir(root)) == ["a.md", "sub"]
