"""Index runs, the store, the folder source, writers, journal and hygiene."""

import os
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notelode import config as C
from notelode.functions.markers import BLOCK_END, BLOCK_START
from notelode.models import HttpClient, StandIn, embedding, response
from notelode.operators import hygiene, journal, sizing
from notelode.operators.lineage import cut
from notelode.plans import index_run, writers
from notelode.schema import STORED_COLUMNS
from notelode.sources import store as store_module
from notelode.sources.store import NoteStore
from notelode.sources.vault import list_notes, read_eval_cases, read_notes, scan_vault
from notelode.streaming.incremental import index_stream

NOW = 1_735_689_600_000
NOTE = "file_path string, mtime long, markdown string"


class Counting(StandIn):
    """Writes one line per embedded text to a file."""

    def __init__(self, log):
        super().__init__(8)
        object.__setattr__(self, "log", log)

    def embed(self, texts, model):
        with open(self.log, "a") as out:
            out.writelines("x\n" for _ in texts)
        return super().embed(texts, model)


def fresh_dir():
    return tempfile.mkdtemp(prefix="notelode-tests-")


def write(root, path, text, mtime=None):
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    if mtime is not None:
        os.utime(target, (mtime, mtime))


def test_folder_scan(spark):
    root = fresh_dir()
    for path in ("a.md", "b.MD", "_x/.hid/c.md", ".obsidian/n.md", "d/.git/n.md", "d/.trash/n.md", "t.txt", "d/e/f/g/h.md"):
        write(root, path, "é " + path, 1000.9)
    rows = {r["file_path"]: r for r in scan_vault(spark, root).collect()}
    assert set(rows) == {"a.md", "b.MD", "_x/.hid/c.md", "d/e/f/g/h.md"}
    assert rows["a.md"]["markdown"] == "é a.md" and rows["a.md"]["mtime"] == 1000


def test_second_run_embeds_nothing_and_changes_are_followed(spark):
    root, log = fresh_dir(), os.path.join(fresh_dir(), "log")
    open(log, "w").close()
    client = Counting(log)
    store = NoteStore(spark, fresh_dir() + "/index", buckets=4)
    calls = lambda: sum(1 for _ in open(log))

    write(root, "one.md", "# One\nalpha\n\n- beta", 100)
    write(root, "two.md", "# Two\ngamma", 100)
    write(root, "bad.md", "---\na: [\n---\nx", 100)
    write(root, "empty.md", "", 100)
    first = index_run.index_vault(spark, store, root, client).drop("duration_ms").first().asDict()
    assert first == dict(total_files=4, processed=3, skipped=0, removed=0, failed=1, chunks_upserted=3, chunks_deleted=0)
    assert calls() == 3 and store.chunks().count() == 3
    assert {r["path"]: r["chunk_count"] for r in store.files().collect()} == {"one.md": 2, "two.md": 1}

    again = index_run.index_vault(spark, store, root, client).drop("duration_ms").first().asDict()
    # Notes without chunks never get a state, so they are looked at again.
    assert (again["skipped"], again["processed"], again["failed"], calls()) == (2, 1, 1, 3)

    write(root, "one.md", "# One\nalpha", 200)
    os.remove(os.path.join(root, "two.md"))
    third = index_run.index_vault(spark, store, root, client).drop("duration_ms").first().asDict()
    assert (third["removed"], third["chunks_deleted"], third["chunks_upserted"], calls()) == (1, 2, 1, 3)
    assert [(r["file_path"], r["content"]) for r in store.chunks().collect()] == [("one.md", "alpha")]
    assert [(r["path"], r["mtime"]) for r in store.files().collect()] == [("one.md", 200)]

    write(root, "one.md", "---\ntags: [new]\n---\n# One\nalpha", 300)
    index_run.index_vault(spark, store, root, client)
    row = store.chunks().first()
    assert calls() == 3 and row["tags"] == ["new"]  # same content keeps the old vector
    write(root, "one.md", "# One\nchanged", 400)
    index_run.index_vault(spark, store, root, client)
    assert calls() == 4 and store.chunks_by_file("one.md").count() == 1


def stored(spark, rows):
    full = [(i, p, "T", ["T"], n, "text", [], [], "{}", m, "c", "r", h, 1, [1.0]) for i, p, n, m, h in rows]
    from notelode.schema import STORED_COLUMNS, ddl

    return spark.createDataFrame(full, ddl(STORED_COLUMNS))


def test_store_upserts_and_deletes(spark):
    store = NoteStore(spark, fresh_dir() + "/index", buckets=3)
    assert store.chunks().count() == 0 and store.files().count() == 0
    store.upsert_chunks(stored(spark, [("a", "x.md", 1, 5, "h1"), ("b", "x.md", 2, 7, "h2"), ("c", "y.md", 1, 1, "h3")]))
    files = {r["path"]: tuple(r) for r in store.files().collect()}
    assert files["x.md"] == ("x.md", 7, 2, "h1:h2")
    store.upsert_chunks(stored(spark, [("a", "x.md", 1, 9, "new")]))
    assert {r["chunk_id"]: r["content_hash"] for r in store.chunks().collect()} == {"a": "new", "b": "h2", "c": "h3"}
    store.delete_chunks(spark.createDataFrame([("b",)], "chunk_id string"))
    assert {r["chunk_id"] for r in store.chunks().collect()} == {"a", "c"} and store.files().count() == 2
    store.delete_files(spark.createDataFrame([("x.md",)], "path string"))
    assert [r["chunk_id"] for r in store.chunks().collect()] == ["c"]
    assert [r["path"] for r in store.indexed_paths().collect()] == ["y.md"]
    store.drop()
    assert store.chunks().count() == 0


def _above_the_scan(frame, table):
    """Names of the operators between the write and the scan of ``table``, from the plan's tree."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    lines = lines[: next((i for i, line in enumerate(lines) if "Initial Plan" in line), len(lines))]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and f"/{table}/" in line)
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            out.append(line.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0])
    return out


def test_a_commit_does_not_shuffle_stored_chunks(spark):
    store = NoteStore(spark, fresh_dir() + "/index", buckets=3, files_per_bucket=1)
    rows = [(f"c{i:03}", f"n{i % 40}.md", i, 5, f"h{i}") for i in range(200)]
    store.upsert_chunks(stored(spark, rows))
    change = stored(spark, [("c007", "n7.md", 7, 6, "new"), ("x", "n7.md", 300, 6, "added")])
    few = lambda: sizing.few(change.select("chunk_id"), "chunk_id")
    after = lambda: store._after("chunks", STORED_COLUMNS, "chunk_id", "file_path", change, few(), {0, 1, 2}, ("file_path", "ordinal"))
    above = _above_the_scan(after(), "chunks")
    assert "BroadcastHashJoin" in above and not any("Exchange" in name for name in above), above
    want = {i: h for i, _, _, _, h in rows} | {"c007": "new", "x": "added"}
    assert {r["chunk_id"]: r["content_hash"] for r in after().collect()} == want
    store.upsert_chunks(change)
    assert {r["chunk_id"]: r["content_hash"] for r in store.chunks().collect()} == want


def test_many_keys_meet_in_a_shuffle_and_crowded_buckets_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(sizing, "MAX_BROADCAST_KEYS", 1)
    monkeypatch.setattr(store_module, "CROWD", 1)
    store = NoteStore(spark, fresh_dir() + "/index", buckets=2, files_per_bucket=1)
    want, most = {}, 0
    for turn in range(4):
        rows = [(f"c{i}", f"n{i % 5}.md", i, turn, f"h{turn}.{i}") for i in range(turn, turn + 10)]
        store.upsert_chunks(stored(spark, rows))
        want |= {r[0]: r[4] for r in rows}
        folders = [Path(store.root) / "chunks" / f"v={v}" / f"bucket={b}" for b, v in store._versions("chunks").items()]
        most = max(most, *(len(list(f.glob("*.parquet"))) for f in folders))
        assert {r["chunk_id"]: r["content_hash"] for r in store.chunks().collect()} == want
    assert most == 2
    held = store.lexical_index().select("chunk_id").distinct().count()
    assert held == len(want)


def test_an_index_run_leaves_no_settled_table(spark):
    store = NoteStore(spark, fresh_dir() + "/index", buckets=2)
    notes = spark.createDataFrame([("a.md", 1, "# A\ntext"), ("b.md", 1, "---\n: [\n---\n")], "file_path string, mtime long, markdown string")
    index_run.index_notes(store, notes, StandIn())
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert not list(shared.glob("embedded-*")) and store.chunks().count() > 0


def test_stream_indexes_new_notes(spark):
    source, store = fresh_dir(), NoteStore(spark, fresh_dir() + "/index", buckets=2)
    checkpoint = fresh_dir()

    def run():
        notes = spark.readStream.schema(NOTE).parquet(source)
        index_stream(notes, store, StandIn(8), checkpoint).awaitTermination()

    spark.createDataFrame([("a.md", 1, "# A\nx"), ("b.md", 1, "# B\ny")], NOTE).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("a.md", 2, "# A\nz")], NOTE).write.mode("append").parquet(source)
    run()
    assert {r["file_path"]: r["content"] for r in store.chunks().collect()} == {"a.md": "z", "b.md": "y"}


class Flaky(StandIn):
    def __init__(self, log, failures):
        super().__init__(4)
        object.__setattr__(self, "log", log)
        object.__setattr__(self, "failures", failures)

    def embed(self, texts, model):
        with open(self.log, "a") as out:
            out.write("x")
        if os.path.getsize(self.log) <= self.failures:
            raise RuntimeError("down")
        return super().embed(texts, model)[: len(texts) - ("short" in texts)]


def test_embedding_retries_batches_and_missing_vectors(spark):
    df = spark.createDataFrame([("a b",), ("short",)], "t string").coalesce(1)
    log = os.path.join(fresh_dir(), "log")
    rows = df.select(embedding(F.col("t"), Flaky(log, 2), batch_size=2, pause=0.0).alias("v")).collect()
    assert sum(x * x for x in rows[0]["v"]["value"]) == pytest.approx(1) and rows[1]["v"]["value"] is None
    assert [r["v"]["error"] for r in rows] == [None, None]
    assert os.path.getsize(log) == 3
    log = os.path.join(fresh_dir(), "log")
    rows = df.select(embedding(F.col("t"), Flaky(log, 3), batch_size=8, pause=0.0).alias("v")).collect()
    assert [(r["v"]["value"], r["v"]["error"]) for r in rows] == [(None, "down")] * 2


def test_http_client_payloads(monkeypatch):
    import io
    import json

    seen = []

    def fake(request, timeout):
        seen.append((request.full_url, json.loads(request.data)))
        return io.BytesIO(json.dumps({"embeddings": [[1.0]], "response": "hi"}).encode())

    monkeypatch.setattr("urllib.request.urlopen", fake)
    client = HttpClient("http://host/")
    assert client.embed(["a"], "m") == [[1.0]]
    assert client.generate("p", "m", {"temperature": 0}) == "hi"
    assert seen[0] == ("http://host/api/embed", {"model": "m", "input": ["a"]})
    assert seen[1][1] == {"model": "m", "prompt": "p", "stream": False, "options": {"temperature": 0}}


def test_hygiene_rules(spark):
    notes = {
        "clean.md": "---\nsummary: s\n---\n# A\n\ntext",
        "bare.md": "text only",
        "tight.md": "---\na: 1\n---\n# A\ntext\n### summary of things",
        "long.md": "---\na: 1\n---\n# Summary\n\n" + "w " * 20,
        "blank.md": "---\nsummary: '  '\n---\n##### Summary\n\nx",
    }
    df = spark.createDataFrame([(p, 0, t) for p, t in notes.items()], NOTE)
    found = {}
    for row in hygiene.note_issues(df, max_tokens=5).orderBy("path", "seq").collect():
        found.setdefault(row["path"], []).append(row["type"])
    assert found == {
        "bare.md": ["missing_frontmatter", "no_headings", "missing_summary"],
        "tight.md": ["separator"],
        "long.md": ["long_section"],
        # "##### Summary" still contains "### Summary": the check is not anchored.
    }


def brute_history(target, notes, now, days, snippet, cap):
    folder = os.path.dirname(target)
    entries = []
    for path, mtime, text in notes:
        if path == target or os.path.dirname(path) != folder or mtime < now - days * 86_400_000 or not text.strip():
            continue
        content = "User entry:\n\n" + text.strip()
        cut = content if len(content) <= snippet else content[:snippet].rstrip() + "\n..."
        stamp = __import__("datetime").datetime.fromtimestamp(mtime / 1000, __import__("datetime").timezone.utc)
        block = f"File: {os.path.basename(path)}\nModified: {stamp.strftime('%Y-%m-%dT%H:%M:%S.')}{mtime % 1000:03}Z\n\n{cut}"
        entries.append((-mtime, path, block))
    total, out = 0, []
    for _, _, block in sorted(entries):
        if total + len(block) > cap:
            break
        total += len(block)
        out.append(block)
    return "\n\n---\n\n".join(out)


def test_journal_history_matches_a_loop_over_a_crowded_folder(spark, monkeypatch):
    from notelode.operators import sizing

    monkeypatch.setattr(sizing, "HOT_ROWS", 20)
    rng = random.Random(1)
    notes = [
        (f"{'hot' if i % 3 else f'd{i % 5}'}/n{i:03}.md", NOW - rng.randrange(40 * 86_400_000), "w " * rng.randrange(90))
        for i in range(120)
    ]
    df = spark.createDataFrame(notes, "file_path string, mtime_ms long, markdown string")
    got = {r["file_path"]: r["recent_entries"] for r in journal.recent_entries(df, df, NOW, 30, 60, 700).collect()}
    assert got == {p: brute_history(p, notes, NOW, 30, 60, 700) for p, _, _ in notes}


class Fixed(StandIn):
    def __init__(self, text):
        super().__init__(8)
        object.__setattr__(self, "text", text)

    def generate(self, prompt, model, options):
        return self.text


def test_writers_report_and_replace(spark):
    long = "word " * 60
    old = f"{long}\n\n{BLOCK_START}\nAI Summary\n\nold\n{BLOCK_END}\n"
    rows = [("a.md", 1, old), ("short.md", 1, "tiny"), ("bad.md", 1, "---\na: [\n---\n" + long)]
    notes = spark.createDataFrame(rows, NOTE)
    got = {r["file_path"]: r for r in writers.summarize(notes, Fixed(" new \n"), NOW).collect()}
    assert [got[p]["status"] for p in ("a.md", "short.md", "bad.md")] == ["updated", "skipped", "failed"]
    assert got["a.md"]["new_markdown"] == (
        f"{long.rstrip()}\n\n{BLOCK_START}\nAI Summary\n\nGenerated: 2025-01-01T00:00:00.000Z\n\nnew\n{BLOCK_END}\n\n"
    )
    tagged = {r["file_path"]: r for r in writers.tag(notes, Fixed('["One", "two", "one"]')).collect()}
    assert tagged["a.md"]["new_markdown"].startswith('---\ntags:\n  - "#one"\n  - "#two"\n---\nword ')
    none = {r["file_path"]: r for r in writers.tag(notes, Fixed("!!")).collect()}
    assert none["a.md"]["status"] == "failed"
    same = writers.tag(spark.createDataFrame([("t.md", 1, "---\ntags: [one]\n---\n" + long)], NOTE), Fixed("one")).first()
    assert same["status"] == "skipped"


def test_rework_guards_and_frontmatter(spark):
    rows = [("d/a.md", "old", 1000.0, 0.0)]
    notes = spark.createDataFrame(rows, "file_path string, markdown string, mtime_ms double, birth_ms double")
    new = writers.rework(notes, Fixed(f"{BLOCK_START}\nbody\n{BLOCK_END}")).first()
    assert new["new_markdown"] == "---\ntitle: a\ncreated: 1970-01-01T00:00:01.000Z\n---\nbody\n"
    assert writers.rework(notes, Fixed(f"{BLOCK_START}\n")).first()["status"] == "failed"
    kept = notes.withColumn("markdown", F.lit("---\na: 1\n---\nx\n\n"))
    assert writers.rework(kept, Fixed("---\na: 1\n---\nx")).first()["status"] == "skipped"


def test_enrich_is_its_steps_in_turn(spark):
    chunks = stored(spark, [("a", "x.md", 1, 5, "h1")]).withColumn("embedding", F.array(*[F.lit(1.0)] * 8))
    notes = spark.createDataFrame([("n.md", 1, "word " * 60)], NOTE)
    client = Fixed("reply")
    got = writers.enrich(notes, chunks, client, NOW).first()
    text = notes
    for step in (
        lambda n: writers.summarize(n, client, NOW), lambda n: writers.tag(n, client),
        lambda n: writers.related(n, chunks, client, NOW),
    ):
        text = cut(step(text)).select("file_path", F.lit(1).cast("long").alias("mtime"), F.col("new_markdown").alias("markdown"))
    assert got["new_markdown"] == text.first()["markdown"]
    assert got["message"] == "summary=updated tags=updated related=updated"


def test_written_notes_stay_below_the_root(spark):
    root = fresh_dir()
    rows = [("new/a.md", "updated", None, "text\n"), ("../out.md", "updated", None, "x"), ("s.md", "skipped", "short", None)]
    df = spark.createDataFrame(rows, "file_path string, status string, message string, new_markdown string")
    got = {r["file_path"]: r["status"] for r in writers.write_notes(df, root).collect()}
    assert got == {"new/a.md": "updated", "../out.md": "failed", "s.md": "skipped"}
    with open(os.path.join(root, "new/a.md")) as note:
        assert note.read() == "text\n"
    assert os.listdir(root) == ["new"] and os.listdir(os.path.join(root, "new")) == ["a.md"]
    with pytest.raises(PermissionError):
        writers.resolve_writable("/v/notes", "/v/notes-else/x.md")
    assert writers.resolve_writable("/v/notes", ".") == "/v/notes"


def test_eval_cases(spark):
    path = os.path.join(fresh_dir(), "cases.json")
    with open(path, "w") as out:
        out.write('[{"question": "a?", "expected_paths": ["x.md"]}, {"question": "b?"}]')
    rows = read_eval_cases(spark, path).collect()
    assert [(r["question"], r["expected_paths"]) for r in rows] == [("a?", ["x.md"]), ("b?", [])]
    assert len({r["query_id"] for r in rows}) == 2


def test_configuration(monkeypatch):
    path = os.path.join(fresh_dir(), "rag.config.yaml")
    monkeypatch.setenv("RAG_CONFIG_PATH", path)
    C.reset_config_cache()
    with pytest.raises(FileNotFoundError, match="no configuration"):
        C.load_config()
    open(path + ".example", "w").close()
    with pytest.raises(FileNotFoundError, match="copy"):
        C.load_config()
    with open(path, "w") as out:
        out.write("version: 2\npaths: {vault: v, database: d, log_level: loud}\nretrieval:\n  fusion_weights: {vector: 0.1}\n")
    loaded = C.load_config()
    assert (loaded.version, loaded.paths.log_level, loaded.retrieval.fusion_weights) == (2, "info", C.FusionWeights(0.1, 0.3))
    monkeypatch.setenv("RAG_LOG_LEVEL", "DEBUG")
    monkeypatch.setenv("DB_PATH", "other")
    assert C.load_config() is loaded
    C.reset_config_cache()
    assert (C.load_config().paths.log_level, C.load_config().paths.database) == ("debug", "other")
    C.reset_config_cache()


def test_limits_from_environment(monkeypatch):
    monkeypatch.setenv("TAG_MAX", "3")
    assert writers.Limits.from_env().tag_max == 3 and writers.Limits.from_env().related_top_k == 5
