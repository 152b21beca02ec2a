"""The folder data source and the chunker in SQL."""

import os
import time

import pytest
from pyspark.sql import functions as F

from notelode.config import Chunking
from notelode.operators.chunk_sql import CALL, chunk_notes_sql, line_table, register as register_chunks
from notelode.operators.chunking import chunk_notes
from notelode.sources.datasource import plan_folders, register
from notelode.sources.vault import scan_vault

NOTE = "file_path string, mtime long, markdown string"


@pytest.fixture
def vault(tmp_path):
    for at, name in enumerate(["a.md", "b.MD", "_c.md", ".d.md", "x/e.md", "x/y/f.md", "x/y/z/g.md", "n.txt", ".git/h.md", "q/i.md"]):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(f"text {at}\r\nä".encode())
        os.utime(path, (1000.5 + at, 1000.5 + at))
    return tmp_path


def listed(frame):
    return sorted(map(tuple, frame.select("file_path", "mtime", "mtime_ms", "markdown").collect()))


@pytest.mark.parametrize("limits", [(1, 1), (2, 2), (64, 10_000)])
def test_reads_what_the_scan_reads(spark, vault, limits):
    register(spark)
    read = spark.read.format("vault").option("partitions", limits[0]).option("files_per_task", limits[1]).load(str(vault))
    got = listed(read)
    assert len(got) == 8 and got == listed(scan_vault(spark, str(vault)))


def test_planning_opens_few_folders_and_splits_large_ones(vault):
    tasks = plan_folders(str(vault), 1, 3)
    assert sum(t.deep for t in tasks) == 2 and [t.parts for t in tasks if t.path == str(vault)] == [2, 2]


def test_empty_and_missing_folders(spark, tmp_path):
    register(spark)
    assert spark.read.format("vault").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="No such file"):
        spark.read.format("vault").load(str(tmp_path / "none")).count()


def test_written_notes_come_back(spark, vault):
    register(spark)
    new = spark.createDataFrame([("a.md", "new"), ("k/l.md", "ü\r\n"), ("k/empty.md", None)], "file_path string, markdown string")
    new.withColumn("extra", F.lit(1)).repartition(3).write.format("vault").mode("append").save(str(vault))
    got = {r["file_path"]: r["markdown"] for r in spark.read.format("vault").load(str(vault)).collect()}
    assert got["a.md"] == "new" and got["k/l.md"] == "ü\r\n" and got["k/empty.md"] == "" and len(got) == 10
    assert not [n for n in os.listdir(vault) if n.startswith(".drafts")]


@pytest.mark.parametrize("bad", [None, "../out.md"])
def test_a_failed_write_changes_nothing(spark, vault, bad):
    register(spark)
    before = listed(scan_vault(spark, str(vault)))
    rows = spark.createDataFrame([("a.md", "new"), ("new.md", "x"), (bad, "y")], "file_path string, markdown string")
    with pytest.raises(Exception):
        rows.repartition(3).write.format("vault").mode("append").save(str(vault))
    assert listed(scan_vault(spark, str(vault))) == before
    assert not [n for n in os.listdir(vault) if n.startswith(".drafts")] and not (vault.parent / "out.md").exists()


def test_stream_takes_each_change_once(spark, vault, tmp_path_factory):
    register(spark)
    seen, kept = [], str(tmp_path_factory.mktemp("offsets"))

    def drain():
        def take(batch, _):
            seen.extend(r["file_path"] for r in batch.collect())

        query = (
            spark.readStream.format("vault").load(str(vault)).writeStream.foreachBatch(take)
            .option("checkpointLocation", kept).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        query.stop()

    drain()
    assert len(seen) == 8
    (vault / "a.md").write_text("changed")
    past = time.time() - 0.5
    os.utime(vault / "a.md", (past, past))
    time.sleep(1.5)
    drain()
    assert len(seen) == 9 and seen[-1] == "a.md"


RICH = """---
title: T
tags: [a, b]
---
# One

para a b c

| x | y |
|---|---|

## Two

> quote
- item one
- item

```py
code
```

""" + "word " * 30 + "\n\n" + "more " * 20


@pytest.mark.parametrize("config", [Chunking(), Chunking(target_tokens=10, overlap_tokens=4, min_tokens=3, merge_small_chunks=True)])
def test_sql_chunks_equal_the_plan(spark, config):
    notes = spark.createDataFrame(
        [("a/r.md", 1, RICH), ("e.md", 2, ""), ("n.md", 3, None), ("bad.md", 4, "---\na: [\n---\ntext"), ("w.md", 5, " x " * 900)], NOTE
    )
    want, got = chunk_notes(notes, config), chunk_notes_sql(notes, config)
    assert got.schema == want.schema and got.count() > 3
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_plain_sql_may_call_it(spark):
    register_chunks(spark)
    line_table(spark.createDataFrame([("a.md", 1, "# H\n\nx y\n\n- z")], NOTE)).createOrReplaceTempView("note_lines")
    rows = spark.sql(f"SELECT c.ordinal, c.content, c.chunk_type FROM note_lines n, LATERAL {CALL} c ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(1, "x y", "text"), (2, "- z", "list")]
