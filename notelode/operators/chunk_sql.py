"""The chunker as a table function for SQL.

``line_table`` prepares notes in the JVM: lines, their classes and token counts. The registered
function cuts one note's lines into chunks and is used laterally::

    register(spark)
    line_table(notes).createOrReplaceTempView("note_lines")
    SELECT n.file_path, c.* FROM note_lines n,
      LATERAL note_chunks(n.lines, n.kinds, n.costs, n.headings, n.title, n.fallback) c

``chunking.with_ids`` turns such rows, with ``mtime``, ``tags`` and ``frontmatter`` beside them, into
rows of the chunk table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import text as T
from ..functions.tags import note_tags
from .chunking import line_columns, parse_notes, plan_note, with_ids

CALL = "note_chunks(n.lines, n.kinds, n.costs, n.headings, n.title, n.fallback)"
RETURNS = "ordinal int, note_title string, heading_path array<string>, content string, tokens int, chunk_type string"
_GAP = re.compile(f"[{T.SPACE_CHARS}]+")


def line_table(notes: DataFrame) -> DataFrame:
    """One row per note of ``notes(file_path, mtime, markdown)``; ``kinds`` is null where its YAML is invalid."""
    return parse_notes(notes).select(
        "file_path", F.col("mtime").cast("long").alias("mtime"),
        note_tags(F.col("front.tag_list"), F.col("front.tag_text")).alias("tags"),
        F.col("front.json").alias("frontmatter"), "lines",
        *(column.alias(name) for name, column in line_columns().items()),
    )


def chunk_texts(lines: list[str], plan: dict, overlap: int) -> list[str]:
    """Content of each chunk of a plan."""
    out = []
    for chunk in plan["chunks"]:
        parts = []
        for part in chunk["parts"]:
            text = "\n".join(lines[i] for i in part["lines"])
            if part["overlap"] and overlap > 0:
                text = " ".join([w for w in _GAP.split(text) if w][-overlap:])
            parts.append(text)
        out.append("\n\n".join(parts).strip(T.SPACE_CHARS))
    return out


def register(spark: SparkSession, config: Chunking | None = None, name: str = "note_chunks") -> None:
    """Make the chunker callable in SQL under ``name``; a null class string gives no rows."""
    config = config or Chunking()

    class NoteChunks:
        def eval(self, lines, kinds, costs, headings, title, fallback):
            if kinds is None:
                return
            plan = plan_note(kinds, [int(c) for c in costs], list(headings), title or "", fallback, config)
            texts = chunk_texts(list(lines), plan, config.overlap_tokens)
            for number, (chunk, text) in enumerate(zip(plan["chunks"], texts), 1):
                yield number, plan["title"], chunk["heading_path"], text, chunk["tokens"], chunk["chunk_type"]

    spark.udtf.register(name, F.udtf(NoteChunks, returnType=RETURNS))


def chunk_notes_sql(notes: DataFrame, config: Chunking | None = None) -> DataFrame:
    """The rows of ``chunking.chunk_notes`` by way of the table function."""
    config = config or Chunking()
    register(notes.sparkSession, config)
    found = notes.sparkSession.sql(
        f"SELECT n.file_path, n.mtime, n.tags, n.frontmatter, c.* FROM {{notes}} n, LATERAL {CALL} c",
        notes=line_table(notes),
    )
    return with_ids(found, config)
