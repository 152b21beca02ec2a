"""Markdown folder source.

The folder has to be reachable from every executor. Listing goes level by level, each one's folders
spread over tasks, and files are read one by one inside tasks, so neither the listing nor the
contents pass through the driver. Spark's own file index is not used because it hides names
starting with ``_`` or ``.``, which belong to the notes here.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.lineage import cut

# Directories that never hold notes.
SKIPPED_DIRECTORIES = frozenset({".obsidian", ".trash", ".git"})
_ENTRY = "path string, is_dir boolean"


def note_entries(directory: str) -> Iterator[tuple[str, bool]]:
    """Notes of a folder and folders in it that may hold notes, as (path, is folder)."""
    with os.scandir(directory) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in SKIPPED_DIRECTORIES:
                    yield entry.path, True
            elif entry.is_file(follow_symlinks=False) and entry.name.lower().endswith(".md"):
                yield entry.path, False


def resolve_writable(root: str, target: str) -> str:
    """Absolute path of a note below ``root``; anything outside is refused."""
    root = os.path.abspath(root)
    path = os.path.abspath(os.path.join(root, target))
    if path != root and not path.startswith(root.rstrip(os.sep) + os.sep):
        raise PermissionError(f"{path} is not below {root}")
    return path


def _open_level(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, _ in batch.itertuples(index=False):
                try:
                    rows = list(note_entries(path))
                except FileNotFoundError:
                    if path == root:
                        raise
                    rows = []  # gone since its parent was listed
                yield pd.DataFrame(rows, columns=["path", "is_dir"])

    return run


def list_notes(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """``absolute, file_path, mtime, mtime_ms, birth_ms`` of every note below ``root``."""
    root = os.path.abspath(root)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([(root, True)], _ENTRY)
    levels = []
    while True:  # a job for each level of folders, whose folders are spread over tasks
        opened = cut(folders.mapInPandas(_open_level(root), _ENTRY).repartition(parts, "path"))
        levels.append(opened.where("NOT is_dir").select("path"))
        folders = opened.where("is_dir")
        if not folders.take(1):
            break
    files = reduce(DataFrame.unionByName, levels)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    info = os.stat(path)
                except OSError:  # gone since it was listed
                    continue
                birth = getattr(info, "st_birthtime", 0.0)
                relative = os.path.relpath(path, root)
                rows.append(
                    (path, relative, math.floor(info.st_mtime), info.st_mtime * 1000, birth * 1000)
                )
            yield pd.DataFrame(
                rows, columns=["absolute", "file_path", "mtime", "mtime_ms", "birth_ms"]
            )

    return files.mapInPandas(
        describe,
        "absolute string, file_path string, mtime long, mtime_ms double, birth_ms double",
    )


def read_notes(listing: DataFrame) -> DataFrame:
    """The listing with ``markdown``, one file at a time per task.

    Filter the listing first: only what is left is opened. A file that cannot be read gives
    null text, so that one note does not fail the others.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.iloc[at : at + 1]
                try:
                    with open(row["absolute"].iloc[0], encoding="utf-8", errors="replace", newline="") as f:
                        text = f.read()
                except OSError:
                    text = None
                yield row.assign(markdown=[text])

    schema = StructType([*listing.schema.fields, StructField("markdown", StringType())])
    return listing.mapInPandas(read, schema)


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    return read_notes(list_notes(spark, root))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array: ``query_id, question, expected_paths``."""
    raw = spark.read.schema("question string, expected_paths array<string>").json(
        path, multiLine=True
    )
    order = F.monotonically_increasing_id().cast("string")
    return raw.select(
        order.alias("query_id"),
        "question",
        F.coalesce("expected_paths", F.array().cast("array<string>")).alias("expected_paths"),
    )
