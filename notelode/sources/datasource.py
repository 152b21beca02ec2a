"""``vault`` as a Spark data source: notes of a Markdown folder, read, streamed and written.

The folder has to be reachable from driver and executors. ``register(spark)`` makes these work::

    spark.read.format("vault").load("/mnt/notes")
    spark.readStream.format("vault").load("/mnt/notes")
    notes.write.format("vault").mode("append").save("/mnt/notes")

Options: ``partitions`` (64) is the number of folders that planning opens at most; a folder that is
opened is dealt to tasks by the hash of its file names, ``files_per_task`` (10000) to each, and what
lies below an unopened one is walked by one task.
"""

from __future__ import annotations

import errno
import json
import math
import os
import shutil
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4
from zlib import crc32

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from .vault import note_entries, resolve_writable

SCHEMA = "file_path string, mtime long, mtime_ms double, markdown string"
# A file this young may still be written to; a stream leaves it to the next batch.
SETTLE_MS = 1000


@dataclass
class Folder(InputPartition):
    """Files of one folder whose name hash falls to this part, or everything below it."""

    path: str
    deep: bool
    part: int = 0
    parts: int = 1
    after_ms: float = -math.inf
    until_ms: float = math.inf


def plan_folders(root: str, partitions: int, files_per_task: int) -> list[Folder]:
    """Tasks that together cover every note below ``root`` once; file names are only counted."""
    todo, out, opened = deque([root]), [], 0
    while todo and opened < partitions:
        folder, files = todo.popleft(), 0
        opened += 1
        try:
            for path, is_folder in note_entries(folder):
                if is_folder:
                    todo.append(path)
                else:
                    files += 1
        except FileNotFoundError:
            if folder == root:
                raise
            continue  # gone since its parent was listed
        parts = -(-files // files_per_task)
        out += [Folder(folder, False, part, parts) for part in range(parts)]
    return out + [Folder(folder, True) for folder in todo]


def note_rows(root: str, task: Folder) -> Iterator[tuple]:
    """Rows of one task, a file at a time; an unreadable file has null text, a vanished one no row."""
    todo = [task.path]
    while todo:
        folder = todo.pop()
        try:
            for path, is_folder in note_entries(folder):
                if is_folder:
                    if task.deep:
                        todo.append(path)
                    continue
                if crc32(os.fsencode(os.path.basename(path))) % task.parts != task.part:
                    continue
                try:
                    info = os.stat(path)
                except OSError:
                    continue
                stamp = info.st_mtime * 1000
                if not task.after_ms < stamp <= task.until_ms:
                    continue
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        text = f.read()
                except OSError:
                    text = None
                yield os.path.relpath(path, root), math.floor(info.st_mtime), stamp, text
        except FileNotFoundError:
            if folder == root:
                raise


class VaultReader(DataSourceReader):
    def __init__(self, root: str, partitions: int, files_per_task: int):
        self.root, self.limits = root, (partitions, files_per_task)

    def partitions(self):
        return plan_folders(self.root, *self.limits)

    def read(self, partition):
        # Spark reads an empty folder as one task without a plan.
        return note_rows(self.root, partition) if partition is not None else iter(())


class VaultStream(DataSourceStreamReader):
    """Notes by modification time. An offset is a time, so it costs no listing to find.

    A note moved in with an older time than the last batch is not seen; touch it.
    """

    def __init__(self, root: str, partitions: int, files_per_task: int):
        self.root, self.limits = root, (partitions, files_per_task)

    def initialOffset(self):
        return {"ms": -1}

    def latestOffset(self):
        return {"ms": int(time.time() * 1000) - SETTLE_MS}

    def partitions(self, start, end):
        tasks = plan_folders(self.root, *self.limits)
        after = -math.inf if start["ms"] < 0 else start["ms"]
        return [Folder(t.path, t.deep, t.part, t.parts, after, end["ms"]) for t in tasks]

    def read(self, partition):
        return note_rows(self.root, partition)

    def commit(self, end):
        pass


@dataclass
class Drafts(WriterCommitMessage):
    folder: str


class VaultWriter(DataSourceWriter):
    """Tasks write drafts beside the notes, the commit moves them into place one by one.

    Until the commit no note has changed, and each note is replaced in one step. A draft's name
    does not end in ``.md``, so no reader takes it for a note. Rows that share a path overwrite
    each other in no certain order; a null path fails the write, null text is an empty note.
    """

    def __init__(self, root: str, schema, overwrite: bool):
        if overwrite:
            raise ValueError("notes are replaced one by one: use mode append")
        names = schema.names
        self.root, self.path_at, self.text_at = root, names.index("file_path"), names.index("markdown")
        self.drafts = os.path.join(root, f".drafts-{uuid4().hex}")

    def write(self, iterator):
        folder = os.path.join(self.drafts, uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "names"), "w", encoding="utf-8") as names:
            for number, row in enumerate(iterator):
                path = row[self.path_at]
                if path is None:
                    raise ValueError("file_path is null")
                resolve_writable(self.root, path)
                names.write(json.dumps(path) + "\n")
                with open(os.path.join(folder, str(number)), "w", encoding="utf-8", newline="") as out:
                    out.write(row[self.text_at] or "")
        return Drafts(folder)

    def commit(self, messages):
        for message in messages:
            if message is None:
                continue
            with open(os.path.join(message.folder, "names"), encoding="utf-8") as names:
                for number, line in enumerate(names):
                    path = resolve_writable(self.root, json.loads(line))
                    draft = os.path.join(message.folder, str(number))
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    if os.path.exists(path):
                        os.chmod(draft, os.stat(path).st_mode & 0o7777)
                    os.replace(draft, path)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.drafts, ignore_errors=True)


class VaultSource(DataSource):
    @classmethod
    def name(cls):
        return "vault"

    def schema(self):
        return SCHEMA

    def _root(self) -> str:
        if "path" not in self.options:
            raise ValueError("vault needs a path")
        return os.path.abspath(self.options["path"])

    def _limits(self) -> tuple[int, int]:
        found = int(self.options.get("partitions", 64)), int(self.options.get("files_per_task", 10_000))
        if min(found) < 1:
            raise ValueError("partitions and files_per_task are positive")
        return found

    def reader(self, schema):
        root = self._root()
        if not os.path.isdir(root):
            raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), root)
        return VaultReader(root, *self._limits())

    def streamReader(self, schema):
        return VaultStream(self._root(), *self._limits())

    def writer(self, schema, overwrite):
        return VaultWriter(self._root(), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)
