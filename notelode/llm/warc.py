"""WARC archives and their external index.

Pages become WARC/1.0 records: the first of equal payloads is a response, the others revisit it.
Spark's text sink writes them with the records' end as line separator, so the files are plain WARC
and come from the tasks that scan the pages. Reading back parses the archives by their lengths and
digests every payload anew.

The index goes through an external merge. Each archive yields a run of captures sorted by URL key,
time and page. Runs are dealt to tasks by ranges of that order; every task merges its parts of all
runs with a loser tree, and the ranges one behind the other are the capture histories in global
order. A URL with very many captures spans several ranges. Only index entries move, no payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, ensure_checkpoint_dir
from .tables import lean, table

LEAST_SHARED = 100
# Archives hold about so many bytes.
ARCHIVE_BYTES = 64 << 20
# Page numbers of revisits are broadcast up to this number (16 bytes each), joined beyond it.
MAX_BROADCAST_REVISITS = 1_000_000
FIRST_SECOND = 1_704_067_200
# Capture times repeat after so many page numbers (about 127 years), so years keep four digits.
SPAN = 4_000_000_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid4().hex}"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _records(pages: DataFrame) -> DataFrame:
    """One text per record, without the empty lines behind it."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _header("Content-Length", F.col("n").cast("string")), F.lit("\r\n"),
    )
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    id_ = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", id_(F.col("page_id"))),
        F.coalesce(_header("WARC-Target-URI", address), F.lit("")),
        _header("WARC-Date", date),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_header("WARC-Refers-To", id_(F.col("first"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )
    return pages.withColumn("block", block).select(head.alias("value"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html) into ``folder``.

    Of rows with equal payloads of ``LEAST_SHARED`` bytes or more, those with the smallest page_id
    are responses (all of them, if a page_id is repeated) and the others revisit it; a null page_id
    comes behind all others. A null html is empty; a null url gives a record without a target.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    plain = pages.select("page_id", "url", payload.alias("html")).withColumn("n", F.octet_length("html"))
    digest = F.sha2(F.col("html"), 256)
    marks = cut(plain.select("page_id", "n", digest.alias("digest")))
    total = marks.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")).first()
    shared = marks.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    shared = cut(shared.where("copies > 1").select("digest", "first"))
    again = marks.where(F.col("n") >= LEAST_SHARED).join(shared, "digest").where("NOT page_id <=> first")
    # A page_id that comes with several payloads is told apart by the digest.
    again = cut(again.select("page_id", F.col("digest"), "first").distinct())
    few = again.count() <= MAX_BROADCAST_REVISITS
    named = plain.withColumn("digest", digest)
    other = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    joined = named.join(F.broadcast(other) if few else other, same, "left")
    per_file = max(1, int(archive_bytes * max(1, total["rows"]) / max(1, (total["bytes"] or 0) + 600 * total["rows"])))
    (
        _records(joined).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file)
        .option("compression", "none").text(folder)
    )


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(place, length, headers, block) of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        yield at, stop + 4 - at, headers, content[end + 4 : stop]
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end at {stop}")
        at = stop + 4


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the rest: sites sort together."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return ")" + (url or "")
    host = rest
    for stop in "/?#":
        host = host.partition(stop)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :]


ENTRY = ("run string, run_at long, url_key string, captured string, page_id long, place long, length long,"
         " payload_bytes long, payload_digest string, record_type string, refers_to long")  # fmt: skip


@lean
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive as a sorted run."""

    def number(urn: str | None) -> int | None:
        text = urn[len("<urn:page:") : -1] if urn else ""
        return int(text) if text else None

    names = [part.split()[0] for part in ENTRY.split(",")]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for place, length, headers, block in parse(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = headers["WARC-Type"]
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                else:
                    size = int(head.decode().partition("Content-Length: ")[2].split("\r\n")[0])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append((url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], number(headers["WARC-Record-ID"]),
                             place, length, size, digest, kind, number(headers.get("WARC-Refers-To"))))
            rows.sort(key=order)
            for low in range(0, len(rows), 20_000):
                some = [(path, low + i, *row) for i, row in enumerate(rows[low : low + 20_000])]
                columns = [pa.array(c) for c in zip(*some)]
                columns[4], columns[10] = (pa.array([r[i] for r in some], pa.int64()) for i in (4, 10))
                yield pa.RecordBatch.from_arrays(columns, names=names)


def order(row: tuple) -> tuple:
    """Order of captures: URL key, time, page (null last), payload digest, place."""
    key, captured, page, place, *_ = row
    return key, captured, page is None, page or 0, row[6], place


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its two sides, the winner moves up."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._play(i)

    def _before(self, i: int, j: int) -> bool:
        if self.keys[i] is None or self.keys[j] is None:
            return self.keys[j] is None and (self.keys[i] is not None or i < j)
        return (self.keys[i], i) < (self.keys[j], j)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # still being built: wait here for the other side
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.runs and self.keys[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = head = next(self.runs[winner], None)
            self.keys[winner] = None if head is None else self.key(head)
            self._play(winner)


@lean
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges one range's parts of all runs; ``part`` and ``at`` give each capture's place."""
    rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    rows = rows.sort_by([("run", "ascending"), ("run_at", "ascending")])  # parts arrive in any order
    columns = [rows[c].to_pylist() for c in rows.column_names[2:]]
    runs = rows["run"].to_pylist()
    starts = [i for i in range(len(runs)) if not i or runs[i] != runs[i - 1]] + [len(runs)]

    def part(low: int, high: int):
        for i in range(low, high):
            yield tuple(c[i] for c in columns) + (i,)

    merged = LoserTree([part(a, b) for a, b in zip(starts, starts[1:])], order)
    rank = pa.array([row[-1] for row in merged])
    out = rows.select(rows.column_names[2:]).take(rank).combine_chunks()
    out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(rank), pa.int32()))
    out = out.append_column("at", pa.array(range(len(rank)), pa.int64()))
    yield from out.to_batches()


def read_histories(spark: SparkSession, folder: str) -> DataFrame:
    """All captures of the archives in ``folder`` with ``position``, their place in global order.

    Columns: url_key, captured, page_id, place and length (bytes of the record in its archive),
    payload_bytes, payload_digest, record_type, refers_to, position (from 0). Equal captures keep
    the order of their payload digests, then of their places. A folder without records gives no
    rows.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    entries = cut(archives.mapInArrow(_run, ENTRY))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = ENTRY.split(", ", 2)[2].strip()
    ordered = entries.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_last(), "payload_digest", "place")
    merged = cut(ordered.mapInArrow(_merge, f"{kept}, part int, at long"))
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a number for each range
    first, total = [], 0
    for row in sorted(sizes):
        first.append((row["part"], total))
        total += row["n"]
    before = spark.createDataFrame(first or [(0, 0)], "part int, before long")
    return merged.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("at")).drop("part", "at", "before")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return read_histories(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position"
    )


QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest, position('://' IN coalesce(url, '')) AS mark, coalesce(url, '') AS url
    FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first,
        CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest
    FROM p
), k AS (
    SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM f
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
    row_number() OVER (ORDER BY CASE WHEN mark > 0
        THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || substr(rest, length(host) + 1)
        ELSE ')' || url END, page_id) - 1 AS position
FROM k
""",
}
