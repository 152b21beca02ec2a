"""Recent sibling notes of a journal entry, newest first, up to a total length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from ..functions.vectors import DAY_MS
from .packing import SEPARATOR
from .sizing import hot_join, top_k

# "File: ", "Modified: ", a 24 character time and the line ends: no block is shorter.
SHORTEST_BLOCK = 44


def entry_text(markdown: Column) -> Column:
    """User text and earlier generated blocks of a note under their captions; null if neither."""
    cleaned = T.trim(M.strip_blocks(markdown))
    blocks = M.extract_blocks(markdown)
    user = F.when(cleaned != "", F.concat(F.lit("User entry:\n\n"), cleaned))
    prior = F.when(
        F.size(blocks) > 0,
        F.concat(F.lit("Prior AI reflections:\n\n"), F.array_join(blocks, SEPARATOR)),
    )
    joined = F.concat_ws("\n\n", user, prior)
    return F.when(joined != "", joined)


def entry_block(name: Column, mtime_ms: Column, content: Column, snippet_chars: int) -> Column:
    return F.concat(
        F.lit("File: "), name, F.lit("\nModified: "), T.iso_millis(mtime_ms), F.lit("\n\n"),
        T.truncate(content, snippet_chars),
    )


def recent_entries(
    targets: DataFrame,
    notes: DataFrame,
    now_ms: int,
    days: int = 30,
    snippet_chars: int = 1500,
    max_chars: int = 12_000,
) -> DataFrame:
    """``file_path, recent_entries`` for each target from ``notes(file_path, mtime_ms, markdown)``.

    Blocks are taken newest first until one would exceed ``max_chars``. A block has a least
    length, so no directory can contribute more than its newest few hundred notes: these are
    picked once per directory and every target drops itself from that bounded list.
    """
    most = max_chars // SHORTEST_BLOCK + 2
    directory = T.dir_name(F.col("file_path"))
    is_md = F.lower(F.col("file_path")).endswith(".md")
    recent = (
        notes.where(is_md & (F.col("mtime_ms") >= now_ms - days * DAY_MS))
        .withColumn("content", entry_text(F.col("markdown")))
        .where(F.col("content").isNotNull())
    )
    # The text is cut to its snippet before anything is shuffled.
    name, content = T.base_name(F.col("file_path")), F.col("content")
    block = entry_block(name, F.col("mtime_ms"), content, snippet_chars)
    blocks = recent.select(directory.alias("dir"), "file_path", "mtime_ms", block.alias("block"))
    order = [F.desc("mtime_ms"), F.asc("file_path")]
    newest = top_k(blocks, ["dir"], order, most, spread="file_path").drop("mtime_ms")
    newest = newest.withColumn("length", T.utf16_length(F.col("block")))
    # Past this point of a directory's own running total nothing fits, whoever is left out.
    longest = F.max("length").over(Window.partitionBy("dir"))
    running = F.sum("length").over(
        Window.partitionBy("dir").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    useful = newest.withColumn("_run", running - longest).where(F.col("_run") <= max_chars)
    per_dir = useful.groupBy("dir").agg(
        F.sort_array(F.collect_list(F.struct("rank", "file_path", "length", "block"))).alias("rows")
    )
    mine = targets.select("file_path").distinct().withColumn("dir", directory)
    joined = hot_join(mine, per_dir, ["dir"], "file_path")
    others = joined.withColumn(
        "rows", F.filter("rows", lambda row: row["file_path"] != F.col("file_path"))
    )

    def take(acc: Column, row: Column) -> Column:
        total = acc["total"] + row["length"]
        fits = acc["open"] & (total <= max_chars)
        return F.struct(
            F.when(fits, total).otherwise(acc["total"]).alias("total"),
            fits.alias("open"),
            F.when(fits, F.array_append(acc["blocks"], row["block"]))
            .otherwise(acc["blocks"])
            .alias("blocks"),
        )

    start = F.struct(
        F.lit(0).alias("total"), F.lit(True).alias("open"),
        F.array().cast("array<string>").alias("blocks"),
    )
    text = F.aggregate("rows", start, take, lambda acc: F.array_join(acc["blocks"], SEPARATOR))
    found = others.select("file_path", text.alias("recent_entries"))
    return mine.select("file_path").join(found, "file_path", "left").select(
        "file_path", F.coalesce("recent_entries", F.lit("")).alias("recent_entries")
    )
