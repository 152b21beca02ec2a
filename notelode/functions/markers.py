"""Generated blocks inside notes: strip, drop, extract and append them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, is_blank, trim, trim_end

# Block markers.
BLOCK_START = "<!-- AI:BEGIN -->"
BLOCK_END = "<!-- AI:END -->"
BLOCK_PATTERN = r"<!-- AI:BEGIN -->([\s\S]*?)<!-- AI:END -->"


def strip_blocks(text: Column) -> Column:
    """Remove generated blocks. A note that has any also loses all of its blank lines."""
    cleaned = F.regexp_replace(F.regexp_replace(text, BLOCK_PATTERN, "\n"), r"\n{2,}", "\n")
    return F.when(text.contains(BLOCK_START), trim(cleaned)).otherwise(text)


def extract_blocks(text: Column) -> Column:
    """Trimmed non-empty bodies of the generated blocks."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(BLOCK_PATTERN), F.lit(1)), trim)
    return F.filter(bodies, lambda body: body != "")


def strip_markers(text: Column) -> Column:
    """Drop the markers and the white space next to them, keeping the bodies."""
    opened = F.regexp_replace(text, rf"<!--[{SPACE}]*AI:BEGIN[{SPACE}]*-->[{SPACE}]*", "")
    return F.regexp_replace(opened, rf"[{SPACE}]*<!--[{SPACE}]*AI:END[{SPACE}]*-->", "")


def _title_line(body: Column) -> Column:
    lines = F.transform(F.split(body, "\n", -1), trim)
    return F.coalesce(F.get(F.filter(lines, lambda line: line != ""), F.lit(0)), F.lit(""))


def drop_blocks(text: Column, predicate: Callable[[Column], Column]) -> Column:
    """``struct<content, removed>`` after dropping blocks whose title line meets ``predicate``.

    The text between the blocks and the blocks themselves are two aligned arrays, so the
    result is one ordered join of both with the matching blocks blanked.
    """
    bodies = F.regexp_extract_all(text, F.lit(BLOCK_PATTERN), F.lit(1))
    between = F.split(text, BLOCK_PATTERN, -1)

    def keep(body: Column) -> Column:
        whole = F.concat(F.lit(BLOCK_START), body, F.lit(BLOCK_END))
        return F.when(predicate(_title_line(body)), F.lit("")).otherwise(whole)

    kept = F.transform(bodies, keep)
    joined = F.array_join(
        F.zip_with(between, kept, lambda gap, block: F.concat(gap, F.coalesce(block, F.lit("")))),
        "",
    )
    cleaned = trim_end(F.regexp_replace(joined, r"\n{3,}", "\n\n"))
    removed = F.size(F.filter(kept, lambda block: block == ""))
    marked = text.contains(BLOCK_START)
    return F.struct(
        F.when(marked, cleaned).otherwise(text).alias("content"),
        F.when(marked, removed).otherwise(F.lit(0)).alias("removed"),
    )


def append_block(
    existing: Column,
    title: Column | str,
    body: Column,
    replace: Callable[[Column], Column] | None = None,
) -> Column:
    """New note text with a block at its end, replacing blocks that meet ``replace``."""
    title = F.lit(title) if isinstance(title, str) else title
    base = F.coalesce(existing, F.lit(""))
    if replace is not None:
        base = drop_blocks(base, replace)["content"]
    block = F.concat(
        F.lit(BLOCK_START + "\n"),
        trim(title),
        F.lit("\n\n"),
        trim(body),
        F.lit("\n" + BLOCK_END + "\n\n"),
    )
    return F.when(body.isNotNull(), F.concat_ws("\n\n", F.nullif(trim_end(base), F.lit("")), block))


def has_user_text(text: Column) -> Column:
    return ~is_blank(strip_blocks(text))
