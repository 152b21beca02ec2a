"""Tag extraction, normalization and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strict_json_array, trim

EMPTY = "array<string>"


def _non_empty(items: Column) -> Column:
    return F.filter(items, lambda item: item.isNotNull() & (item != ""))


def note_tags(tag_list: Column, tag_text: Column) -> Column:
    """Index tags of a note: one leading ``#`` removed, trimmed, empties dropped."""

    def bare(tag: Column) -> Column:
        return trim(F.regexp_replace(tag, r"\A#", ""))

    from_list = _non_empty(F.transform(tag_list, bare))
    from_text = _non_empty(F.transform(F.split(tag_text, "[, ]+", -1), bare))
    return F.coalesce(from_list, from_text, F.array().cast(EMPTY))


def normalize_tag(candidate: Column) -> Column:
    """``#slug`` of a tag candidate, null when nothing is left."""
    stripped = trim(F.regexp_replace(candidate, rf"\A[#{SPACE}]+", ""))
    kept = F.regexp_replace(F.lower(stripped), rf"[^a-z0-9{SPACE}-]", "")
    slug = F.regexp_replace(trim(kept), rf"[{SPACE}]+", "-")
    return F.when(slug != "", F.concat(F.lit("#"), slug))


def tag_candidates(response: Column) -> Column:
    """A JSON array, or else pieces split on new lines and commas with bullets removed."""
    pieces = F.transform(
        F.split(response, r"[\n,]+", -1),
        lambda piece: trim(F.regexp_replace(piece, rf"\A[-*][{SPACE}]*", "")),
    )
    return F.coalesce(strict_json_array(response), _non_empty(pieces))


def plain_candidates(response: Column) -> Column:
    """Pieces split on new lines and commas, without JSON or bullet handling."""
    return _non_empty(F.transform(F.split(response, r"[\n,]", -1), trim))


def distinct_tags(candidates: Column, limit: int | None) -> Column:
    """Normalized tags without repeats, the first ``limit`` of them or all."""
    tags = F.array_distinct(_non_empty(F.transform(candidates, normalize_tag)))
    return tags if limit is None else F.slice(tags, 1, limit)


def existing_tags(tag_strings: Column, tag_text: Column) -> Column:
    """Normalized tags already in the frontmatter; duplicates stay."""
    single = F.when(tag_text.isNotNull(), F.array(tag_text))
    found = F.coalesce(tag_strings, single, F.array().cast(EMPTY))
    return _non_empty(F.transform(found, normalize_tag))


def added_tags(existing: Column, candidates: Column, limit: int) -> Column:
    """New tags that fit: the note keeps at most ``max(limit, tags it already has)``."""
    fresh = F.array_except(F.array_distinct(_non_empty(F.transform(candidates, normalize_tag))), existing)
    room = F.greatest(F.lit(limit) - F.size(existing), F.lit(0))
    return F.slice(fresh, F.lit(1), room)
