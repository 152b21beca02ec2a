"""Metadata filters and length gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.markers import strip_blocks
from ..functions.text import trim, utf16_length


@dataclass(frozen=True)
class Filters:
    """Path prefix AND any of the tags AND one of the chunk types; empty parts do not filter."""

    path_prefix: str | None = None
    tags: Sequence[str] = ()
    chunk_types: Sequence[str] = ()

    @property
    def empty(self) -> bool:
        return not (self.path_prefix or self.tags or self.chunk_types)

    def predicate(self) -> Column:
        condition = F.lit(True)
        if self.path_prefix:
            condition &= F.col("file_path").startswith(self.path_prefix)
        if self.tags:
            condition &= F.arrays_overlap("tags", F.array(*map(F.lit, self.tags)))
        if self.chunk_types:
            condition &= F.col("chunk_type").isin(list(self.chunk_types))
        return condition


def user_text(markdown: Column) -> Column:
    """Note text without generated blocks, trimmed."""
    return trim(strip_blocks(markdown))


def long_enough(cleaned: Column, minimum: int) -> Column:
    return utf16_length(cleaned) >= minimum
