"""Arrow batches in small steps, so that few rows are Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa

ROWS_PER_STEP = 128


def in_steps(make: Callable[..., pa.Array], columns: Sequence[pa.Array], kind: pa.DataType) -> pa.Array:
    """What ``make`` returns for slices of ``columns``, one behind the other, as ``kind``."""
    starts = range(0, len(columns[0]), ROWS_PER_STEP)
    parts = [make(*(column.slice(at, ROWS_PER_STEP) for column in columns)) for at in starts]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
