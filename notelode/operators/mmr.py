"""Maximum marginal relevance over a bounded pool per question."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _pick(scores: np.ndarray, similar: np.ndarray, top_n: int, weight: float) -> list[int]:
    """Greedy choice; the first of equal candidates wins."""
    count = len(scores)
    picked: list[int] = []
    closest = np.zeros(count)
    open_ = np.ones(count, dtype=bool)
    while len(picked) < min(top_n, count):
        value = np.where(open_, np.round(weight * scores - (1 - weight) * closest, 12), -np.inf)
        best = int(np.argmax(value))
        closest = similar[best] if not picked else np.maximum(closest, similar[best])
        picked.append(best)
        open_[best] = False
    return picked


def _dots(vectors: pd.Series) -> np.ndarray:
    """Pairwise dot products over shared lengths (padding with zeros is the same)."""
    width = max((0 if v is None else len(v) for v in vectors), default=0)
    padded = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        if vector is not None:
            padded[row, : len(vector)] = vector
    return padded @ padded.T


def diversify(pool: DataFrame, top_n: int = 12, weight: float = 0.65) -> DataFrame:
    """Pick ``top_n`` rows per question by ``weight * score - (1 - weight) * closest pick``.

    ``pool`` has ``query_id, score, rank, embedding`` and whatever should come along, and at
    most the configured pool size of rows per question. Pools of ``top_n`` rows or fewer pass
    through. Scores are kept, ranks are new.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        if len(rows) > top_n:
            picks = _pick(rows["score"].to_numpy(), _dots(rows["embedding"]), top_n, weight)
            rows = rows.iloc[picks]
        return rows.assign(rank=np.arange(1, len(rows) + 1, dtype="int32"))

    return pool.groupBy("query_id").applyInPandas(choose, pool.schema)
