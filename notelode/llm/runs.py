"""Periodic runs inside texts by seed-and-extend along diagonals.

A run is a maximal stretch of words with smallest period ``q`` and at least ``max(12, 2 * q)``
words. On the diagonal of lag ``q`` (word ``i`` against word ``i + q``) it is a stretch of equal
words, at least six long for periods up to 11 and at least ``q`` long beyond. So runs with lags
from ``k`` to ``2 * k - 1`` hold a ``k``-gram that occurs again at that lag: for k = 12, 24, 48, ...
the k-grams of a text are indexed, their occurrence pairs at such lags are seeds, and a seed is
extended both ways along its diagonal. A table of the furthest covered place of each lag keeps a
stretch from being extended twice. A k-gram that occurs again within ``k / 2`` words is left out as
a seed: if all seeds of a run were such, the run would have a smaller period (Fine and Wilf), so
none is lost, and a gram has few partners in a window however often the text repeats it.

Every text is handled whole, in the task that reads it, and nothing is shuffled. Memory is a few
numbers for each word of the longest text. Null and empty texts have no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import lean, table, texts
from .words import PLACES, mix, ngrams, powers, slices, words

LEAST = 12
SHORT = 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def grams(total: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of ``k`` words from the running sums of ``sums``."""
    _, inverse = powers(len(total))
    return (total[k:] - total[:-k]) * inverse[: len(total) - k]


def sums(ids: np.ndarray) -> np.ndarray:
    power, _ = powers(len(ids) + 1)
    return np.r_[np.zeros(1, np.uint64), np.cumsum(ids * power[: len(ids)], dtype=np.uint64)]


def seeds(total: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(place, lag) of equal k-grams ``low <= lag < high`` apart, by lag and place; whether any repeats."""
    _, rank = np.unique(grams(total, k), return_inverse=True)
    n = len(total)
    order = np.argsort(rank, kind="stable")
    key = rank[order] * (2 * n) + order
    again = np.flatnonzero(rank[order][1:] == rank[order][:-1])
    if not len(again):
        return order[:0], order[:0], False
    # Only grams that occur again are looked up; those that overlap themselves strongly are no seeds.
    if low >= LEAST:
        again = again[order[again + 1] - order[again] > k // 2]
    at = key[again]
    first, last = np.searchsorted(key, at + low), np.searchsorted(key, at + high)
    many = last - first
    place = np.repeat(order[again], many)
    partner = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    lag = order[partner] - place
    by = np.lexsort((place, lag))
    return place[by], lag[by], True


def _reach(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """Words equal to those ``lag`` behind them from ``at`` on, forwards or (``step`` -1) backwards."""
    done, size = 0, 16
    while True:
        if step > 0:
            a, b = ids[at + done : at + done + size], ids[at + done + lag : at + done + lag + size]
            a = a[: len(b)]
        else:
            to = at - done
            a, b = ids[max(to - size, 0) : max(to, 0)][::-1], ids[max(to - size, 0) + lag : max(to, 0) + lag][::-1]
        if not len(a):
            return done
        other = a != b
        if other.any():
            return done + int(other.argmax())
        done, size = done + len(a), size * 2


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` (12 at least) words or more, by start and period."""
    found: dict[tuple[int, int], int] = {}
    total, n = sums(ids), len(ids)
    k, low, high = SHORT, 1, LEAST
    while n >= least and n >= low + k:
        place, lag, repeats = seeds(total, k, low, high)
        if not repeats:
            break
        covered: dict[int, int] = {}
        # Seeds that follow each other on a diagonal are one seed.
        heads = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(lag) != 0)]) if len(place) else place
        tails = np.r_[heads[1:] - 1, len(place) - 1] if len(place) else place
        for at, last, q in zip(place[heads].tolist(), place[tails].tolist(), lag[heads].tolist()):
            if at < covered.get(q, 0):
                continue
            end = last + k + _reach(ids, last + k, q, 1)
            start = at - _reach(ids, at, q, -1)
            covered[q] = end
            # Hashes only propose: a stretch that its words do not confirm is no run.
            if end + q - start >= max(least, 2 * q) and (ids[start:end] == ids[start + q : end + q]).all():
                one = (start, end + q - start)
                found[one] = min(found.get(one, q), q)
        k, low, high = (LEAST, LEAST, 2 * LEAST) if k == SHORT else (2 * k, 2 * k, 4 * k)
    return sorted((start, length, q) for (start, length), q in found.items())


def _repeating(hashes: np.ndarray, owner: np.ndarray, found) -> np.ndarray:
    """Numbers of the texts in which a gram of ``SHORT`` words occurs twice."""
    short, place = ngrams(found, SHORT)
    own = mix(short + owner[place].astype(np.uint64) * PLACES[0])
    order = np.argsort(own, kind="stable")
    twice = np.flatnonzero(own[order][1:] == own[order][:-1])
    return np.unique(owner[place[order[twice]]])


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


@lean
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for at, to, data, edges in slices(column):
            found = words(data, edges, fold=False)
            repeating = set(_repeating(found.hashes, found.owner(), found).tolist())
            starts, lengths, periods, ends, collapsed = [], [], [], [0], []
            for i in range(to - at):
                own = data[edges[i] : edges[i + 1]].tobytes().split()
                if i in repeating:
                    runs = find_runs(found.hashes[found.first[i] : found.first[i + 1]])
                    own = [own[x] for x in _kept(len(own), runs).tolist()] if runs else own
                    for start, length, q in runs:
                        starts.append(start)
                        lengths.append(length)
                        periods.append(q)
                ends.append(len(starts))
                collapsed.append(b" ".join(own))
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, to - at), pa.array(np.diff(found.first), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text; others are left behind).

    ``runs`` holds all runs by start and period; ``collapsed`` is the text with only the first
    period of every run, its words joined by one space. A null doc_id stays, repeated rows too.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(_run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def replayed(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text (by crc32 of doc_id) made periodic from a word that its id names."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    g, n = F.floor(h / 10).cast("long"), F.size("own").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
    made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("own", place(i).cast("int")))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = texts(docs).withColumn("own", F.when(chosen, own))
    return split.select("doc_id", F.when(F.size("own") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start, then the smallest period; null without one."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(replayed(table(spark, sf_dir, "documents", "doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", longest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), (-best["m"]).alias("length"), best["period"].alias("period"),
        F.floor(-best["m"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# A stretch of m equal words on a diagonal holds m - 5 six-grams that occur again at its lag, all in a row.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS d, doc_id, CAST(doc_id AS VARCHAR) AS name,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS own
  FROM documents),
hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(name)), lambda i: ascii(name[i + 1])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) AS h
  FROM docs),
placed AS (SELECT *, h // 10 AS g, len(own) AS n FROM hashed),
cut AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n END AS a FROM placed),
bent AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
made AS (
  SELECT d, doc_id, CASE WHEN a IS NULL THEN own
    ELSE list_transform(range(n), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w
  FROM bent),
grams AS (
  SELECT d, i, w[i + 1 : i + 6] AS gram FROM (SELECT d, w, unnest(range(len(w) - 5)) AS i FROM made WHERE len(w) >= 12)),
pairs AS (SELECT x.d, x.i, y.i - x.i AS lag FROM grams x JOIN grams y ON x.d = y.d AND x.gram = y.gram AND x.i < y.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY d, lag ORDER BY i) AS island FROM pairs),
stretches AS (SELECT d, lag, min(i) AS start, count(*) + 5 + lag AS length FROM islands GROUP BY d, lag, island),
runs AS (
  SELECT d, start, length, min(lag) AS period FROM stretches
  WHERE length >= greatest(12, 2 * lag) GROUP BY d, start, length),
best AS (
  SELECT d, count(*) AS n_runs, min((-length, start, period)) AS b,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY d),
edges AS (
  SELECT d, spot, sum(v) AS v FROM (
    SELECT d, start + period AS spot, 1 AS v FROM runs UNION ALL SELECT d, start + length, -1 FROM runs) GROUP BY d, spot),
covers AS (
  SELECT d, spot, sum(v) OVER (PARTITION BY d ORDER BY spot) AS depth,
         lead(spot) OVER (PARTITION BY d ORDER BY spot) AS until FROM edges),
gone AS (SELECT d, list((spot, until)) AS spans FROM covers WHERE depth > 0 GROUP BY d),
kept AS (
  SELECT made.d, CASE WHEN spans IS NULL THEN w
    ELSE list_transform(list_filter(range(len(w)), lambda i: len(list_filter(spans, lambda s: i >= s[1] AND i < s[2])) = 0), lambda i: w[i + 1]) END AS w
  FROM made LEFT JOIN gone USING (d))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b[2]::BIGINT AS start, (-b[1])::BIGINT AS length, b[3]::BIGINT AS period,
  (-b[1] * 1000 // b[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(kept.w, ' '), '')) AS collapsed_sha256
FROM made JOIN kept USING (d) LEFT JOIN best USING (d)
"""

QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES = {"op12_periodic_runs": ORACLE}
