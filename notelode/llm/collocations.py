"""Phrase collocations from a weighted de Bruijn graph of words.

Edges are runs of four words inside a piece of text, nodes the runs of three that they join; an
edge's weight is its number of occurrences. A word run that ends early because its piece does is
a stub of its node: the piece-end correction. All shorter counts are flows: a node's count is the
weight of its outgoing edges plus its stubs, a pair's the flow of the nodes that begin with it,
a word's that of its pairs.

Only what occurs ``least`` times can be a phrase, so two passes keep the graph small and exact. The
first counts words and pairs by hash; those that reach ``least`` set a bit of a bitmap, whose
size has a bound. The second writes an edge only as far as its pairs have their bits; what
follows is a stub of the shorter run, so every flow stays whole and a false bit costs a row, not a
result. Edges that turn out rare become stubs of their nodes, rare nodes stubs of their pairs.
Rows are summed in the worker before they are shuffled, so a line that every text has is one row of
each task. Unary paths of the frequent edges (one way in, one way out) are compacted into rows of
words and weights by pointer doubling, and the counts are read off those paths.

Words are known by 64-bit hashes; only words of ranked phrases are spelled, in a last pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.sizing import hot_join, top_k
from .tables import lean, table
from .words import PLACES, mix, slices, words

LEAST = 30
LIMIT = 2000
PERCENT = 80
# Hashes of pass one; false matches only cost rows, so they are short.
KEY_BITS = 40
# Bits of the bitmap for each frequent word or pair, and the most bits (128 MB) and bits of a part.
ROOM = 16
MOST_BITS = 30
PART_BITS = 20
# Entries a worker sums up before it writes them.
HELD = 2_000_000
# Words of ranked phrases are shipped up to this number (8 bytes each).
MAX_WORDS = 4_000_000
# Edges in one row of a path, and rows for each task of small tables.
SEGMENT = 10_000
TASK_ROWS = 200_000

U64 = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_IN_WORD = ~_ENDS
_IN_WORD[[0x20, 0x09]] = False
GRAM = ["h1", "h2", "h3", "h4"]
KEY = ["lang", *GRAM]


class Slice:
    """Words of a slice of texts: ``hashes`` (never 0), the ``text`` of each, and ``run``, how many of
    the three words behind each belong to its piece."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        self.found = words(data, edges, kept=_IN_WORD)
        self.hashes = np.maximum(self.found.hashes, U64(1))
        self.text = self.found.owner()
        ended = np.r_[0, np.cumsum(_ENDS[data])]
        joined = np.zeros(len(self.hashes) + 3, bool)
        if len(self.hashes) > 1:
            start, end = self.found.start, self.found.end
            joined[: len(self.hashes) - 1] = (ended[start[1:]] == ended[end[:-1]]) & (self.text[1:] == self.text[:-1])
        self.joined = joined
        self.next = np.r_[self.hashes, np.zeros(3, U64)]

    def at(self, step: int) -> np.ndarray:
        return self.next[step : step + len(self.hashes)]

    def keys(self, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short hashes of each word and of the pair it begins, with the language in them."""
        own = langs[self.text]
        one, two = mix(self.hashes + own), mix(self.hashes * PLACES[0] + self.at(1) * PLACES[1] + own)
        return one >> U64(64 - KEY_BITS), two >> U64(64 - KEY_BITS)


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    """Number of each row's language and the languages; null is ``und``."""
    coded = batch.column("lang").fill_null("und").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _lang_hashes(names: list[str]) -> np.ndarray:
    return np.array([mix(np.array([int.from_bytes(n.encode(), "little") % (1 << 64) + 7919 * len(n)], U64))[0] for n in names], U64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, list[str]]]:
    """Slices with each text's language: its hash, and its number among the names."""
    for batch in batches:
        codes, names = _languages(batch)
        hashes = _lang_hashes(names)
        for at, to, data, edges in slices(batch.column("text")):
            yield Slice(data, edges), hashes[codes[at:to]], codes[at:to], names


@lean
def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int32))], names=["key", "n"])

    for part, langs, _, _ in _slices(batches):
        one, two = part.keys(langs)
        held += [one, two[part.joined[: len(two)]]]
        size += len(held[-1]) + len(held[-2])
        if size > HELD:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def _bits(rows: pa.Table) -> pa.Table:
    held = np.zeros(1 << PART_BITS, bool)
    held[rows.column("bit").to_numpy() & (len(held) - 1)] = True
    return pa.table({"part": rows.column("part")[:1], "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def frequent_bits(docs: DataFrame, least: int) -> np.ndarray:
    """Bitmap over the leading bits of keys; words and pairs that occur ``least`` times have their bit set."""
    often = cut(docs.mapInArrow(_key_counts, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
    bits = min(max(int(ROOM * often.count()).bit_length(), PART_BITS), MOST_BITS)
    placed = often.select(F.shiftright("key", KEY_BITS - bits).alias("bit")).distinct()
    parts = placed.withColumn("part", F.shiftright("bit", PART_BITS)).groupBy("part").applyInArrow(_bits, "part long, bits binary")
    out = np.zeros((1 << (bits - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _edges(shipped):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped.value
        shift = U64(KEY_BITS - (len(bitmap).bit_length() + 2))
        held: list[np.ndarray] = []
        names_seen: dict[str, int] = {}
        size = 0

        def often(keys: np.ndarray) -> np.ndarray:
            bit = keys >> shift
            return (bitmap[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)

        def summed() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            order = np.lexsort(rows.T[::-1][1:])
            rows = rows[order]
            first = np.flatnonzero(np.r_[True, (rows[1:, :5] != rows[:-1, :5]).any(axis=1)])
            n = np.add.reduceat(rows[:, 5], first)
            texts = pa.array(list(names_seen), pa.string())
            for low in range(0, len(first), 100_000):
                some = rows[first[low : low + 100_000]]
                yield pa.RecordBatch.from_arrays(
                    [texts.take(pa.array(some[:, 0].astype(np.int64))), *(pa.array(some[:, i].astype(np.int64)) for i in range(1, 5)),
                     pa.array(n[low : low + 100_000].astype(np.int64))],
                    names=[*KEY, "n"],
                )

        for part, langs, codes, names in _slices(batches):
            numbers = np.array([names_seen.setdefault(name, len(names_seen)) for name in names], U64)
            own = numbers[codes[part.text]]
            one, two = part.keys(langs)
            count = len(one)
            pair = np.r_[part.joined[:count] & often(two), np.zeros(3, bool)]
            depth = often(one).astype(np.int8)
            for step in range(3):
                pair_on = pair[step : step + count] if step == 0 else pair_on & pair[step : step + count]
                depth += pair_on
            kept = np.flatnonzero(depth)
            rows = np.zeros((len(kept), 6), U64)
            rows[:, 0] = own[kept]
            for step in range(4):
                rows[:, step + 1] = np.where(depth[kept] > step, part.at(step)[kept], U64(0))
            rows[:, 5] = 1
            # The row without a word holds the number of all words.
            some, many = np.unique(own, return_counts=True)
            all_ = np.zeros((len(some), 6), U64)
            all_[:, 0], all_[:, 5] = some, many
            held += [rows, all_]
            size += len(rows) + len(all_)
            if size > HELD // 2:
                yield from summed()
                held, size = [], 0
        if held:
            yield from summed()

    return run


def graph(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, h1, h2, h3, h4, n) of ``docs`` (lang, text): edges that occur ``least`` times, and stubs.

    A stub has 0 for each word that its piece no longer has or that makes it rare; the row without a
    word holds the number of all words of the language.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(frequent_bits(docs, least))
    raw = docs.mapInArrow(_edges(shipped), "lang string, h1 long, h2 long, h3 long, h4 long, n long")
    # One shuffle by node serves the sums of edges, of nodes' stubs and of nodes.
    node = KEY[:4]
    summed = raw.repartition(*node).groupBy(*KEY).agg(F.sum("n").alias("n"))
    stubs = summed.withColumn("h4", F.when(F.col("n") >= least, F.col("h4")).otherwise(F.lit(0).cast("long")))
    stubs = stubs.groupBy(*KEY).agg(F.sum("n").alias("n"))
    rows = stubs.select(*KEY, "n", F.sum("n").over(Window.partitionBy(*node)).alias("flow"))
    small = (F.col("flow") < least) | (F.col("h3") == 0)
    rows = rows.select(
        "lang", "h1", "h2", *(F.when(small, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("h3", "h4")), "n"
    )
    return cut(rows.groupBy(*KEY).agg(F.sum("n").alias("n")))


def paths(edges: DataFrame) -> DataFrame:
    """(lang, path, part, words, weights): edges (lang, h1..h4, n) with their unary paths compacted.

    ``words`` are those of the first node and one more for each weight. Edges that go round without
    a way in are paths of their own. A path comes in parts of ``SEGMENT`` edges.
    """
    kept = cut(edges.select(*KEY, "n").withColumn("id", F.monotonically_increasing_id()))
    tasks = 1 + kept.count() // TASK_ROWS
    into = kept.groupBy("lang", F.col("h2").alias("a"), F.col("h3").alias("b"), F.col("h4").alias("c")).agg(F.count(F.lit(1)).alias("ins"))
    out = kept.groupBy("lang", F.col("h1").alias("a"), F.col("h2").alias("b"), F.col("h3").alias("c")).agg(
        F.count(F.lit(1)).alias("outs"), F.min("id").alias("to")
    )
    unary = into.where("ins = 1").join(out.where("outs = 1"), ["lang", "a", "b", "c"]).select("lang", "a", "b", "c", "to")
    links = kept.select("id", "lang", F.col("h2").alias("a"), F.col("h3").alias("b"), F.col("h4").alias("c")).join(
        unary, ["lang", "a", "b", "c"]
    ).select("id", "to")
    links = cut(links.coalesce(tasks))
    # An edge without a link ends its path.
    ends = links.select(F.col("to").alias("id")).join(links.select("id"), "id", "left_anti")
    state = cut(
        links.withColumn("far", F.lit(1).cast("long")).withColumn("done", F.lit(False))
        .unionByName(ends.select("id", F.col("id").alias("to"), F.lit(0).cast("long").alias("far"), F.lit(True).alias("done")))
        .coalesce(tasks)
    )
    before = state.where("NOT done").count()
    while before:
        there = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("ended"))
        moved = state.where("NOT done").join(there, "to").select(
            "id", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("ended").alias("done")
        )
        state = cut(state.where("done").unionByName(moved).coalesce(tasks))
        now = state.where("NOT done").count()
        if now == before:
            break
        before = now
    placed = kept.join(state.where("done").select("id", F.col("to").alias("path"), "far"), "id", "left")
    placed = placed.select(*KEY, "n", F.coalesce("path", "id").alias("path"), F.coalesce("far", F.lit(0)).alias("far"))
    whole = placed.groupBy("lang", "path", F.floor(F.col("far") / SEGMENT).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("at"), *GRAM, "n"))).alias("own")
    )
    first = F.col("own")[0]
    return whole.select(
        "lang", "path", "part",
        F.concat(F.array(first["h1"], first["h2"], first["h3"]), F.transform("own", lambda e: e["h4"])).alias("words"),
        F.transform("own", lambda e: e["n"]).alias("weights"),
    )


def edges_of(compact: DataFrame) -> DataFrame:
    """The edges (lang, h1..h4, n) that ``paths`` hold."""
    each = compact.select("lang", "words", F.posexplode("weights").alias("at", "n"))
    return each.select("lang", *(F.get("words", F.col("at") + i).alias(f"h{i + 1}") for i in range(4)), "n")


def counts(compact: DataFrame, stubs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, h1..h4, f) of all runs of one to four words that occur ``least`` times, by node flow."""
    none = F.lit(0).cast("long")
    level = edges_of(compact).withColumnRenamed("n", "f")
    out, rest = level, stubs.where("h1 != 0").withColumnRenamed("n", "f")
    for size in (3, 2, 1):
        # The flow of a run is that of the longer runs it begins and its own stubs.
        begun = level.unionByName(rest.where(f"h{size} != 0 AND h{size + 1} = 0"))
        level = begun.select("lang", *GRAM[:size], *(none.alias(c) for c in GRAM[size:]), "f").groupBy(*KEY).agg(F.sum("f").alias("f"))
        out = out.unionByName(level.where(F.col("f") >= least))
    return out


def _size() -> Column:
    return sum((F.col(c) != 0).cast("int") for c in GRAM)


def _part(first: int, last: int) -> list[Column]:
    """Words ``first`` to ``last`` (not included) of a run as a run of its own."""
    return [(F.col(f"h{first + i + 1}") if first + i < last else F.lit(0).cast("long")).alias(f"p{i + 1}") for i in range(4)]


def _run_parts(spans: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), *_part(a, b)) for a, b in spans))


def scored(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, h1..h4, a, l, r, score) of runs of two words or more that no longer run covers."""
    sized = found.withColumn("size", _size())
    runs = sized.where("size > 1").withColumnRenamed("f", "a")
    cuts = F.when(F.col("size") == 2, _run_parts([(0, 1), (1, 2)]))
    inner = F.when(F.col("size") == 3, _run_parts([(0, 2), (1, 3)]))
    for size in (3, 4):
        spans = [s for k in range(1, size) for s in ((0, k), (k, size))]
        cuts = cuts.when(F.col("size") == size, _run_parts(spans))
    inner = inner.when(F.col("size") == 4, _run_parts([(0, 2), (1, 3), (2, 4), (0, 3), (1, 4)]))
    parts = runs.select(*KEY, "a", "size", F.explode(cuts).alias("x")).select(
        *KEY, "a", "size", F.col("x.from").alias("from"), F.col("x.to").alias("to"), *(F.col(f"x.p{i}").alias(f"p{i}") for i in range(1, 5))
    )
    known = found.select("lang", *(F.col(c).alias(f"p{i + 1}") for i, c in enumerate(GRAM)), "f")
    whole = [f"p{i}" for i in range(1, 5)]
    parts = hot_join(parts.withColumn("spread", F.xxhash64(*KEY, "from")), known, ["lang", *whole], "spread")
    k = F.when(F.col("from") == 0, F.col("to")).otherwise(F.col("from"))
    pairs = parts.groupBy(*KEY, "a", k.alias("k")).agg(
        F.max(F.when(F.col("from") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("from") > 0, F.col("f"))).alias("r")
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    lowest = pairs.withColumn("score", score).groupBy(*KEY, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    covering = runs.select("lang", "a", F.explode(inner).alias("x")).groupBy(
        "lang", *(F.col(f"x.p{i}").alias(f"h{i}") for i in range(1, 5))
    ).agg(F.max("a").alias("most"))
    left = lowest.join(covering, KEY, "left")
    dropped = F.lit(100).cast("decimal(3,0)") * wide("most") >= F.lit(percent).cast("decimal(3,0)") * wide("a")
    return left.where(~F.coalesce(dropped, F.lit(False))).select(*KEY, "a", "m.l", "m.r", "m.score")


def _spelling(shipped):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash and text of the wanted words of a task, each once."""
        wanted = shipped.value
        open_ = np.ones(len(wanted), bool)
        small = np.zeros(1 << 20, bool)
        small[wanted & 0xFFFFF] = True
        for part, *_ in _slices(batches):
            if not open_.any():
                continue
            hashes = part.hashes.astype(np.int64)
            near = np.flatnonzero(small[hashes & 0xFFFFF])
            keys, at = np.unique(hashes[near], return_index=True)
            place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            hit = (wanted[place] == keys) & open_[place]
            open_[place[hit]] = False
            text = part.found.data
            spelled = [text[part.found.start[i] : part.found.end[i]].tobytes() for i in near[at[hit]]]
            lower = [w.translate(_FOLD).decode() for w in spelled]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(lower, pa.string())], names=["h", "word"])

    return run


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def spelled(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` (h1..h4) with ``phrase``, their words joined by spaces, from the texts of ``docs``."""
    spark = docs.sparkSession
    lines = runs.withColumn("run", F.monotonically_increasing_id())
    lines = cut(lines)
    each = lines.select("run", F.posexplode(F.array(*GRAM)).alias("at", "h")).where("h != 0")
    wanted = cut(each.select("h").distinct())
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = None
    # Beyond the bound the words are looked up in several passes, each over a share of the hashes.
    shares = 1 + wanted.count() // MAX_WORDS
    for share in range(shares):
        own = np.sort(wanted.where(F.pmod("h", F.lit(shares)) == share).toArrow()["h"].to_numpy())
        if len(own):
            part = docs.mapInArrow(_spelling(spark.sparkContext.broadcast(own)), "h long, word string")
            known = part if known is None else known.unionByName(part)
    if known is None:
        return runs.withColumn("phrase", F.lit(""))
    texts = known.groupBy("h").agg(F.min("word").alias("word"))
    phrase = each.join(texts, "h").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    phrase = phrase.select("run", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    return lines.join(phrase, "run").drop("run")


def collocations(docs: DataFrame, least: int = LEAST, limit: int = LIMIT, percent: int = PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of ``docs`` (lang, text).

    A null lang is ``und``, a null text empty; repeated rows count again; languages without a phrase
    and empty tables have no row; other columns are left behind.
    """
    whole = graph(docs, least)
    compact = cut(paths(whole.where("h4 != 0")))
    stubs = whole.where("h4 = 0")
    found = cut(counts(compact, stubs, least))
    rated = cut(scored(found, percent).withColumn("spread", F.xxhash64(*KEY)))
    order = [F.desc("score"), F.desc("a")]
    last = top_k(rated, ["lang"], [*order, *map(F.asc, GRAM)], limit, "spread").where(F.col("rank") == limit)
    bar = F.broadcast(last.select("lang", F.struct("score", "a").alias("bar")))
    # What ties with the last rank stays until its words are known.
    near = rated.join(bar, "lang", "left").where("bar IS NULL OR struct(score, a) >= bar").drop("bar")
    total = whole.where("h1 = 0").select("lang", "n")
    ranked = top_k(spelled(docs, near), ["lang"], [*order, F.asc("phrase")], limit, "spread")
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(len(w))) AS i FROM split),
grams AS (SELECT lang, w[i + 1 : i + k] AS g, k FROM starts, range(1, 5) AS s(k) WHERE i + k <= len(w)),
f AS (SELECT lang, g, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 30),
cuts AS (SELECT lang, g, k, f AS a, unnest(range(1, k)) AS c FROM often WHERE k > 1),
rated AS (
  SELECT cuts.*, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS score FROM cuts
  JOIN often x ON x.lang = cuts.lang AND x.g = cuts.g[:c] JOIN often y ON y.lang = cuts.lang AND y.g = cuts.g[c + 1 :]),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, g[s + 1 : s + m] AS g, max(f) AS most FROM often, range(0, 3) AS p(s), range(2, 4) AS q(m)
  WHERE k > m AND s + m <= k GROUP BY ALL),
kept AS (
  SELECT lowest.*, array_to_string(g, ' ') AS phrase FROM lowest LEFT JOIN inner_ USING (lang, g)
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": ORACLE}
