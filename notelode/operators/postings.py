"""The stored lexical index: a posting row for each term and chunk, and its statistics.

A row holds the chunk's length and the term's frequency beside its positions, so a search reads
postings alone; the row of the empty term stands for the chunk itself. ``impact`` is a class of what
the row can add to a score. Tables are sorted by term and falling impact, so a scan for a few terms
and the upper classes of each skips the other pages of a file, positions included. ``statistics``
counts a table by term and class; the counts of parts of an index add up.

A ranked search bounds every class by its largest frequency and least length, scores the
upper classes first, and then reads only classes that can still reach the k-th score.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import B, K1, idf, question_words
from .lineage import cut
from .sizing import MAX_BROADCAST_KEYS, few, is_few, salted_join, small_rows, top_k

ALL = ""
IMPACTS = 16
# Length at which a class is chosen; bounds use the lengths of its rows and the corpus' mean.
USUAL_LENGTH = 200
# Up to this many terms are named in the filter of a scan; more of them are joined.
MAX_NAMED_TERMS = 256
# A first look reads the upper classes that hold this many postings for each hit wanted.
FIRST_LOOK = 8
SLACK = 1e-9
# Tokens whose places are sorted at a time.
TOKENS_PER_STEP = 1 << 19


def _placed(tokens: DataFrame) -> DataFrame:
    """``term, chunk_id, file_path, length, positions`` of rows with token arrays, row by row and without a shuffle."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths().fill_null(0), dtype=np.int64)
            slices = np.cumsum(lengths) // TOKENS_PER_STEP
            for at, end in pairwise([0, *(np.flatnonzero(np.diff(slices)) + 1), len(lengths)]):
                yield _place(batch.slice(at, end - at), lengths[at:end])

    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    schema = f"term string, chunk_id {kinds['chunk_id']}, file_path {kinds['file_path']}, length bigint, positions array<int>"
    return tokens.select("chunk_id", "file_path", "tokens").mapInArrow(place, schema)


def _place(batch: pa.RecordBatch, lengths: np.ndarray) -> pa.RecordBatch:
    flat = batch.column(2).flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = owner * max(1, len(flat.dictionary)) + flat.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = order[edges]
    row = pa.array(owner[first])
    positions = pa.ListArray.from_arrays(
        pa.array(np.append(edges, len(order)), pa.int32()), pa.array(place[order], pa.int32())
    )
    columns = [
        flat.dictionary.take(flat.indices.take(pa.array(first))), batch.column(0).take(row), batch.column(1).take(row),
        pa.array(lengths[owner[first]], pa.int64()), positions,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "chunk_id", "file_path", "length", "positions"])


def _gathered(sized: DataFrame) -> DataFrame:
    """The same for chunks that come more than once: their positions come together."""
    each = sized.select("chunk_id", "file_path", "length", F.posexplode("tokens").alias("at", "term"))
    return each.groupBy("term", "chunk_id", "file_path", "length").agg(
        F.array_sort(F.collect_list("at")).alias("positions")
    )


def postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, file_path, length, positions, tf, impact`` of ``chunk_id, file_path, content`` rows.

    A null content is no part of the index. A chunk's rows are made where it is read; only chunks whose
    id comes more than once, which is looked up first, are shuffled.
    """
    tokens = chunks.select("chunk_id", "file_path", T.index_tokens(F.col("content")).alias("tokens"))
    sized = tokens.withColumn("length", F.size("tokens").cast("long"))
    ids = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    copies = cut(ids.where("n > 1").select(F.col("chunk_id").alias("_id")))
    if copies.isEmpty():
        found = _placed(tokens)
    else:
        twice, side = F.col("chunk_id").eqNullSafe(F.col("_id")), few(copies, "_id")
        found = _placed(tokens.join(side, twice, "left_anti")).unionByName(_gathered(sized.join(side, twice, "left_semi")))
    whole = sized.where(F.col("length").isNotNull()).select(
        F.lit(ALL).alias("term"), "chunk_id", "file_path", "length", F.array().cast("array<int>").alias("positions")
    )
    tf = F.size("positions")
    share = tf / (tf + K1 * (1 - B + B * F.col("length") / USUAL_LENGTH))
    return found.unionByName(whole).withColumn("tf", tf).withColumn("impact", F.floor(IMPACTS * share).cast("int"))


def write(index: DataFrame, folder: str, files: int) -> None:
    """Store postings as Parquet: each term in one of ``files`` files, its highest impacts first."""
    dealt = index.repartition(files, "term").sortWithinPartitions("term", F.desc("impact"), "chunk_id")
    dealt.write.mode("overwrite").parquet(folder)


def statistics(index: DataFrame, *by: str) -> DataFrame:
    """``term, impact, df, cf, length, most, least``: postings, occurrences, lengths, largest tf, least length."""
    return index.groupBy(*by, "term", "impact").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sum("length").alias("length"),
        F.max("tf").alias("most"), F.min("length").alias("least"),
    )


def neighbours_statistics(index: DataFrame, *by: str) -> DataFrame:
    """``statistics`` in parts that ``merged`` adds up, without a shuffle: rows beside each other count together.

    Of sorted postings, as they are stored, a part is left for each file and term, and one more where a batch ends.
    """
    keys = [*by, "term", "impact"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for name in keys:
                code = np.asarray(batch.column(name).dictionary_encode().indices)
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            tf, length = (np.asarray(batch.column(name), dtype=np.int64) for name in ("tf", "length"))
            counts = [
                np.diff(np.append(first, batch.num_rows)), np.add.reduceat(tf, first), np.add.reduceat(length, first),
                np.maximum.reduceat(tf, first), np.minimum.reduceat(length, first),
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(name).take(pa.array(first)) for name in keys] + [pa.array(c, t) for c, t in zip(counts, kinds)],
                names=[*keys, "df", "cf", "length", "most", "least"],
            )

    types = ", ".join(f"{name} {index.schema[name].dataType.simpleString()}" for name in keys)
    schema = f"{types}, df bigint, cf bigint, length bigint, most int, least bigint"
    return index.select(*keys, "tf", "length").mapInArrow(count, schema)


def merged(parts: DataFrame) -> DataFrame:
    """Statistics of an index from those of its parts."""
    return parts.groupBy("term", "impact").agg(
        *(F.sum(c).alias(c) for c in ("df", "cf", "length")), F.max("most").alias("most"), F.min("least").alias("least")
    )


def _named(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``terms``, by a filter that reaches the scan as long as they are few."""
    rows = terms.select("term").distinct().limit(MAX_NAMED_TERMS + 1).collect()
    if len(rows) <= MAX_NAMED_TERMS:
        return df.where(F.col("term").isin([r["term"] for r in rows]))
    return df.join(few(cut(terms.select("term").distinct()), "term"), "term", "left_semi")


def _met(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Postings of the probes' terms with what the probes say; a small set of probes is broadcast."""
    if is_few(probes, "term"):
        return index.join(F.broadcast(probes), "term")
    return salted_join(index, probes, ["term"], "chunk_id")


def _above(index: DataFrame, floors: DataFrame) -> DataFrame:
    """Postings whose impact reaches the ``floor`` of their ``term``."""
    rows = floors.limit(MAX_NAMED_TERMS + 1).collect()
    if len(rows) <= MAX_NAMED_TERMS:
        each = [(F.col("term") == r["term"]) & (F.col("impact") >= r["floor"]) for r in rows]
        return index.where(reduce(or_, each) if each else F.lit(False))
    return index.join(floors, "term").where(F.col("impact") >= F.col("floor")).drop("floor")


def _phrase_count(places: Column, parts: Column) -> Column:
    """How often the parts follow each other, from a map of positions by term."""
    shifted = F.transform(parts, lambda part, k: F.transform(F.element_at(places, part), lambda at: at - k))
    first = F.get(shifted, F.lit(0))
    return F.size(F.aggregate(shifted, first, lambda both, more: F.array_intersect(both, more)))


def _rarest(words: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``key, probe, terms`` of (key, term) rows whose terms all occur; the probe is the rarest."""
    known = words.join(counts, "term", "left").groupBy(key).agg(
        F.min_by("term", F.struct("df", "term")).alias("probe"), F.collect_set("term").alias("terms"),
        F.bool_or(F.col("df").isNull()).alias("missing"),
    )
    return known.where(~F.col("missing")).drop("missing")


class _Phrases:
    """A bounded set of phrases as a trie over the numbers of their terms, and the probe of each."""

    def __init__(self, parts: list[list[str]], probes: list[str]):
        self.terms = sorted({term for phrase in parts for term in phrase})
        number = {term: i for i, term in enumerate(self.terms)}
        self.parts = [[number[term] for term in phrase] for phrase in parts]
        self.probes = np.array([number[term] for term in probes], dtype=np.int64)
        edges: dict[int, int] = {}
        ends = [-1]
        for i, phrase in enumerate(self.parts):
            node = 0
            for code in phrase:
                key = node * len(self.terms) + code
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = i
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.nodes = np.array([edges[key] for key in self.keys.tolist()], dtype=np.int64)
        self.ends = np.array(ends, dtype=np.int64)

    def found(self, owner: np.ndarray, place: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and phrases, one for each place where a phrase begins, of tokens sorted by owner and place."""
        joined = np.append((owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1), False)
        first = at = np.arange(len(code))
        node = np.zeros(len(code), dtype=np.int64)
        owners, phrases = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            key = node * len(self.terms) + code[at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[edge] == key
            first, at, node = first[held], at[held], self.nodes[edge[held]]
            ended = self.ends[node] >= 0
            owners.append(owner[first[ended]])
            phrases.append(self.ends[node[ended]])
            goes_on = joined[at]
            first, at, node = first[goes_on], at[goes_on] + 1, node[goes_on]
        return np.concatenate(owners), np.concatenate(phrases)

    def found_by_counting(self, code: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> dict[int, int]:
        """Occurrences by phrase in a chunk whose id comes more than once: the places of all its rows count together."""
        rows, at = Counter(code.tolist()), defaultdict(Counter)
        for term, place in zip(np.repeat(code, sizes).tolist(), places.tolist()):
            at[term][place] += 1
        out = {}
        for phrase in np.flatnonzero(np.isin(self.probes, code)).tolist():
            begun: Counter = Counter()
            for k, term in enumerate(self.parts[phrase]):
                for place, n in at[term].items():
                    begun[place - k] += n * rows[int(self.probes[phrase])]
            tf = sum(n == len(self.parts[phrase]) for n in begun.values())
            if tf:
                out[phrase] = tf
        return out


def _by_chunk(phrases: _Phrases) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings ``term, chunk_id, positions`` of known terms, those of a chunk within a batch as one row of numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(phrases.terms, pa.string())
        for batch in batches:
            code = pc.index_in(batch.column(0), value_set=terms.cast(batch.column(0).type))
            known = pc.and_(pc.is_valid(code), pc.is_valid(batch.column(1)))
            code, chunk, positions = (column.filter(known) for column in (code, batch.column(1), batch.column(2)))
            chunk = chunk.dictionary_encode()
            order = pa.array(np.argsort(chunk.indices.to_numpy(), kind="stable"))
            positions = positions.take(order)
            sizes = np.asarray(positions.value_lengths().fill_null(0), dtype=np.int32)
            ends = np.cumsum(np.bincount(chunk.indices.to_numpy(), minlength=len(chunk.dictionary)))
            rows = pa.array(np.concatenate(([0], ends)), pa.int32())
            tokens = pa.array(np.concatenate(([0], np.cumsum(sizes)))[np.asarray(rows)], pa.int32())
            lists = [
                pa.ListArray.from_arrays(rows, code.take(order).cast(pa.int32())), pa.ListArray.from_arrays(rows, pa.array(sizes)),
                pa.ListArray.from_arrays(tokens, positions.flatten()),
            ]
            yield pa.RecordBatch.from_arrays([chunk.dictionary, *lists], names=["chunk_id", "codes", "sizes", "places"])

    return pack


def _in_chunks(phrases: _Phrases) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``phrase, chunk_id, tf`` of rows that ``_by_chunk`` has made, sorted by chunk."""

    def step(rows: pa.Table, owner: np.ndarray) -> pa.RecordBatch:
        lists = [rows.column(name).combine_chunks() for name in ("codes", "sizes", "places")]
        code, sizes, place = (np.asarray(column.flatten(), dtype=np.int64) for column in lists)
        of_row = np.repeat(owner, np.asarray(lists[0].value_lengths()))
        of_token = np.repeat(of_row, sizes)
        order = np.argsort((of_token << 32) + place, kind="stable")
        held, at = of_token[order], place[order]
        again = (held[1:] == held[:-1]) & (at[1:] == at[:-1])
        row_key, times = np.unique(of_row * len(phrases.terms) + code, return_counts=True)
        copies = np.union1d(held[1:][again], row_key[times > 1] // len(phrases.terms))
        single = ~np.isin(held, copies)
        owners, found = phrases.found(held[single], at[single], np.repeat(code, sizes)[order][single])
        key, tf = np.unique(owners * len(phrases.parts) + found, return_counts=True)
        owners, found = [key // len(phrases.parts)], [key % len(phrases.parts)]
        counts = [tf]
        for copy in copies.tolist():
            mine = of_row == copy
            counted = phrases.found_by_counting(code[mine], sizes[mine], place[of_token == copy])
            owners.append(np.full(len(counted), copy))
            found.append(np.fromiter(counted, np.int64, len(counted)))
            counts.append(np.fromiter(counted.values(), np.int64, len(counted)))
        first = np.searchsorted(owner, np.concatenate(owners))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(found), pa.int32()), rows.column("chunk_id").combine_chunks().take(pa.array(first)),
                pa.array(np.concatenate(counts), pa.int64()),
            ],
            names=["phrase", "chunk_id", "tf"],
        )

    def whole(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows.column("chunk_id").combine_chunks()
        begins = np.concatenate(([True], np.asarray(pc.not_equal(ids[1:], ids[:-1]), dtype=bool)))
        owner = np.cumsum(begins)
        tokens = np.cumsum(pc.list_value_length(rows.column("places")).to_numpy())
        slices = (tokens // TOKENS_PER_STEP)[np.flatnonzero(begins)][owner - 1]
        for at, end in pairwise([0, *(np.flatnonzero(np.diff(slices)) + 1), len(owner)]):
            yield step(rows.slice(at, end - at), owner[at:end])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last chunk of a batch may go on in the next one.
            ids = batch.column(0)
            at = batch.num_rows - pc.sum(pc.equal(ids, ids[-1])).as_py()
            ended = [*held, batch.slice(0, at)]
            if at or held and held[0].column(0)[0] != ids[-1]:
                yield from whole(ended)
                held = []
            held.append(batch.slice(at))
        if held:
            yield from whole(held)

    return match


def _few_phrase_hits(index: DataFrame, probed: list[Row]) -> DataFrame:
    """``parts, chunk_id, tf`` of a bounded set of phrases: the places of a chunk meet once, whatever the phrases."""
    kind = index.schema["chunk_id"].dataType.simpleString()
    if not probed:
        return index.sparkSession.createDataFrame([], f"parts array<string>, chunk_id {kind}, tf bigint")
    phrases = _Phrases([row["parts"] for row in probed], [row["probe"] for row in probed])
    packed = index.select("term", "chunk_id", "positions").mapInArrow(
        _by_chunk(phrases), f"chunk_id {kind}, codes array<int>, sizes array<int>, places array<int>"
    )
    sorted_ = packed.repartition("chunk_id").sortWithinPartitions("chunk_id")
    found = sorted_.mapInArrow(_in_chunks(phrases), f"phrase int, chunk_id {kind}, tf bigint")
    names = index.sparkSession.createDataFrame(
        [(i, row["parts"]) for i, row in enumerate(probed)], "phrase int, parts array<string>"
    )
    return found.join(F.broadcast(names), "phrase").select("parts", "chunk_id", "tf")


def phrase_hits(index: DataFrame, phrases: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``parts, chunk_id, tf`` of chunks that hold the words of ``parts`` one behind the other.

    A checked, bounded set of phrases travels to the tasks: the places of all their words meet by chunk
    once and are walked in order. Of larger sets, chunks come from the rarest part; there the places of
    all parts, each less its place in the phrase, meet at the places where the phrase begins. ``counts``
    has ``term, df``.
    """
    wanted = phrases.select("parts").distinct()
    terms = wanted.select("parts", F.explode(F.array_distinct("parts")).alias("term"))
    index = _named(index, terms)
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if counts is None else counts
    probed = cut(_rarest(terms, "parts", counts))
    size = F.octet_length(F.array_join("parts", " ")) + 64
    rows = small_rows(probed.select("parts", "probe"), size, MAX_BROADCAST_KEYS)
    if rows is not None:
        return _few_phrase_hits(index, rows)
    near = _met(index.select("term", "chunk_id"), probed.select("parts", F.col("probe").alias("term")))
    pairs = near.select("parts", "chunk_id", F.posexplode("parts").alias("k", "term"))
    met = pairs.join(index.select("term", "chunk_id", "positions"), ["term", "chunk_id"])
    begun = met.select("parts", "chunk_id", F.explode("positions").alias("at"), "k").groupBy(
        "parts", "chunk_id", (F.col("at") - F.col("k")).alias("first")
    ).agg(F.count(F.lit(1)).alias("n"))
    return begun.where(F.col("n") == F.size("parts")).groupBy("parts", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def _gather(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, chunk_id, length, places`` of chunks that hold all ``terms`` of a ``key``.

    ``wanted`` has ``key, terms, probe``; only the probe's postings meet every key.
    """
    probes = wanted.select("key", F.col("probe").alias("term"), "terms")
    near = _met(index.select("term", "chunk_id", "length"), probes)
    near = cut(near.select("key", "chunk_id", "length", "terms"))
    pairs = near.select("key", "chunk_id", "length", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    met = pairs.join(index.select("term", "chunk_id", "positions"), ["term", "chunk_id"])
    return (
        met.groupBy("key", "chunk_id", "length", "n")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
        .where(F.size("places") == F.col("n"))
    )


class _Search:
    """A question set settled against the statistics of an index."""

    def __init__(self, index: DataFrame, questions: DataFrame, parts: DataFrame | None):
        each = question_words(questions).select("query_id", F.explode("words").alias("parts"))
        self.each = each = cut(each.groupBy("query_id", "parts").agg(F.count(F.lit(1)).alias("n")))
        self.words = each.select("query_id", F.explode("parts").alias("term")).distinct()
        named = self.words.select("term").unionByName(index.sparkSession.createDataFrame([(ALL,)], "term string"))
        self.stats = cut(statistics(_named(index, named)) if parts is None else merged(_named(parts, named)))
        corpus = self.stats.where(F.col("term") == ALL).agg(
            F.coalesce(F.sum("df"), F.lit(0)).alias("total"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")
        ).first()
        self.total = corpus["total"]
        self.average = corpus["length"] / self.total if self.total else 0.0
        counts = self.stats.where(F.col("term") != ALL).groupBy("term").agg(F.sum("df").alias("df"))
        self.index = _named(index, self.words)
        phrases = each.where(F.size("parts") > 1)
        found = phrase_hits(self.index, phrases, counts).groupBy("parts").agg(F.count(F.lit(1)).alias("df"))
        df = counts.select(F.array("term").alias("parts"), "df").unionByName(found)
        weight = F.col("n") * idf(F.lit(float(self.total)), F.col("df"))
        self.weights = cut(each.join(df, "parts", "left").select("query_id", "parts", weight.alias("weight"), "df"))
        weighed = self.weights.groupBy("query_id").agg(
            F.bool_or(F.col("df").isNull()).alias("unknown"),
            F.sort_array(F.collect_list(F.struct("parts", "weight"))).alias("words"),
        ).where(~F.col("unknown"))
        plans = _rarest(self.words, "query_id", counts).join(weighed, "query_id")
        self.plans = cut(plans.select(F.col("query_id").alias("key"), "probe", "terms", "words"))

    def _gain(self, tf: Column, length: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.average)))

    def hits(self, index: DataFrame) -> DataFrame:
        """``query_id, chunk_id, bm25, score`` of chunks that hold all words, among the rows of ``index``."""
        found = _gather(index, self.plans).join(self.plans.select("key", "words"), "key")
        places = F.col("places")
        tf = lambda w: F.when(
            F.size(w["parts"]) == 1, F.size(F.element_at(places, F.get(w["parts"], F.lit(0))))
        ).otherwise(_phrase_count(places, w["parts"]))
        counted = F.transform("words", lambda w: F.struct(w["weight"].alias("weight"), tf(w).cast("double").alias("tf")))
        rows = found.select(F.col("key").alias("query_id"), "chunk_id", "length", counted.alias("counted"))
        rows = rows.where(~F.exists("counted", lambda w: w["tf"] == 0))
        gains = F.transform("counted", lambda w: w["weight"] * self._gain(w["tf"], F.col("length")))
        bm25 = -F.aggregate(gains, F.lit(0.0), lambda acc, x: acc + x)
        return rows.select("query_id", "chunk_id", bm25.alias("bm25")).withColumn(
            "score", 1 / F.nullif(F.col("bm25") + 1, F.lit(0.0))
        )

    def first_look(self, k: int) -> DataFrame:
        """``term, floor``: the upper classes with ``FIRST_LOOK * k`` postings, all for parts of phrases."""
        falling = Window.partitionBy("term").orderBy(F.desc("impact"))
        reached = self.stats.where(F.col("term") != ALL).withColumn("held", F.sum("df").over(falling))
        floor = F.max(F.when(F.col("held") >= FIRST_LOOK * k, F.col("impact")))
        return self._whole_for_phrases(reached.groupBy("term").agg(F.coalesce(floor, F.lit(0)).alias("floor")))

    def _whole_for_phrases(self, floors: DataFrame) -> DataFrame:
        parts = self.each.where(F.size("parts") > 1).select(F.explode("parts").alias("term"), F.lit(0).alias("floor"))
        return floors.unionByName(parts).groupBy("term").agg(F.min("floor").alias("floor"))

    def floors(self, bars: DataFrame) -> DataFrame:
        """``term, floor``: classes that can bring a chunk of some question to its bar (``query_id, bar``)."""
        single = self.weights.where(F.size("parts") == 1).select("query_id", F.get("parts", F.lit(0)).alias("term"), "weight")
        bounds = single.join(self.stats, "term").select(
            "query_id", "term", "impact", (F.col("weight") * self._gain(F.col("most"), F.col("least"))).alias("bound")
        )
        best = bounds.groupBy("query_id", "term").agg(F.max("bound").alias("best"))
        phrases = self.weights.where(F.size("parts") > 1).select("query_id", (F.col("weight") * (K1 + 1)).alias("best"))
        most = best.select("query_id", "best").unionByName(phrases).groupBy("query_id").agg(F.sum("best").alias("all"))
        rows = bounds.join(best, ["query_id", "term"]).join(most, "query_id").join(bars, "query_id", "left")
        enough = F.col("bound") + F.col("all") - F.col("best") >= F.col("bar") - SLACK
        kept = rows.where(F.coalesce(enough, F.lit(True)))
        return self._whole_for_phrases(kept.groupBy("term").agg(F.min("impact").alias("floor")))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, ["query_id"], [F.asc(F.round("bm25", 12)), F.asc("chunk_id")], k, spread="chunk_id")


def hits(index: DataFrame, questions: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The same rows as a search over token arrays: ``query_id, chunk_id, bm25, score``.

    ``parts`` are stored statistics of the index; without them its own columns are counted.
    """
    search = _Search(index, questions, parts)
    return search.hits(search.index)


def best_hits(index: DataFrame, questions: DataFrame, k: int, parts: DataFrame | None = None) -> DataFrame:
    """The first ``k`` of ``hits`` with their rank; classes that cannot reach the k-th score are not read.

    Exact: a chunk that holds a word in a class below its floor scores less than the k-th hit of a first
    look. A question with fewer than ``k`` hits there reads all classes of its words.
    """
    search = _Search(index, questions, parts)
    seen = _ranked(search.hits(_above(search.index, search.first_look(k))), k)
    bars = cut(seen.where(F.col("rank") == k).select("query_id", (-F.col("bm25")).alias("bar")))
    return _ranked(search.hits(_above(search.index, cut(search.floors(bars)))), k)
