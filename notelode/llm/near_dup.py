"""MinHash near-duplicates by an LSH forest.

Every text's word shingles give ``TREES * DEPTH`` minima. A tree is one sorted order of all
signatures; texts that agree on a long prefix lie next to each other there. Sparse regions are
taken at depth ``LEAST_DEPTH``; where more than ``WINDOW`` texts share a prefix, the region is
taken one level deeper, until it is small or the signature ends. Pairs of a small region are
candidates. What still shares a whole signature with more texts is an open region: its
neighbours in the order are candidates, and later all its texts that do not yet lie in the
region's largest component are compared with all others, block by block, so no link is lost to
the window. Candidates are confirmed on full shingle sets.

Chance that a pair at similarity 0.8 is missed: (1 - 0.8**3)**32 = 1e-10 in sparse regions,
(1 - 0.8**6)**32 = 6e-5 in the deepest ones; far less for closer pairs.

Texts with equal sets are one class and are compared once; a class is settled by an aggregate
that sums before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .components import components
from .tables import lean, table, texts
from .words import U64, mix, shingle_sets

TREES = 32
DEPTH = 6
LEAST_DEPTH = 3
# A region of up to so many texts has all its pairs compared.
WINDOW = 16
# Neighbours taken on each side of a text in an open region.
NEIGHBOURS = 2
# Sides of the blocks in which open regions are compared.
BLOCK = 256
# Ids of candidates are broadcast up to this number (8 bytes each), joined by a shuffle beyond it.
MAX_BROADCAST_IDS = 2_000_000

_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U64)) | U64(1)


def signature(grams: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` minima over a set of hashes, in blocks of bounded memory."""
    least = np.full(len(_SEEDS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 2048):
        hashed = (grams[at : at + 2048, None] * _SEEDS[None, :]) >> U64(32)
        least = np.minimum(least, hashed.astype(np.uint32).min(axis=0))
    return least


def _signatures(words: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, marks = [], [], []
            for grams in shingle_sets(batch.column("text"), words):
                sizes.append(len(grams))
                if not len(grams):
                    keys.append(None)
                    marks.append(None)
                    continue
                place = np.arange(len(grams), dtype=U64)
                sums = (np.sum(mix(grams), dtype=U64), np.sum(mix(grams + (place << U64(40)) + place), dtype=U64))
                keys.append(np.array([*sums, len(grams)], U64).tobytes())
                marks.append(signature(grams).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "signature"],
            )

    return run


@lean
def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tree; ``place`` is the tree's number and the text's signature in it."""
    width = 4 * DEPTH
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8)
        keys = np.empty((n, TREES, 1 + width), np.uint8)
        keys[:, :, 0] = np.arange(TREES, dtype=np.uint8)
        keys[:, :, 1:] = marks.reshape(n, TREES, width)
        rows = n * TREES
        bounds = pa.py_buffer(np.arange(0, (rows + 1) * (1 + width), 1 + width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.Array.from_buffers(pa.binary(), rows, [None, bounds, pa.py_buffer(keys)]),
                pa.array(np.repeat(batch.column("doc_id").to_numpy(), TREES)),
                pa.array(np.repeat(batch.column("n_shingles").to_numpy(), TREES)),
            ],
            names=["place", "doc_id", "n_shingles"],
        )


def neighbours(place: np.ndarray, ids: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple]:
    """(a, b, open) of one stretch of sorted rows; open rows tie a text to its region's first."""
    n = len(ids)
    found: list[tuple] = []
    if n < 2:
        return found
    differ = place[1:] != place[:-1]
    region = np.full(n, -1)
    depth_of = np.zeros(n, np.int64)
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        new = np.r_[True, differ[:, : 1 + 4 * depth].any(axis=1)]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group]
        settle = (depth_of == 0) & ((many <= WINDOW) | (depth == DEPTH))
        region[settle] = np.flatnonzero(new)[group[settle]]
        depth_of[settle] = np.where(many[settle] <= WINDOW, 1, 2)
    for step in range(1, WINDOW):
        same = (region[step:] == region[:-step]) & (depth_of[step:] == depth_of[:-step])
        if step > NEIGHBOURS:
            same &= depth_of[step:] == 1
        at = np.flatnonzero(same)
        small, large = np.minimum(sizes[at], sizes[at + step]), np.maximum(sizes[at], sizes[at + step])
        at = at[100 * small >= percent * large]
        if len(at):
            found.append((ids[at], ids[at + step], np.zeros(len(at), bool)))
    wide = np.flatnonzero(depth_of == 2)
    if len(wide):
        found.append((ids[wide], ids[region[wide]], np.ones(len(wide), bool)))
    return found


def _cut_at(key: np.ndarray, room: int) -> int:
    """Where sorted rows may be cut; 0 where they have to be held.

    Between two regions if there are two. Of a region larger than ``room`` the rows are in
    deeper regions whatever follows, so it may be cut between those. Rows that share a whole
    signature are cut anywhere: the caller repeats the last ones.
    """
    differ = key[1:] != key[:-1]
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        breaks = np.flatnonzero(differ[:, : 1 + 4 * depth].any(axis=1))
        if len(breaks):
            return int(breaks[-1]) + 1
        if len(key) <= room:
            return 0
    return len(key)


def _candidates(percent: int, room: int = 200_000, edges: bool = True):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Looks at sorted rows in stretches and hands on its first and last rows.

        A region that is cut, between stretches or between tasks, is whole again by rows that
        are looked at twice: ``WINDOW`` on each side decide as the whole region would, as a
        region is either that small or goes deeper. Rows with ``place`` are such edges.
        """
        held: list[np.ndarray] | None = None
        head: list[np.ndarray] | None = None
        tail: list[np.ndarray] | None = None
        width = 1 + 4 * DEPTH

        def found(rows):
            for a, b, open_ in neighbours(*rows, percent):
                low, high = np.minimum(a, b), np.maximum(a, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), pa.array(high), pa.array(open_), pa.nulls(len(a), pa.binary())],
                    names=["a", "b", "open", "place"],
                )

        def edge(rows):
            keys, ids, sizes = rows
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(sizes), pa.array(np.zeros(len(ids), bool)), pa.array([k.tobytes() for k in keys], pa.binary())],
                names=["a", "b", "open", "place"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("place").to_pylist()), np.uint8).reshape(-1, width)
            rows = [keys, batch.column("doc_id").to_numpy(), batch.column("n_shingles").to_numpy()]
            if head is None or len(head[0]) < WINDOW:
                head = [x[:WINDOW] for x in (rows if head is None else [np.concatenate(x) for x in zip(head, rows)])]
            tail = [x[-WINDOW:] for x in (rows if tail is None else [np.concatenate(x) for x in zip(tail, rows)])]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            at = _cut_at(rows[0], room)
            if not at:
                held = rows
                continue
            yield from found([x[:at] for x in rows])
            # Where the cut lies inside a region its last rows are looked at again.
            held = [x[max(0, at - WINDOW) if len(rows[0]) > room else at :] for x in rows]
        if held is not None:
            yield from found(held)
        if edges and head is not None:
            yield edge(head)
            yield edge(tail)

    return run


def candidates(ordered: DataFrame, percent: int, partitions: int, room: int = 200_000) -> DataFrame:
    """(a, b, open) of rows (place, doc_id, n_shingles), in ``partitions`` ranges of the order.

    The ranges may cut a region at any row. Each task hands on its first and last ``WINDOW``
    rows; these few, in order, are looked at once more.
    """
    kind = "a long, b long, open boolean, place binary"
    dealt = ordered.repartitionByRange(partitions, "place", "doc_id").sortWithinPartitions("place", "doc_id")
    near = cut(dealt.mapInArrow(_candidates(percent, room), kind).distinct())
    edges = near.where("place IS NOT NULL").select("place", F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    by_tree = edges.repartition(TREES, F.substring("place", 1, 1)).sortWithinPartitions("place", "doc_id")
    across = by_tree.mapInArrow(_candidates(percent, room, False), kind)
    return near.where("place IS NULL").unionByName(across).select("a", "b", "open").distinct()


def _sets(words: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.astype(np.int64) for s in shingle_sets(batch.column("text"), words)]
            edges = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sets or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), grams], names=["doc_id", "grams"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    first = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - F.col("shared")
    return (
        pairs.join(first, "a").join(second, "b").select("a", "b", "ga", "gb", shared.alias("shared"))
        .where(F.lit(100) * F.col("shared") >= F.lit(percent) * union).select("a", "b")
    )


def _blocks(percent: int):
    def run(key: tuple, block: pa.Table) -> pa.Table:
        """Links between the block's loose texts and its texts of other components.

        Only one link is kept for each loose text and component, so the result is linear.
        """
        block = block.combine_chunks()
        ids, roots = block["doc_id"].to_numpy(), block["root"].to_numpy()
        loose = np.flatnonzero(block["loose"].to_numpy(zero_copy_only=False))
        grams = [g.values.to_numpy() for g in block["grams"]]
        sizes = np.array([len(g) for g in grams])
        values, code = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(code, kind="stable")
        posting = owner[order]
        first = np.searchsorted(code[order], np.arange(len(values) + 1))
        at = np.r_[0, np.cumsum(sizes)]
        a, b = [], []
        for i in loose:
            own = code[at[i] : at[i + 1]]
            shared = np.zeros(len(ids), np.int64)
            for c in own:
                shared[posting[first[c] : first[c + 1]]] += 1
            hit = np.flatnonzero((100 * shared >= percent * (sizes + sizes[i] - shared)) & (roots != roots[i]))
            if len(hit):
                _, one = np.unique(roots[hit], return_index=True)
                a += [ids[i]] * len(one)
                b += list(ids[hit[one]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _open_links(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside open regions that lead from one component to another.

    ``members`` is (doc_id, region). The region's largest component needs no comparison within
    itself; every other text of the region is loose and meets all texts whose set size allows
    the similarity. Loose texts are dealt out in blocks of about ``BLOCK``, and a block meets the
    region's texts in blocks, so no region gathers in one task.
    """
    step = float(np.log(100 / percent)) if percent < 100 else 0.01
    known = (
        members.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .withColumn("root", F.coalesce("root", "doc_id"))
    )
    counts = known.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("region").agg(
        F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("all"), F.max("n").alias("most"),
    )
    mixed = ranked.where("parts > 1").select(
        "region", "main",
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / BLOCK)).cast("int").alias("rows"),
        F.greatest(F.lit(1), F.ceil(F.col("all") / (4 * BLOCK))).cast("int").alias("columns"),
    )
    known = known.join(mixed, "region").join(sets, "doc_id")
    band = F.floor(F.log(F.size("grams").cast("double")) / step).cast("int")
    part = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    dealt = known.withColumn("band", band).withColumn("loose", F.col("root") != F.col("main"))
    # A loose text goes to its own row of blocks, one of each size band that can hold a partner.
    side = dealt.where("loose").select(
        "region", "doc_id", "root", "grams", "loose", part(F.col("rows")).alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"), F.col("band"),
    )
    bands = side.select("region", F.col("r"), "band").distinct()
    others = dealt.select(
        "region", "doc_id", "root", "grams", part(F.col("columns")).alias("c"), "rows",
        F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
    ).join(bands, ["region", "band"]).select("region", "doc_id", "root", "grams", F.lit(False).alias("loose"), "r", "c", "band")
    tiles = side.select("region", "doc_id", "root", "grams", "loose", "r", "c", "band").unionByName(others)
    return tiles.groupBy("region", "r", "c", "band").applyInArrow(_blocks(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Texts are linked when 100 * |intersection| >= ``percent`` * |union| of their ``words``-word
    shingle sets; ``component_id`` is the smallest doc_id reachable. Null and empty texts and
    texts of white space have an empty set and are linked with nothing; a text of fewer words
    has its word sequence as its one shingle. Rows that repeat a doc_id are each returned, and
    are of one component with all that any of them is linked with. Rows with a null doc_id come
    back with a null component, kept. An empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is between 1 and 100")
    plain = texts(docs)
    marked = cut(
        plain.mapInArrow(
            _signatures(words), "doc_id long, n_shingles long, set_key binary, signature binary"
        )
    )
    linkable = marked.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = linkable.groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    copied = cut(classes.where("n > 1").select("set_key", "first"))
    single = linkable.join(copied, "set_key", "left")
    copies = single.where("first IS NOT NULL AND first != doc_id").select(
        F.col("first").alias("a"), F.col("doc_id").alias("b")
    )
    chosen = single.where("first IS NULL OR first = doc_id").select("doc_id", "n_shingles", "signature")
    # Rows that share a doc_id may hold different texts; each is placed in the trees.
    ordered = chosen.mapInArrow(_trees, "place binary, doc_id long, n_shingles long")
    partitions = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = cut(candidates(ordered, percent, partitions))
    pairs = near.where("NOT open AND a != b").select("a", "b").distinct()
    ties = near.where("open").select("a", "b")
    ids = cut(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    sets = cut(
        plain.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, grams array<long>").distinct()
    )
    links = cut(_confirm(pairs, sets, percent))
    roots = components(links)
    regions = components(ties)
    if regions.take(1):
        members = regions.select(F.col("id").alias("doc_id"), F.col("root").alias("region"))
        links = links.unionByName(cut(_open_links(members, roots, sets, percent)))
    settled = components(links.unionByName(copies))
    return (
        marked.select("doc_id", "n_shingles")
        .join(settled.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4)


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
