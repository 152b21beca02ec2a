"""Large question sets in pairs of blocks, and top-k over clusters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelode.operators import clusters, vector

CHUNKS = "chunk_id string, file_path string, embedding array<double>, mtime long"


@pytest.fixture(scope="module")
def library(spark):
    """Vectors around far centres, with ties, zeros, nulls, other lengths and values that are no number."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (12, 8))
    rows = [(f"c{i:04d}", f"f{i % 90}.md", (centres[i % 12] + rng.normal(0, 0.2, 8)).tolist(), i) for i in range(700)]
    rows += [("z", "z.md", [0.0] * 8, 1), ("e", "e.md", [], 2), ("n", "n.md", None, 3), ("s", "s.md", [1.0, 2.0], 4)]
    rows += [("nan", "nan.md", [float("nan")] + [1.0] * 7, 5), ("t1", "t.md", [3.0] * 8, 6), ("t2", "t.md", [3.0] * 8, 7)]
    return rows, spark.createDataFrame(rows, CHUNKS).repartition(5)


def rows_of(df, key):
    return sorted((r["query_id"], r["rank"], r[key], round(r["score"], 9) if r["score"] == r["score"] else None) for r in df.collect())


@pytest.mark.parametrize("most,chunks_of_block", [(1, 50), (7, 8192), (300, 3)])
def test_block_pairs_equal_one_scan(spark, library, monkeypatch, most, chunks_of_block):
    rows, frame = library
    asked = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows[::9]], "query_id string, path string, vector array<double>")
    monkeypatch.setattr(vector, "CHUNKS_PER_BLOCK", chunks_of_block)
    want = rows_of(vector.related_files(frame, asked, 4), "path")
    assert rows_of(vector.related_files(frame, asked, 4, max_questions=most), "path") == want
    plain = rows_of(vector.vector_top_k(frame, asked, 6), "chunk_id")
    assert rows_of(vector.vector_top_k(frame, asked, 6, max_questions=most), "chunk_id") == plain


def test_bytes_bound_blocks_too(spark, library, monkeypatch):
    _, frame = library
    monkeypatch.setattr(vector, "BLOCK_BYTES", 2_000)
    sizes = [r["n"] for r in vector._blocks(frame.select("chunk_id", "embedding"), 10_000).select(F.size("chunk_id").alias("n")).collect()]
    assert sum(sizes) == 707 and max(sizes) < 60


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_clusters_equal_the_whole_scan(spark, library, tmp_path, k):
    rows, frame = library
    clusters.write(frame, str(tmp_path), 12, sample=200)
    asked = spark.createDataFrame([(r[0], r[2]) for r in rows[::70]] + [("odd", [1.0]), ("none", None)], "query_id string, vector array<double>")
    boost = F.col("mtime") / 1000.0
    want = rows_of(vector.vector_top_k(frame, asked, k, boost), "chunk_id")
    assert rows_of(clusters.top_k_pruned(spark, str(tmp_path), asked, k, boost), "chunk_id") == want
    assert rows_of(clusters.top_k_pruned(spark, str(tmp_path), asked, k, boost, max_questions=2), "chunk_id") == want


def test_most_clusters_stay_unread(spark, library, tmp_path):
    rows, frame = library
    clusters.write(frame, str(tmp_path), 12)
    search = clusters.Pruned(spark, str(tmp_path), [{"query_id": "a", "vector": rows[0][2]}], 5, None)
    needed = search.needed()
    assert search.n[needed].sum() < 0.3 * search.n.sum()
    plan = search.read(needed)._jdf.queryExecution().toString()
    scan = search.chunks.where(F.col("cluster").isin(search.clusters[needed].tolist()))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cluster" in scan and "MapInArrow" in plan


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], CHUNKS)
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
    clusters.write(none, str(tmp_path), 4)
    assert clusters.top_k_pruned(spark, str(tmp_path), asked, 3).count() == 0
    assert vector.vector_top_k(none, asked, 3, max_questions=0).count() == 0


def test_rows_without_a_vector_are_scored_once():
    import pyarrow as pa

    from notelode.operators.vector import _worth

    keys = [f"f{i % 3}" if i % 50 else None for i in range(600)]
    vectors = [[1.0, i] if i % 200 == 1 else [] if i % 2 else None for i in range(600)]
    boost = [float(i % 7) for i in range(600)]
    columns = [pa.array(keys), pa.array(vectors, pa.list_(pa.float64())), pa.array(boost)]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "embedding", "boost"])
    by_file = _worth(batch, 5, True).to_pylist()
    assert len(by_file) == 3 + 3 and [r["key"] for r in by_file] == sorted((r["key"] for r in by_file), key=[r["key"] for r in by_file].index)
    assert {r["key"]: r["boost"] for r in by_file if not r["embedding"]} == {"f0": 6.0, "f1": 6.0, "f2": 6.0}
    first = _worth(batch, 5, False).to_pylist()
    assert len(first) == 3 + 5 and all(r["boost"] == 6.0 for r in first if not r["embedding"])


@pytest.mark.parametrize("limits", [{}, {"max_questions": 4}])
@pytest.mark.parametrize("files", [3, 400])
def test_related_files_among_rows_without_vectors_equal_a_plain_loop(spark, files, limits):
    rng = random.Random(files)
    rows = [(str(i), f"f{rng.randrange(files)}.md", [float(rng.randrange(-2, 3)) for _ in range(4)] if i % 5 == 0 else []) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, embedding array<double>").repartition(3)
    asked = [(f"q{i}", f"f{i}.md", [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(9)]
    want = []
    for name, path, q in asked:
        best = {}
        for _, file, v in rows:
            scale = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
            score = round(sum(x * y for x, y in zip(v, q)) / scale, 9) if scale else 0.0
            if file != path:
                best[file] = max(best.get(file, -2.0), score)
        want += [(name, file, score) for score, file in sorted((-s, f) for f, s in best.items())[:5]]
    found = vector.related_files(chunks, spark.createDataFrame(asked, "query_id string, path string, vector array<double>"), 5, **limits)
    got = [(r["query_id"], r["path"], -round(r["score"], 9) + 0.0) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(n, f, s + 0.0) for n, f, s in want]
