"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

MAX_ROUNDS = 60
# A task holds about so many edges; small edge tables are then not spread over many tiny files.
TASK_EDGES = 50_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    moved = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.where("x != y").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = edges.groupBy("x").agg(F.min("y").alias("m"))
    moved = edges.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    known = least.select("x", F.col("m").alias("y"))
    return moved.unionByName(known).where("x != y").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every node that an edge names; root is the component's smallest id.

    Each round is two aggregations whose partial sums run before the shuffle; edges only ever
    shrink towards stars, so a component of any size never meets in one task. Loops and repeated
    edges are allowed.
    """
    current = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
        .distinct()
    )

    def state(frame: DataFrame) -> tuple:
        row = frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = state(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        tasks = 1 + before[0] // TASK_EDGES
        current = cut(_small_star(_large_star(current.coalesce(tasks), tasks), tasks))
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("y").distinct().select(F.col("y").alias("id"), F.col("y").alias("root"))
    return current.select(F.col("x").alias("id"), F.col("y").alias("root")).unionByName(roots)
