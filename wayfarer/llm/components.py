"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import cut

#: Edges per task: a round over few edges makes few tasks and few shuffle files.
TASK_EDGES = 200_000


def _oriented(pairs: DataFrame) -> DataFrame:
    return (
        pairs.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reachable.

    Nodes with many neighbours are reduced to their minimum before the shuffle; each
    round is checkpointed; the loop ends when a round changes nothing.
    """
    now, seen = cut(_oriented(edges)), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen, tasks = mark, 1 + mark[0] // TASK_EDGES
        now = now.coalesce(tasks)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _oriented(both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))).coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            low.select("a", F.col("m").alias("b"))
        )
        now = cut(_oriented(small).coalesce(tasks))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
