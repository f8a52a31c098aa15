"""Connected components of a graph given by its edges, by alternating large and small stars (Kiveris,
Lattanzi, Mirrokni, Rastogi, Vassilvitskii, "Connected components in MapReduce and beyond", SoCC 2014).

Each step is a grouped minimum (combined before it is shuffled) and an equi-join that adaptive execution can
split where one vertex has very many neighbours. No vertex's neighbours are gathered in a list, and nothing
but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Edges for each task that writes a round's edges, about, and such tasks at least: a file costs more than some thousand edges do.
TASK_EDGES, TASKS = 100_000, 16


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns ``a`` and ``b`` of one ordered type, without nulls; loops and repeats are harmless.

    Returns ``node, root``: every vertex that has an edge to another one but the roots themselves, with the least
    vertex that it can reach. An empty graph gives no rows.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, old = state, now
        now = written(_small_star(_large_star(old)).coalesce(max(TASKS, -(-state[0] // TASK_EDGES))), "edges")
        drop_written(old)
