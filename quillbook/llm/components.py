"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edge list (no adjacency
list is ever collected) and ends in a scratch table.  The number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node of ``edges``; ``component`` is the
    smallest node reachable.  Loops and repeated edges do no harm; edges with a
    null end are ignored; no edges give no rows."""
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi.alias("u"), lo.alias("v"))
    now = scratch.table(now.distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every lower neighbour of a node, and the node, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        step = scratch.table(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.forget(now)
        now, before, mark = step, mark, _mark(step)
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
