"""Connected components of a graph that is far larger than the driver.

Alternates two joins on the edge table (every node points its neighbours to the
smallest of them) until nothing moves. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _sums(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
    return row.n, row.h


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that isn't its own root; ``root`` is the smallest node of the component.

    Null ends and loops are left out. The number of rounds grows with the logarithm of the longest path.
    """
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = e.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct()
    e = save(e, "edges")
    before = _sums(e)
    while True:
        # every larger neighbour of a node joins the smallest of its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e1 = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # every smaller neighbour of a node, and the node, join the smallest of them
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        down = e1.join(low, "a")
        e2 = down.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        e = save(e2, "edges")
        after = _sums(e)
        if after == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
