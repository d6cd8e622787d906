"""Connected components of an edge table by alternating star contractions.

Each round rewires every node to the smallest neighbour it knows (large star,
then small star).  A round needs grouped minima and equi-joins only; no group is
gathered in one place, and the rows never outnumber twice the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provmill.llm.common import cut

#: Rounds needed grow with the logarithm of the longest path; beyond this many something is wrong.
MOST_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root) of each node with an edge to another; root is the least node reachable.

    Self loops and repeated edges change nothing; nulls have no edge.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        e = cut(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
