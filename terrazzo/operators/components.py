"""Connected components of an edge table by alternating star contraction.

The edge list is rewritten by large-star and small-star rounds (Kiveris et
al., "Connected Components in MapReduce and Beyond", SoCC 2014) until every
node points straight at the smallest node of its component. Each half-round is
one pre-aggregated minimum per node and one equi-join, so a hub with very many
neighbours only makes a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.storage import discard, materialize

#: Far above the O(log^2 n) rounds the contraction needs.
MAX_ROUNDS = 200


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with the minimum of their first node.

    The second key says nothing new, but the minima are not dealt by it yet:
    both sides of the join are exchanged, and adaptive execution can split the
    rows of a hub. With one key the aggregation's own partitioning would be
    reused and a hub's rows stay in one task.
    """
    keyed = low.withColumn("k", F.shiftright("a", 1))
    return edges.withColumn("k", F.shiftright("a", 1)).join(keyed, ["a", "k"]).drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_low(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = _with_low(edges, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node points at two others, or points and is pointed at."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("inn")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("inn")))
    # One sum a node, so the rows of a hub are summed where they lie.
    each = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("inn").alias("inn"))
    return each.where("out > 1 or (out > 0 and inn > 0)").limit(1).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another node.

    ``component`` is the smallest node reachable. Loops and null ends are
    ignored, repeated and two-way edges count once; an empty table gives an
    empty result. Nodes without links do not appear: callers coalesce.
    """
    spark = edges.sparkSession
    work = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    current, path = materialize(work, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(current):
            break
        following, new_path = materialize(_small_star(_large_star(current)), "edges")
        discard(spark, path)
        current, path = following, new_path
    else:
        raise RuntimeError("component contraction did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
