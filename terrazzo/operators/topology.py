"""Neighbourhood as joins: cell edges, seams between rectangles, runs that overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.raster import Raster

#: Row and column steps in the order right, down, left, up; the last four are the diagonals.
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, -1), (-1, 1))


def _shifted(cells: DataFrame, steps) -> DataFrame:
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in steps]))
    return cells.withColumn("_o", offsets).select("*", (F.col("i") + F.col("_o.di")).alias("_i"), (F.col("j") + F.col("_o.dj")).alias("_j")).drop("_o")


def neighbor_edges(raster: Raster) -> DataFrame:
    """``(s, t)`` for every cell and each of its up to four neighbours, both ways."""
    n = raster.with_index("s").select("i", "j", "s")
    to = raster.with_index("t").select(F.col("i").alias("_i"), F.col("j").alias("_j"), "t")
    return _shifted(n, STEPS[:4]).join(to, ["_i", "_j"]).select("s", "t")


def same_value_edges(raster: Raster, predicate: Callable[[Column, Column], Column] | None = None, connectivity: int = 4) -> DataFrame:
    """``(s, t)``, s < t, of neighbours in one category, or that ``predicate(v of s, v of t)`` accepts."""
    steps = STEPS[:2] if connectivity == 4 else (STEPS[0], STEPS[1], STEPS[4], STEPS[5])
    s = _shifted(raster.with_index("s").select("i", "j", "s", "v"), steps)
    t = raster.with_index("t").select(F.col("i").alias("_i"), F.col("j").alias("_j"), "t", F.col("v").alias("_v"))
    if predicate is None:
        joined = s.join(t.withColumnRenamed("_v", "v"), ["_i", "_j", "v"])
    else:
        joined = s.join(t, ["_i", "_j"]).where(predicate(F.col("v"), F.col("_v")))
    return joined.select("s", "t")


def right_edges(raster: Raster) -> DataFrame:
    """Same-category edges along rows, by a window instead of a join."""
    row = Window.partitionBy("i").orderBy("j")
    ahead = raster.with_index("s").select("s", "v", "j", F.lead("s").over(row).alias("t"), F.lead("v").over(row).alias("_v"), F.lead("j").over(row).alias("_j"))
    return ahead.where((F.col("v") == F.col("_v")) & (F.col("_j") == F.col("j") + 1)).select("s", "t")


def neighbor_degree(raster: Raster) -> DataFrame:
    """``(degree, cells)``: how many cells have so many neighbours inside the domain."""
    degree = neighbor_edges(raster).groupBy("s").agg(F.count("*").alias("degree"))
    return degree.groupBy("degree").agg(F.count("*").alias("cells"))


def seen_neighbors(raster: Raster) -> DataFrame:
    """``n`` of cells with an equal neighbour earlier in scan order (left or above)."""
    here = _shifted(raster.with_index().select("i", "j", "n", "v"), STEPS[2:4])
    earlier = raster.cells.select(F.col("i").alias("_i"), F.col("j").alias("_j"), "v")
    return here.join(earlier, ["_i", "_j", "v"], "left_semi").select("n").distinct()


def tiles(raster: Raster, size: int) -> DataFrame:
    """``(bi, bj, r0, r1, c0, c1)``: the rectangles of a tiling, half-open."""
    spark = raster.cells.sparkSession
    down, across = -(-raster.rows // size), -(-raster.cols // size)
    bi, bj = address.unlinear("id", max(1, across))
    g = spark.range(down * across).select(bi.alias("bi"), bj.alias("bj"))
    end = lambda b, n: F.least((F.col(b) + 1) * size, F.lit(n))
    return g.select("bi", "bj", (F.col("bi") * size).alias("r0"), end("bi", raster.rows).alias("r1"), (F.col("bj") * size).alias("c0"), end("bj", raster.cols).alias("c1"))


def tile_adjacency(rects: DataFrame) -> DataFrame:
    """``(ai, aj, bi, bj)``: tiles and the tile to their right or below."""
    offsets = F.explode(F.array(F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")), F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj"))))
    a = rects.select(F.col("bi").alias("ai"), F.col("bj").alias("aj"), offsets.alias("o")).select("ai", "aj", (F.col("ai") + F.col("o.di")).alias("bi"), (F.col("aj") + F.col("o.dj")).alias("bj"))
    return a.join(rects.select("bi", "bj"), ["bi", "bj"]).select("ai", "aj", "bi", "bj")


def seams(rects: DataFrame, name: str = "name") -> DataFrame:
    """``(a, b, vertical, line, lo, hi)``: shared sides of rectangles ``(name, r0, r1, c0, c1)``.

    ``line`` is where b starts, ``lo`` to ``hi`` the half-open overlap along
    it. Rectangles that touch at a corner or lie apart share nothing. Sides
    meet on an equi-join of their line; the overlap is its residual.
    """
    a = rects.select(F.col(name).alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("r0", "r1", "c0", "c1")])
    b = rects.select(F.col(name).alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("r0", "r1", "c0", "c1")])
    parts = []
    for vertical, end, start, lo, hi in ((True, "c1", "c0", "r0", "r1"), (False, "r1", "r0", "c0", "c1")):
        meet = (F.col(f"a_{end}") == F.col(f"b_{start}")) & (F.col(f"a_{lo}") < F.col(f"b_{hi}")) & (F.col(f"b_{lo}") < F.col(f"a_{hi}"))
        parts.append(
            a.join(b, meet).select("a", "b", F.lit(vertical).alias("vertical"), F.col(f"b_{start}").alias("line"), F.greatest(f"a_{lo}", f"b_{lo}").alias("lo"), F.least(f"a_{hi}", f"b_{hi}").alias("hi"))
        )
    return parts[0].unionByName(parts[1])


def seam_edges(found: DataFrame, cols: int) -> DataFrame:
    """``(s, t)``: the cell pairs that lie across the seams."""
    along = found.withColumn("k", F.explode(F.sequence("lo", F.col("hi") - 1)))
    s = F.when(F.col("vertical"), address.linear("k", F.col("line") - 1, cols)).otherwise(address.linear(F.col("line") - 1, "k", cols))
    t = F.when(F.col("vertical"), address.linear("k", "line", cols)).otherwise(address.linear("line", "k", cols))
    return along.select(s.alias("s"), t.alias("t"))


def run_overlaps(runs: DataFrame) -> DataFrame:
    """``(i, j0, below)``: runs and the start of each run under them that they touch, of one category."""
    a = runs.select(F.col("i"), F.col("j0"), F.col("j1"), F.col("v"), (F.col("i") + 1).alias("_i"))
    b = runs.select(F.col("i").alias("_i"), F.col("j0").alias("below"), F.col("j1").alias("_j1"), "v")
    return a.join(b, ["_i", "v"]).where((F.col("j0") <= F.col("_j1")) & (F.col("below") <= F.col("j1"))).select("i", "j0", "below")


def seam_value_edges(raster: Raster, size: int) -> DataFrame:
    """Same-category edges that cross tile sides; only border cells are joined."""
    cells = raster.with_index("s")
    right = cells.where(F.col("j") % size == size - 1).select("s", "v", F.col("i").alias("_i"), (F.col("j") + 1).alias("_j"))
    down = cells.where(F.col("i") % size == size - 1).select("s", "v", (F.col("i") + 1).alias("_i"), F.col("j").alias("_j"))
    to = cells.where((F.col("j") % size == 0) | (F.col("i") % size == 0)).select(F.col("s").alias("t"), "v", F.col("i").alias("_i"), F.col("j").alias("_j"))
    return right.unionByName(down).join(to, ["_i", "_j", "v"]).select("s", "t")
