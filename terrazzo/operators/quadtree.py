"""Linear quadtrees as tables of leaves ``(code, level, color)``.

A code holds two bits per level, x in even and y in odd places, left-aligned
to the full resolution; the root has level 0. Nodes are counted bottom-up in
one grouped pass over all levels, so no level waits for another and white
space costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.operators.components import connected_components
from terrazzo.storage import materialize

WHITE, BLACK = "white", "black"
DIRECTIONS = ("east", "north", "west", "south")


def levels_of(rows: int, cols: int) -> int:
    return address.levels_for(rows, cols)


def _power4(k):
    return F.pow(F.lit(4.0), k.cast("double")).cast("long")


def leaves(black: DataFrame, levels: int) -> DataFrame:
    """Leaves of the image whose black cells are ``(x, y)``, over a square of side 2 ** levels.

    Cells that are not listed are white, padding included.
    """
    cells = black.select(address.morton("x", "y").alias("m"))
    up = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select("k", F.expr("shiftright(m, 2 * k)").alias("node"))
    counts = up.groupBy("k", "node").agg(F.count("*").alias("c"))
    mixed = counts.where(F.col("c") < _power4(F.col("k")))
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q")
    children = mixed.select((F.col("k") - 1).alias("k"), "node", quarter).select("k", (F.shiftleft("node", 2) + F.col("q")).alias("node"))
    below = children.join(counts, ["k", "node"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    uniform = below.where((F.col("c") == 0) | (F.col("c") == _power4(F.col("k"))))
    spark = black.sparkSession
    # The root is a leaf if it is all black, or has no cell at all.
    full = counts.where((F.col("k") == levels) & (F.col("c") == _power4(F.col("k"))))
    empty = spark.range(1).select(F.lit(levels).alias("k"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("c")).join(counts.where(F.col("k") == levels), ["k", "node"], "left_anti")
    every = uniform.select("k", "node", "c").unionByName(full.select("k", "node", "c")).unionByName(empty)
    return every.select((F.col("node") * _power4(F.col("k"))).alias("code"), (F.lit(levels) - F.col("k")).cast("int").alias("level"), F.when(F.col("c") > 0, BLACK).otherwise(WHITE).alias("color"))


def _sides(tree: DataFrame, levels: int) -> DataFrame:
    """Every leaf and direction with the code of the equal-sized neighbour inside the image."""
    x0, y0, x1, y1 = address.bounding_box("code", "level", levels)
    side = 1 << levels
    inside = F.element_at(F.array(x1 < side, y1 < side, x0 > 0, y0 > 0), F.col("d") + 1)
    dx, dy = (F.element_at(F.array(*[F.lit(o[k]) for o in address.COMPASS[::2]]), F.col("d") + 1) for k in (0, 1))
    spread = tree.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(inside)
    return spread.withColumn("to", address.neighbor("code", "level", levels, dx, dy))


def _ancestors(tree: DataFrame, levels: int, code: str, level: str) -> DataFrame:
    """Rows once for every enclosing quadrant of ``code``, from its own size up, as ``(_code, _level)``."""
    up = tree.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col(level))))
    rest = F.pow(F.lit(4.0), (F.lit(levels) - F.col("_level")).cast("double")).cast("long")
    return up.withColumn("_code", F.col(code) - F.pmod(F.col(code), rest))


def neighbors(tree: DataFrame, levels: int) -> DataFrame:
    """``(code, level, d, to_code, to_level, to_color)``: the leaf of the same or larger size on each side.

    Sides whose equal-sized neighbour is subdivided, or outside, have no row.
    An equi-join per enclosing quadrant replaces the walk up the tree.
    """
    looked = _ancestors(_sides(tree, levels), levels, "to", "level")
    other = tree.select(F.col("code").alias("_code"), F.col("level").alias("_level"), F.col("color").alias("to_color"))
    found = looked.join(other, ["_code", "_level"])
    return found.select("code", "level", "d", F.col("_code").alias("to_code"), F.col("_level").alias("to_level"), "to_color")


def level_differences(tree: DataFrame, levels: int) -> DataFrame:
    """``(code, level, color, east, north, west, south)``.

    1 where the equal-sized neighbour is subdivided, else the neighbour's level
    less the leaf's, at most 0; null at the border.
    """
    # Written once: four branches read it.
    tree, _ = materialize(tree, "leaves")
    sides = _sides(tree, levels).select("code", "level", "d")
    seen = neighbors(tree, levels).select("code", "level", "d", "to_level")
    diff = F.coalesce(F.col("to_level") - F.col("level"), F.lit(1))
    by = sides.join(seen, ["code", "level", "d"], "left").select("code", "level", "d", diff.alias("diff"))
    wide = by.groupBy("code", "level").agg(*[F.max(F.when(F.col("d") == k, F.col("diff"))).alias(n) for k, n in enumerate(DIRECTIONS)])
    return tree.join(wide, ["code", "level"], "left").select("code", "level", "color", *DIRECTIONS)


def components(tree: DataFrame, levels: int) -> DataFrame:
    """``(code, level, color, component)``: leaves of one colour that touch along sides.

    A touching pair is found from the smaller leaf, or from both if equal.
    ``component`` is the smallest code in it.
    """
    tree, _ = materialize(tree, "leaves")
    colors = tree.select(F.col("code").alias("_c"), F.col("color").alias("_own"))
    pairs = neighbors(tree, levels).join(colors, F.col("code") == F.col("_c")).where("_own = to_color")
    found = connected_components(pairs, "code", "to_code")
    return tree.join(found, F.col("code") == F.col("node"), "left").select("code", "level", "color", F.coalesce("component", "code").alias("component"))


def locate(tree: DataFrame, x, y, levels: int) -> DataFrame:
    """The leaf that holds cell (x, y)."""
    code = address.morton(F.lit(x), F.lit(y))
    rest = F.pow(F.lit(4.0), (F.lit(levels) - F.col("level")).cast("double")).cast("long")
    return tree.where(F.col("code") == code - F.pmod(code, rest))


def blocks(cells: DataFrame, size: int, on: int = 1) -> DataFrame:
    """``(bx, by, color)``: black, white or gray square blocks of ``(i, j, v)`` cells."""
    by = cells.groupBy(address.quotient("i", size).alias("bx"), address.quotient("j", size).alias("by"))
    flags = by.agg(F.bool_and(F.col("v") == on).alias("every"), F.bool_or(F.col("v") == on).alias("some"))
    return flags.select("bx", "by", F.when(F.col("every"), BLACK).when(F.col("some"), "gray").otherwise(WHITE).alias("color"))
