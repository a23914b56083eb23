"""Synthetic rasters, and rasters derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.raster import Raster, from_rows, grid


def rectangles(r0: int, r1: int, c0: int, c1: int, lo: int, hi: int) -> list[tuple[int, ...]]:
    """Bisection of a region into ``(r0, r1, c0, c1, v)``, one rectangle per value.

    The taller side is halved, the columns on a tie; values are halved along.
    A region of one cell takes the lowest value left.
    """
    if hi - lo <= 1 or (r1 - r0) * (c1 - c0) <= 1:
        return [(r0, r1, c0, c1, lo)]
    mid = (lo + hi) // 2
    if r1 - r0 > c1 - c0:
        cut = (r0 + r1) // 2
        return rectangles(r0, cut, c0, c1, lo, mid) + rectangles(cut, r1, c0, c1, mid, hi)
    cut = (c0 + c1) // 2
    return rectangles(r0, r1, c0, cut, lo, mid) + rectangles(r0, r1, cut, c1, mid, hi)


def multi_value(spark: SparkSession, rows: int, cols: int, lo: int, hi: int) -> Raster:
    """Raster of hi - lo rectangles of one category each; at most 256."""
    if not 0 <= lo < hi <= 256:
        raise ValueError("categories lie between 0 and 255")
    if rows * cols < hi - lo:
        raise ValueError("fewer cells than categories")
    parts = spark.createDataFrame(rectangles(0, rows, 0, cols, lo, hi), "r0 long, r1 long, c0 long, c1 long, v int")
    cells = parts.select(F.explode(F.sequence("r0", F.col("r1") - 1)).alias("i"), "c0", "c1", "v")
    return Raster(cells.select("i", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("j"), "v"), rows, cols)


def make_data(spark: SparkSession, rows: int, cols: int, block: int, levels: int, order: str = "linear") -> DataFrame:
    """``multi_value`` cells with ``slot``, their place in a storage order."""
    orders = {
        "linear": address.linear("i", "j", cols),
        "blocked": address.blocked("i", "j", cols, block),
        "full_blocked": address.full_blocked("i", "j", cols, block),
        "morton": address.morton("i", "j"),
    }
    return multi_value(spark, rows, cols, 0, levels).cells.withColumn("slot", orders[order])


def hash_pattern(spark: SparkSession, rows: int = 256, cols: int = 512) -> Raster:
    v = F.pmod(F.col("i") * 3571 + F.col("j") * 2663, F.lit(256)).cast("int")
    return Raster(grid(spark, rows, cols).withColumn("v", v), rows, cols)


def embedding_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """Three categories by component size: a row per vector, a column per component."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x"))
    x = F.col("x").cast("double")
    v = F.when(x > 0.05, 2).when(x > -0.05, 1).otherwise(0)
    cells = vectors.select("i", F.col("j").cast("long").alias("j"), v.cast("int").alias("v"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
    return Raster(cells, int(rows or 0) + 1, 64)


def shipping_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """Weeks by quantity: category least(rows / 2, 3), 0 where nothing was shipped."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01")))
    counts = items.select(address.quotient(days, 7).alias("i"), (F.col("l_quantity").cast("long") - 1).alias("j")).groupBy("i", "j").agg(F.count("*").alias("c"))
    rows = int(items.agg(F.max(days)).first()[0] or 0) // 7 + 1
    v = F.least(address.quotient(F.coalesce("c", F.lit(0)), 2), F.lit(3)).cast("int")
    cells = grid(spark, rows, 50).join(counts, ["i", "j"], "left").select("i", "j", v.alias("v"))
    return Raster(cells, rows, 50)


# An 8 x 8 example image, rows from north to south.
_IMAGE = ("11111000", "11111000", "11111100", "11111100", "00001111", "00001111", "00000000", "00000000")


def example_image(spark: SparkSession) -> Raster:
    """The example image with i running east and j north."""
    north = from_rows(spark, [[int(c) for c in row] for row in _IMAGE])
    return north.transpose().flip_cols()


def spiral(spark: SparkSession, side: int = 64) -> Raster:
    """One-cell-wide square spiral of 1s in a field of 0s."""
    import numpy as np

    a = np.zeros((side, side), np.uint8)
    r, c, dr, dc = 0, 0, 0, 1
    a[r, c] = 1

    def free(r: int, c: int) -> bool:
        return 0 <= r < side and 0 <= c < side and not a[r, c]

    while True:
        ahead, beyond = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
        inside = 0 <= beyond[0] < side and 0 <= beyond[1] < side
        if not free(*ahead) or (inside and a[beyond]):
            dr, dc = dc, -dr
            ahead, beyond = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
            inside = 0 <= beyond[0] < side and 0 <= beyond[1] < side
            if not free(*ahead) or (inside and a[beyond]):
                return Raster.from_array(spark, a)
        r, c = ahead
        a[r, c] = 1


def serpentine(spark: SparkSession, side: int = 64) -> Raster:
    i, j = F.col("i"), F.col("j")
    on = (i % 2 == 0) | ((i % 4 == 1) & (j == side - 1)) | ((i % 4 == 3) & (j == 0))
    return Raster(grid(spark, side, side).withColumn("v", on.cast("int")), side, side)
