"""Regressions over every window of an ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_regressions(series: DataFrame, x: str, y: str, order: str, min_points: int = 5, compat: bool = False) -> DataFrame:
    """``(start, width, slope, intercept, r, ssr, mssr)`` of every run of at least ``min_points`` points.

    A window's sums are differences of running sums, so each of the n (n + 1) / 2
    windows costs one join row, whatever its width. Values are centred on the
    series' means first. ``compat`` reports r + 1. A constant y has r null.
    """
    everything = Window.orderBy(order)
    upto = everything.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = Window.partitionBy(F.lit(1))
    pts = series.select(F.col(order), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pts = pts.withColumn("mx", F.avg("x").over(mean)).withColumn("my", F.avg("y").over(mean))
    cx, cy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = {"sx": cx, "sy": cy, "sxx": cx * cx, "sxy": cx * cy, "syy": cy * cy}
    last = (F.count("*").over(mean) - 1).alias("last")
    run = pts.select((F.row_number().over(everything) - 1).cast("long").alias("k"), last, "mx", "my", *[F.sum(e).over(upto).alias(n) for n, e in sums.items()], *[e.alias(f"o_{n}") for n, e in sums.items()])
    a = run.select(F.col("k").alias("start"), "last", *[(F.col(n) - F.col(f"o_{n}")).alias(f"a_{n}") for n in sums])
    b = run.select(F.col("k").alias("end"), "mx", "my", *[F.col(n).alias(f"b_{n}") for n in sums])
    ends = F.explode(F.sequence(F.col("start") + (min_points - 1), F.col("last")))
    w = a.where(F.col("start") + (min_points - 1) <= F.col("last")).withColumn("end", ends).join(b, "end")
    w = w.select("start", (F.col("end") - F.col("start") + 1).alias("width"), "mx", "my", *[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(n) for n in sums])
    n = F.col("width").cast("double")
    w = w.withColumn("qx", F.col("sxx") - F.col("sx") * F.col("sx") / n).withColumn("qy", F.greatest(F.lit(0.0), F.col("syy") - F.col("sy") * F.col("sy") / n)).withColumn("qxy", F.col("sxy") - F.col("sx") * F.col("sy") / n)
    slope = F.when(F.col("qx") > 0, F.col("qxy") / F.col("qx"))
    intercept = (F.col("sy") / n + F.col("my")) - slope * (F.col("sx") / n + F.col("mx"))
    r = F.when((F.col("qx") > 0) & (F.col("qy") > 0), F.col("qxy") / F.sqrt(F.col("qx") * F.col("qy")))
    ssr = F.greatest(F.lit(0.0), F.col("qy") - F.when(F.col("qx") > 0, F.col("qxy") * F.col("qxy") / F.col("qx")))
    return w.select("start", "width", slope.alias("slope"), intercept.alias("intercept"), (r + 1 if compat else r).alias("r"), ssr.alias("ssr"), (ssr / n).alias("mssr"))


def best_window(windows: DataFrame, least_width: int = 5) -> DataFrame:
    """The window of smallest mean SSR, then largest r, then earliest and widest."""
    kept = windows.where((F.col("width") >= least_width) & F.col("r").isNotNull())
    return kept.orderBy(F.round("mssr", 9), F.desc(F.round("r", 9)), "start", F.desc("width")).limit(1)
