"""Box counting and multifractal measures, all categories and scales in one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.raster import Raster


def box_masses(raster: Raster, epsilons: Sequence[int]) -> DataFrame:
    """``(v, eps, nx, ny, bx, by, mass)``: cells of a category in every box it occupies.

    ``nx = rows div eps`` by ``ny = cols div eps`` boxes divide the raster
    evenly; scales above a side have no boxes and give no row.
    """
    scales = [(e, raster.rows // e, raster.cols // e) for e in dict.fromkeys(epsilons) if 0 < e <= min(raster.rows, raster.cols)]
    if not scales:
        return raster.cells.sparkSession.createDataFrame([], "v int, eps long, nx long, ny long, bx long, by long, mass long")
    e = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("eps"), F.lit(a).cast("long").alias("nx"), F.lit(b).cast("long").alias("ny")) for x, a, b in scales]))
    spread = raster.cells.select("v", "i", "j", e.alias("e")).select("v", "e.*", "i", "j")
    bx, by = address.quotient(F.col("i") * F.col("nx"), raster.rows), address.quotient(F.col("j") * F.col("ny"), raster.cols)
    return spread.groupBy("v", "eps", "nx", "ny", bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("mass"))


def box_count(raster: Raster, epsilons: Sequence[int]) -> DataFrame:
    """``(v, eps, boxsize, boxes, log_boxsize, log_boxes)``; boxsize is rows / nx, logs are decimal."""
    by = box_masses(raster, epsilons).groupBy("v", "eps", "nx").agg(F.count("*").alias("boxes"))
    size = F.lit(float(raster.rows)) / F.col("nx")
    return by.select("v", "eps", size.alias("boxsize"), "boxes", F.log10(size).alias("log_boxsize"), F.log10("boxes").alias("log_boxes"))


def box_count_scaled(raster: Raster, levels: Sequence[int], extent: tuple[float, float] | None = None) -> DataFrame:
    """``(v, level, division, boxes, log_boxes, log_level, ratio)`` for so many divisions of each side.

    Boxes are numbered floor(x * level / extent); levels up to 1 give no row.
    """
    xmax, ymax = extent or (float(raster.rows), float(raster.cols))
    wanted = [x for x in dict.fromkeys(levels) if x > 1]
    if not wanted:
        return raster.cells.sparkSession.createDataFrame([], "v int, level long, division double, boxes long, log_boxes double, log_level double, ratio double")
    spread = raster.cells.select("v", "i", "j", F.explode(F.array(*[F.lit(x).cast("long") for x in wanted])).alias("level"))
    bx, by = F.floor(F.col("i") * F.col("level") / F.lit(xmax)), F.floor(F.col("j") * F.col("level") / F.lit(ymax))
    boxes = spread.select("v", "level", bx.alias("bx"), by.alias("by")).distinct().groupBy("v", "level").agg(F.count("*").alias("boxes"))
    ln, ll = F.log(F.col("boxes").cast("double")), F.log(F.col("level").cast("double"))
    return boxes.select("v", "level", (F.lit(1.0) / F.col("level")).alias("division"), "boxes", ln.alias("log_boxes"), ll.alias("log_level"), (ln / ll).alias("ratio"))


def mass_exponents(raster: Raster, epsilons: Sequence[int], qs: Sequence[float]) -> DataFrame:
    """``(v, eps, q, value)``: sums of box masses to the power q over occupied boxes."""
    each = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    # Masses repeat a lot: one row per distinct mass before the powers.
    masses = box_masses(raster, epsilons).groupBy("v", "eps", "mass").agg(F.count("*").alias("boxes"))
    return masses.select("v", "eps", "mass", "boxes", each).groupBy("v", "eps", "q").agg(F.sum(F.col("boxes") * F.pow(F.col("mass").cast("double"), F.col("q"))).alias("value"))


def box_entropy(raster: Raster, epsilons: Sequence[int]) -> DataFrame:
    """``(v, eps, scale, entropy, shannon)``.

    ``entropy`` sums f ln f for f = mass over box area; ``shannon`` is
    -sum p ln p for p = mass over all of the category. ``scale`` is the root of
    the box area.
    """
    masses = box_masses(raster, epsilons).groupBy("v", "eps", "nx", "ny", "mass").agg(F.count("*").alias("boxes"))
    total = masses.groupBy("v", "eps").agg(F.sum(F.col("mass") * F.col("boxes")).alias("total"))
    cell = F.lit(float(raster.rows)) * F.lit(float(raster.cols)) / F.col("nx") / F.col("ny")
    f, p = F.col("mass") / cell, F.col("mass") / F.col("total")
    return masses.join(total, ["v", "eps"]).groupBy("v", "eps", "nx", "ny").agg(F.sum(F.col("boxes") * f * F.log(f)).alias("entropy"), (-F.sum(F.col("boxes") * p * F.log(p))).alias("shannon")).select("v", "eps", F.sqrt(cell).alias("scale"), "entropy", "shannon")


def fractal_dimension(raster: Raster, epsilons: Sequence[int]) -> DataFrame:
    """``(v, dimension, r2, scales)``: minus the slope of log boxes over log box size."""
    curve = box_count(raster, epsilons)
    return curve.groupBy("v").agg((-F.regr_slope("log_boxes", "log_boxsize")).alias("dimension"), F.regr_r2("log_boxes", "log_boxsize").alias("r2"), F.count("*").alias("scales"))
