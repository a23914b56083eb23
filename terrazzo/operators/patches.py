"""Patch metrics over labelled cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.operators.topology import STEPS, same_value_edges
from terrazzo.raster import Raster


def patch_edges(raster: Raster, labels: DataFrame) -> DataFrame:
    """``(cluster_id, edges)``: neighbour pairs inside each cluster; clusters of one cell have none."""
    own = same_value_edges(raster).join(labels.select(F.col("n").alias("s"), "cluster_id"), "s")
    return own.groupBy("cluster_id").agg(F.count("*").alias("edges"))


def category_graph(raster: Raster, v: int) -> tuple[DataFrame, DataFrame]:
    """Nodes ``n`` and edges ``(s, t)`` of one category, isolated nodes included."""
    part = Raster(raster.category(v), raster.rows, raster.cols)
    return part.with_index().select("n"), same_value_edges(part)


def border_types(labels: DataFrame) -> DataFrame:
    """``(cluster_id, types)``: other categories that touch each cluster."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in STEPS[:4]]))
    here = labels.select("cluster_id", "v", "i", "j", steps.alias("o")).select("cluster_id", "v", (F.col("i") + F.col("o.di")).alias("_i"), (F.col("j") + F.col("o.dj")).alias("_j"))
    there = labels.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return here.join(there, ["_i", "_j"]).where("v <> _v").groupBy("cluster_id").agg(F.countDistinct("_v").alias("types"))


def patch_metrics(labels: DataFrame, ct: int | str = 15) -> DataFrame:
    """``(v, cluster_id, area, perimeter, mod_perimeter, div_perimeter)`` per cluster.

    The perimeter counts cell sides on the cluster's outline, raster borders
    included. ``mod_perimeter`` is (P + 2 (A - 1)) / 4; ``div_perimeter``
    weighs the second term by touching categories over ``ct`` - 1. ``ct`` is
    the number of categories, or ``"auto"`` to count them.

    One pass joins every cell with its neighbours: sides towards the same
    cluster are not outline, categories on the others are border types.
    """
    if ct == "auto":
        ct = max(2, labels.agg(F.countDistinct("v")).first()[0])
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in STEPS[:4]]))
    here = labels.select("cluster_id", "v", "n", "i", "j", steps.alias("o")).select("cluster_id", "v", "n", (F.col("i") + F.col("o.di")).alias("_i"), (F.col("j") + F.col("o.dj")).alias("_j"))
    there = labels.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    met = here.join(there, ["_i", "_j"], "left")
    # Per category met: few rows a cluster, so that the distinct count needs no second shuffle of cells.
    by = met.groupBy("v", "cluster_id", "_v").agg(F.count("*").alias("sides"))
    total = by.groupBy("v", "cluster_id").agg(
        F.sum("sides").alias("all_sides"),
        F.sum(F.when(F.col("_v") == F.col("v"), F.col("sides")).otherwise(0)).alias("inner"),
        F.count(F.when(F.col("_v") != F.col("v"), 1)).alias("types"),
    )
    area, peri = (F.col("all_sides") / 4).cast("long"), F.col("all_sides") - F.col("inner")
    more = 2 * (F.col("area") - 1)
    return (
        total.select("v", "cluster_id", "types", area.alias("area"), peri.alias("perimeter"))
        .withColumn("mod_perimeter", (F.col("perimeter") + more) / F.lit(4.0))
        .withColumn("div_perimeter", (F.col("perimeter") + more * F.col("types") / F.lit(float(ct - 1))) / F.lit(4.0))
        .select("v", "cluster_id", "area", "perimeter", "mod_perimeter", "div_perimeter")
    )


def landscape_report(raster: Raster, v: int | None = None, ct: int | str = 15, **how) -> tuple[DataFrame, DataFrame]:
    """Size distribution and patch metrics of all categories, or of one."""
    from terrazzo.operators.clusters import label, size_distribution

    labels = label(raster, **how)
    metrics, distribution = patch_metrics(labels, ct), size_distribution(labels)
    if v is None:
        return distribution, metrics
    return distribution.where(F.col("v") == v), metrics.where(F.col("v") == v)
