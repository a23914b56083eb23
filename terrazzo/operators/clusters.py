"""Clusters: four-connected components of equal category.

``label`` has two strategies of one contract, ``cluster_id`` being the smallest
row-major index of the cluster. ``tiles`` labels square tiles inside one task
each, then contracts the graph of labels that touch across tile sides. ``runs``
is relational throughout: row runs are the nodes, overlaps between rows the
edges. Neither keeps more than a tile or a partition in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.operators.components import connected_components
from terrazzo.operators.labels import merge_labels
from terrazzo.operators.series import numbered
from terrazzo.operators.topology import same_value_edges, seam_value_edges
from terrazzo.raster import Raster
from terrazzo.storage import materialize

TILE = 256


def _label_tile(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smallest index of each cell's component inside the tile."""
    order = np.argsort(n, kind="stable")
    i, j, v, sorted_n = i[order], j[order], v[order], n[order]
    pairs = []
    same = np.flatnonzero((i[1:] == i[:-1]) & (j[1:] == j[:-1] + 1) & (v[1:] == v[:-1]))
    pairs.append((same, same + 1))
    width = int(j.max() - j.min()) + 1
    place = (i - i.min()) * width + (j - j.min())
    slot = np.full(int(place.max()) + 1 + width, -1, np.int64)
    slot[place] = np.arange(len(place))
    below = slot[place + width]
    down = np.flatnonzero(below >= 0)
    down = down[v[down] == v[below[down]]]
    pairs.append((down, below[down]))
    labels = merge_labels(np.arange(len(order)), *map(np.concatenate, zip(*pairs)))
    out = np.empty(len(order), np.int64)
    out[order] = sorted_n[labels]
    return out


def _tile_labels(raster: Raster, size: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        i, j, v, n = (table.column(c).to_numpy() for c in ("i", "j", "v", "n"))
        return pa.table({"n": table.column("n"), "i": table.column("i"), "j": table.column("j"), "v": table.column("v"), "part": _label_tile(i, j, v, n)})

    keyed = raster.with_index().select("i", "j", "v", "n", address.quotient("i", size).alias("bi"), address.quotient("j", size).alias("bj"))
    return keyed.groupBy("bi", "bj").applyInArrow(run, "n long, i long, j long, v int, part long")


def label(raster: Raster, strategy: str = "tiles", tile: int = TILE, predicate: Callable[[Column, Column], Column] | None = None, connectivity: int = 4) -> DataFrame:
    """``(n, i, j, v, cluster_id)`` for every cell; cells alone are clusters too.

    A ``predicate`` on the categories of neighbours, or 8-connectivity, goes
    by cell edges whatever the strategy.
    """
    if predicate is not None or connectivity != 4:
        found = connected_components(same_value_edges(raster, predicate, connectivity), "s", "t")
        cells = raster.with_index()
        return cells.join(found, F.col("n") == F.col("node"), "left").select("n", "i", "j", "v", F.coalesce("component", "n").alias("cluster_id"))
    if strategy == "tiles":
        parts, _ = materialize(_tile_labels(raster, tile), "tiles")
        links = seam_value_edges(Raster(parts, raster.rows, raster.cols), tile)
        border = parts.where((F.col("i") % tile).isin(0, tile - 1) | (F.col("j") % tile).isin(0, tile - 1)).select("n", "part")
        a = links.join(border.select(F.col("n").alias("s"), F.col("part").alias("a")), "s")
        ab = a.join(border.select(F.col("n").alias("t"), F.col("part").alias("b")), "t")
        found = connected_components(ab.select("a", "b"))
        return parts.join(found, F.col("part") == F.col("node"), "left").select("n", "i", "j", "v", F.coalesce("component", "part").alias("cluster_id"))
    if strategy == "runs":
        from terrazzo.operators.topology import run_overlaps

        runs, _ = materialize(raster.runs(), "runs")
        touch = run_overlaps(runs).select(address.linear("i", "j0", raster.cols).alias("a"), address.linear(F.col("i") + 1, "below", raster.cols).alias("b"))
        found = connected_components(touch)
        start = address.linear("i", "j0", raster.cols)
        named = runs.withColumn("_n", start).join(found, F.col("_n") == F.col("node"), "left").withColumn("cluster_id", F.coalesce("component", "_n"))
        cells = named.select("i", F.explode(F.sequence("j0", "j1")).alias("j"), "v", "cluster_id")
        return cells.select(address.linear("i", "j", raster.cols).alias("n"), "i", "j", "v", "cluster_id")
    raise ValueError(f"no strategy {strategy!r}")


# One operator under the names that raster users know it by.
find_clusters = find_clusters_twopass = find_clusters_pointer = find_clusters_remap = label


def coords(labels: DataFrame, cols: int) -> DataFrame:
    """``(rep_i, rep_j, i, j)``: cells with the coordinates of their cluster's first cell."""
    ri, rj = address.unlinear("cluster_id", cols)
    return labels.select(ri.alias("rep_i"), rj.alias("rep_j"), "i", "j")


def members(labels: DataFrame) -> DataFrame:
    """``(cluster_id, members)`` with ascending members; clusters order by id."""
    return labels.groupBy("cluster_id").agg(F.sort_array(F.collect_list("n")).alias("members"))


def ranked(labels: DataFrame) -> DataFrame:
    """``(k, cluster_id)``: clusters numbered from 0 in order of their first cell."""
    return numbered(labels.where("n = cluster_id").select("cluster_id").orderBy("cluster_id"), "k").select("k", "cluster_id")


def at(labels: DataFrame, k: int) -> DataFrame:
    """Cells ``n`` of the k-th cluster, by a bounded top-k instead of a full ranking."""
    kth = labels.where("n = cluster_id").select("cluster_id").orderBy("cluster_id").limit(k + 1).agg(F.max("cluster_id").alias("cluster_id"), F.count("*").alias("c")).where(F.col("c") == k + 1)
    return labels.join(F.broadcast(kth.select("cluster_id")), "cluster_id", "left_semi").select("n")


def count(labels: DataFrame) -> DataFrame:
    """``(v, clusters)`` per category, and over all with a null category."""
    return labels.where("n = cluster_id").rollup("v").agg(F.count("*").alias("clusters"))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("v", "cluster_id").agg(F.count("*").alias("size"))


def size_distribution(labels: DataFrame, compat: bool = False) -> DataFrame:
    """``(v, bin, clusters, before)``: clusters of every size up to a category's largest, and how many are smaller.

    With ``compat``, bins are as many equal widths between the smallest and
    largest size as the largest size has units.
    """
    by = sizes(labels)
    span = by.groupBy("v").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    if compat:
        width = (F.col("hi") - F.col("lo")).cast("double")
        bin_ = F.when(width > 0, F.least(F.floor((F.col("size") - F.col("lo")) * F.col("hi") / width), F.col("hi") - 1)).otherwise(F.floor(F.col("hi") / 2))
        counted = by.join(span, "v").select("v", (bin_ + 1).cast("long").alias("bin"))
    else:
        counted = by.select("v", F.col("size").alias("bin"))
    # Sizes that occur are few; sums run over those, and the bins between two of them are filled in.
    counted = counted.groupBy("v", "bin").agg(F.count("*").alias("clusters"))
    ends = span.select("v", F.col("hi").alias("bin"), F.lit(0).cast("long").alias("clusters"))
    counted = counted.unionByName(ends).groupBy("v", "bin").agg(F.sum("clusters").alias("clusters"))
    order = Window.partitionBy("v").orderBy("bin")
    sparse = counted.withColumn("_from", F.coalesce(F.lag("bin").over(order), F.lit(0)) + 1)
    sparse = sparse.withColumn("before", F.coalesce(F.sum("clusters").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    dense = sparse.withColumn("_bin", F.explode(F.sequence("_from", "bin")))
    return dense.select("v", F.col("_bin").alias("bin"), F.when(F.col("_bin") == F.col("bin"), F.col("clusters")).otherwise(0).cast("long").alias("clusters"), "before")
