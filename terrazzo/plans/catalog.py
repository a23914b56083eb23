"""Registered raster queries; their SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.operators import clusters, fractal, patches, points, quadtree, regress, series, topology
from terrazzo.plans import oracles
from terrazzo.raster import Raster, grid
from terrazzo.sources import files, runs, synth
from terrazzo.streaming.cells import category_counts

TILE = 32


def _e(spark: SparkSession, d: str) -> Raster:
    return synth.embedding_raster(spark, d)


def _l(spark: SparkSession, d: str) -> Raster:
    return synth.shipping_raster(spark, d)


def _h(spark: SparkSession) -> DataFrame:
    return grid(spark, 256, 512)


def _rounded(df: DataFrame, places: int = 9, off: float = 0.0) -> DataFrame:
    """Doubles rounded for comparison; ``off`` moves values that end in an exact half, and minus zero, off the tie."""
    return df.select(*[F.round(F.col(c) + off, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest patches of the shipping raster."""
    labels = clusters.label(_l(spark, sf_dir))
    return patches.patch_metrics(labels).orderBy(F.desc("area"), "cluster_id").limit(100)


def unique_values(spark, d):
    values = lambda name, r: r.cells.select(F.lit(name).alias("raster"), "v").distinct()
    return values("E", _e(spark, d)).unionByName(values("L", _l(spark, d)))


def full_blocked_index(spark, d):
    h = _h(spark).withColumn("n", address.full_blocked("i", "j", 512, TILE))
    i2, j2 = address.full_unblocked("n", 512, TILE)
    return h.select("i", "j", "n", i2.alias("i2"), j2.alias("j2"))


def morton_decode(spark, d):
    h = _h(spark).select(address.morton("i", "j").alias("n"))
    i, j = address.unmorton("n")
    return h.select("n", i.alias("i"), j.alias("j"))


def morton_neighbors(spark, d):
    n = address.morton("i", "j")
    other = address.morton("j", "j")
    return _h(spark).select(n.alias("n"), address.interleaved_add(n, 1).alias("up_i"), address.interleaved_add(n, 2).alias("up_j"), address.interleaved_add(n, other).alias("plus"))


def location_code_digits(spark, d):
    h = _h(spark).select(address.morton("i", "j").alias("code"))
    values = address.digits("code", 9)
    return h.select("code", F.array_join(F.transform(values, lambda x: x.cast("string")), "").alias("digits"), address.from_digits(values).alias("back"))


def quad_bbox(spark, d):
    h = _h(spark).select(address.morton("i", "j").alias("m"), F.explode(F.array(F.lit(3), F.lit(6), F.lit(9))).alias("level"))
    rest = F.pow(F.lit(4.0), (F.lit(9) - F.col("level")).cast("double")).cast("long")
    q = h.select((F.col("m") - F.pmod("m", rest)).alias("code"), "level").distinct()
    return q.select("code", "level", *[c.alias(n) for c, n in zip(address.bounding_box("code", "level", 9), ("x0", "y0", "x1", "y1"))])


def schrack_neighbor(spark, d):
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(address.COMPASS)]))
    h = _h(spark).select(address.morton("i", "j").alias("code"), steps.alias("o"))
    return h.select("code", F.col("o.d").alias("d"), address.neighbor("code", F.lit(9), 9, F.col("o.x"), F.col("o.y")).alias("neighbor"))


def _rects(spark, d):
    return topology.tiles(_e(spark, d), TILE)


def _seams(spark, d):
    return topology.seams(_rects(spark, d).withColumn("name", F.col("bi") * 1000 + F.col("bj")))


def _labels_e(spark, d):
    return clusters.label(_e(spark, d))


def _labels_l(spark, d):
    return clusters.label(_l(spark, d))


def patch_edges(spark, d):
    r = _l(spark, d)
    return patches.patch_edges(r, clusters.label(r))


def category_graph(spark, d):
    nodes, edges = patches.category_graph(_l(spark, d), 2)
    return edges.unionByName(nodes.select(F.col("n").alias("s"), F.lit(None).cast("long").alias("t")))


def monthly_orders(spark, d):
    by = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").cast("double").alias("y"))
    # One row a month.
    return by.withColumn("x", (F.row_number().over(Window.orderBy("m")) - 1).cast("double"))


def _windows(spark, d):
    return regress.window_regressions(monthly_orders(spark, d), "x", "y", "m")


def _mask(spark, d):
    return _l(spark, d).category(3).select(F.col("i").alias("x"), F.col("j").alias("y"))


def _tree(spark, d):
    return quadtree.leaves(_mask(spark, d), oracles.QUAD_BITS)


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def run_catalog(spark, d):
    e = _events(spark, d)
    run = e.groupBy("user_id").agg(F.min("ts").alias("started"), F.min_by("event_type", F.struct("ts", "event_id")).alias("build"))
    build = e.groupBy(F.col("event_type").alias("build")).agg(F.count("*").alias("events"))
    idx = (F.row_number().over(Window.orderBy("started", "user_id")) - 1).cast("long")
    return run.join(build, "build").select(idx.alias("idx"), "user_id", "build", "events")


def merge_keep_first(spark, d):
    # Left and right part of a raster, with columns in common.
    n = _e(spark, d).with_index()
    first = n.where("j < 40").select("n", "v")
    second = n.where("j >= 20").select("n", (F.col("v") + 10).alias("v"))
    return series.merge_keep_first(first, second, "n")


def cell_stream_counts(spark, d):
    return category_counts(_events(spark, d).select("ts", (F.col("user_id") % 4).cast("int").alias("v")))


def storage_orders(spark, d):
    """Slots of one raster in every storage order, side by side."""
    orders = ("linear", "blocked", "full_blocked", "morton")
    parts = [synth.make_data(spark, 96, 64, TILE, 60, o).withColumnRenamed("slot", o) for o in orders]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.drop("v"), ["i", "j"])
    return out.select("i", "j", "v", *orders)


def quad_children(spark, d):
    h = grid(spark, 64, 64).select((address.morton("i", "j") * 64).alias("code"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    return h.select("code", F.col("q").alias("quarter"), address.child("code", F.lit(6), 9, F.col("q")).alias("child"))


def running_events(spark, d):
    by = _events(spark, d).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("events"))
    return series.running_total(by, "event_type", "day", "events").select("event_type", "day", "events", F.col("before").cast("long").alias("before"))


def delaunay_edges(spark, d):
    r = _l(spark, d)
    # Weeks by quantities: the raster does not grow with the orders, so a category fits a task whole.
    return points.delaunay_edges(r.category(3), window=max(r.rows, r.cols))


def delaunay_histogram(spark, d):
    return _rounded(points.edge_histogram(delaunay_edges(spark, d)))


QUERIES = {
    "unique_values": unique_values,
    "category_histogram": lambda s, d: _e(s, d).cells.groupBy("v").agg(F.count("*").alias("cells")),
    "category_cells": lambda s, d: _l(s, d).category(3).select("i", "j"),
    "cells_in_rectangle": lambda s, d: _e(s, d).within(10, 90, 5, 41),
    "hash_pattern": lambda s, d: synth.hash_pattern(s).cells,
    "linear_index": lambda s, d: _h(s).withColumn("n", address.linear("i", "j", 512)),
    "blocked_index": lambda s, d: _h(s).withColumn("n", address.blocked("i", "j", 512, TILE)),
    "full_blocked_index": full_blocked_index,
    "morton_encode": lambda s, d: _h(s).withColumn("n", address.morton("i", "j")),
    "morton_decode": morton_decode,
    "morton_neighbors": morton_neighbors,
    "location_code_digits": location_code_digits,
    "quad_bbox": quad_bbox,
    "schrack_neighbor": schrack_neighbor,
    "resize_tile": lambda s, d: (r := _e(s, d)).tile_to(r.rows + 10, 100).cells,
    "resize_crop": lambda s, d: _e(s, d).tile_to(100, 40).cells,
    "flip_transpose": lambda s, d: _e(s, d).flip_rows().transpose().cells,
    "neighbor_edges": lambda s, d: topology.neighbor_edges(_l(s, d)),
    "neighbor_degree": lambda s, d: topology.neighbor_degree(_l(s, d)),
    "same_value_edges": lambda s, d: topology.same_value_edges(_e(s, d)),
    "right_edges_window": lambda s, d: topology.right_edges(_e(s, d)),
    "tolerant_edges": lambda s, d: topology.same_value_edges(_e(s, d), lambda a, b: F.abs(a - b) <= 1),
    "tile_seams": _seams,
    "seam_cell_edges": lambda s, d: topology.seam_edges(_seams(s, d), 64),
    "seam_value_edges": lambda s, d: topology.seam_value_edges(_e(s, d), TILE),
    "tile_adjacency": lambda s, d: topology.tile_adjacency(_rects(s, d)),
    "row_runs": lambda s, d: _e(s, d).runs(),
    "run_overlaps": lambda s, d: topology.run_overlaps(_e(s, d).runs()),
    "seen_neighbors": lambda s, d: topology.seen_neighbors(_e(s, d)),
    "multi_value": lambda s, d: synth.multi_value(s, 100, 100, 0, 25).cells,
    "storage_orders": storage_orders,
    "quad_children": quad_children,
    "pgm_lines": lambda s, d: files.pgm_lines(_l(s, d), 3),
    "run_text": lambda s, d: runs.lines(_events(s, d).selectExpr("concat(event_type, '@', user_id) as test", "event_id as seq", "1L as iterations", "user_id as ns")),
    "largest_clusters": lambda s, d: clusters.sizes(_labels_l(s, d)).orderBy(F.desc("size"), "cluster_id").limit(10),
    "running_events": running_events,
    "cluster_labels": lambda s, d: _labels_e(s, d).select("n", "v", "cluster_id"),
    "cluster_labels_tiled": lambda s, d: clusters.label(_l(s, d), tile=TILE).select("n", "v", "cluster_id"),
    "cluster_labels_runs": lambda s, d: clusters.label(_e(s, d), strategy="runs").select("n", "v", "cluster_id"),
    "cluster_coords": lambda s, d: clusters.coords(_labels_l(s, d), 50),
    "cluster_members": lambda s, d: clusters.members(_labels_l(s, d)).select("cluster_id", F.array_join(F.transform("members", lambda n: n.cast("string")), ",").alias("members")),
    "cluster_at": lambda s, d: clusters.at(_labels_l(s, d), 100),
    "cluster_ranks": lambda s, d: clusters.ranked(_labels_l(s, d)),
    "cluster_count": lambda s, d: clusters.count(_labels_e(s, d)),
    "cluster_sizes": lambda s, d: clusters.sizes(_labels_l(s, d)),
    "size_distribution": lambda s, d: clusters.size_distribution(_labels_e(s, d)),
    "patch_metrics": lambda s, d: _rounded(patches.patch_metrics(_labels_l(s, d))),
    "patch_edges": patch_edges,
    "border_types": lambda s, d: patches.border_types(_labels_l(s, d)),
    "category_graph": category_graph,
    "box_count": lambda s, d: _rounded(fractal.box_count(_l(s, d), oracles.BOX_EPS)),
    "box_count_scaled": lambda s, d: _rounded(fractal.box_count_scaled(_l(s, d), (2, 4, 8, 16, 32))),
    "mass_exponent": lambda s, d: _rounded(fractal.mass_exponents(_l(s, d), oracles.BOX_EPS, (-1, 0, 1, 2)), 6),
    "box_entropy": lambda s, d: fractal.box_entropy(_l(s, d), oracles.BOX_EPS).select("v", "eps", F.round("scale", 9).alias("scale"), F.round("entropy", 6).alias("entropy"), F.round("shannon", 6).alias("shannon")),
    "fractal_dimension": lambda s, d: _rounded(fractal.fractal_dimension(_l(s, d), oracles.BOX_EPS)),
    "window_regression": lambda s, d: _rounded(_windows(s, d), 6, oracles.OFF),
    "best_linear_window": lambda s, d: _rounded(regress.best_window(_windows(s, d)).select("start", "width", "slope", "r"), 6, oracles.OFF),
    "delaunay_edges": delaunay_edges,
    "delaunay_histogram": delaunay_histogram,
    "quadtree_leaves": _tree,
    "quadtree_neighbors": lambda s, d: quadtree.neighbors(_tree(s, d), oracles.QUAD_BITS),
    "quadtree_level_diff": lambda s, d: quadtree.level_differences(_tree(s, d), oracles.QUAD_BITS),
    "quadtree_components": lambda s, d: quadtree.components(_tree(s, d), oracles.QUAD_BITS),
    "quadtree_locate": lambda s, d: quadtree.locate(_tree(s, d), 100, 25, oracles.QUAD_BITS),
    "block_colors": lambda s, d: quadtree.blocks(_e(s, d).cells, 8),
    "series_stats": lambda s, d: series.stats(_events(s, d), "event_type", "value").select("event_type", "n", "low", "high", F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev")),
    "series_histogram": lambda s, d: series.histogram(_events(s, d), "event_type", "value").select("event_type", "bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "count"),
    "series_clip": lambda s, d: series.clip(_events(s, d).select("event_id", "event_type", "value"), "value", 1, 50),
    "pairwise_t": lambda s, d: _rounded(series.pairwise_t(_events(s, d), "event_type", "value")),
    "run_catalog": run_catalog,
    "merge_keep_first": merge_keep_first,
    "cell_stream_counts": cell_stream_counts,
}


def queries() -> dict:
    from terrazzo.plans import stored

    return QUERIES | stored.QUERIES


def oracle_sql() -> dict[str, str]:
    from terrazzo.plans import stored

    return oracles.ORACLES | stored.ORACLES
