"""Patch metrics, fractals, regressions, statistics, Delaunay edges, files and the run store."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.operators import clusters, fractal, patches, points, regress, series
from terrazzo.plans import catalog
from terrazzo.raster import Raster, from_rows
from terrazzo.sources import files, runs
from terrazzo.streaming.cells import category_counts


def test_patch_metrics(spark):
    raster = from_rows(spark, [[1, 1, 2], [1, 3, 2]])
    labels = clusters.label(raster)
    got = {r.cluster_id: (r.area, r.perimeter, r.mod_perimeter, r.div_perimeter) for r in patches.patch_metrics(labels).collect()}
    assert got[0] == (3, 8, 3.0, (8 + 4 * 2 / 14) / 4)
    assert got[2] == (2, 6, 2.0, (6 + 2 * 2 / 14) / 4)
    assert got[4] == (1, 4, 1.0, 1.0)
    assert {r.cluster_id: r.edges for r in patches.patch_edges(raster, labels).collect()} == {0: 2, 2: 1}
    nodes, edges = patches.category_graph(raster, 3)
    assert nodes.count() == 1 and edges.count() == 0
    distribution, metrics = patches.landscape_report(raster, v=1)
    assert metrics.count() == 1 and distribution.count() == 3


def test_boxes(spark):
    a = np.random.default_rng(1).integers(0, 3, (20, 13))
    raster = Raster.from_array(spark, a)
    got = {(r.v, r.eps): r.boxes for r in fractal.box_count(raster, [1, 3, 6, 50]).collect()}
    for v in range(3):
        for eps in (1, 3, 6):
            nx, ny = 20 // eps, 13 // eps
            assert got[v, eps] == len({(i * nx // 20, j * ny // 13) for i, j in zip(*np.nonzero(a == v))})
    assert not any(eps == 50 for _, eps in got)
    masses = {(r.v, r.eps, r.q): r.value for r in fractal.mass_exponents(raster, [3], [0, 1, 2]).collect()}
    assert masses[1, 3, 1.0] == (a == 1).sum() and masses[1, 3, 0.0] == got[1, 3]
    entropy = fractal.box_entropy(raster, [6]).where("v = 2").first()
    assert entropy.shannon > 0 and entropy.scale == pytest.approx(math.sqrt(20 * 13 / 3 / 2))
    flat = Raster.from_array(spark, np.ones((32, 32), np.uint8))
    assert fractal.fractal_dimension(flat, [1, 2, 4, 8]).first().dimension == pytest.approx(2)
    assert fractal.box_count_scaled(flat, [1, 2, 4]).orderBy("level").first().boxes == 4


def test_windows_of_a_series(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=9)
    df = spark.createDataFrame([(k, float(k), float(v)) for k, v in enumerate(y)], "k int, x double, y double")
    rows = regress.window_regressions(df, "x", "y", "k").collect()
    assert len(rows) == (9 - 4) * (9 - 3) // 2
    for r in rows:
        part = slice(r.start, r.start + r.width)
        x = np.arange(9.0)[part]
        m, b = np.polyfit(x, y[part], 1)
        ssr = ((m * x + b - y[part]) ** 2).sum()
        assert (r.slope, r.intercept, r.ssr, r.mssr) == pytest.approx((m, b, ssr, ssr / r.width), abs=1e-9)
        assert r.r == pytest.approx(np.corrcoef(x, y[part])[0, 1], abs=1e-9)
    assert regress.window_regressions(df, "x", "y", "k", compat=True).agg(F.min("r")).first()[0] >= 0
    flat = spark.createDataFrame([(k, float(k), 2.0) for k in range(6)], "k int, x double, y double")
    assert {r.r for r in regress.window_regressions(flat, "x", "y", "k").collect()} == {None}
    assert regress.best_window(regress.window_regressions(df, "x", "y", "k")).count() == 1
    assert regress.window_regressions(df.limit(3), "x", "y", "k").count() == 0


def test_statistics(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (2, 4, 6, 9)]
    df = spark.createDataFrame(rows, "k string, v double")
    t = {(r.a, r.b): (r.t, r.df, r.p) for r in series.pairwise_t(df, "k", "v", with_p=True).collect()}
    assert t["a", "b"][:2] == pytest.approx((-2.75 / math.sqrt((5 / 3 + 107 / 12) / 2 * 0.5), 6), abs=1e-9) and t["b", "a"][0] == -t["a", "b"][0]
    assert t["a", "b"][2] == pytest.approx(0.141860, abs=1e-6)
    assert series.t_tail(2.228138851, 10) == pytest.approx(0.05, abs=1e-7)
    assert series.t_tail(0.0, 5) == 1.0
    hist = {r.bin: r["count"] for r in series.histogram(df.where("k = 'a'"), "k", "v", bins=3).collect()}
    assert hist == {0: 1, 1: 1, 2: 2}
    same = series.histogram(spark.createDataFrame([("c", 5.0), ("c", 5.0)], "k string, v double"), "k", "v").first()
    assert (same.bin, same["count"]) == (0, 2)
    assert [r.line for r in series.pretty(df.limit(1)).collect()] == ["a 1.0"]
    assert series.clip(df, "v", 1, 4).count() == 3
    merged = series.merge_keep_first(df.limit(1), spark.createDataFrame([("a", 9.0), ("z", 8.0)], "k string, v double"), "k")
    assert sorted(map(tuple, merged.collect())) == [("a", 1.0), ("z", 8.0)]


def test_delaunay():
    rng = np.random.default_rng(5)
    p = np.unique(rng.integers(0, 40, (60, 2)), axis=0)
    x, y = p.T
    edges = points.delaunay(x, y)
    hull = _hull(p)
    on_hull = len(hull)
    assert len(edges) == 3 * len(p) - 3 - on_hull
    # Every edge has an empty circle through its ends: check against its own midpoint family by brute force.
    for a, b in edges[:40]:
        assert _has_empty_circle(p, a, b)
    line = points.delaunay(np.array([0, 2, 1]), np.array([0, 2, 1]))
    assert {tuple(e) for e in line.tolist()} == {(0, 2), (1, 2)}
    square = points.delaunay(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]))
    assert len(square) == 5
    assert len(points.delaunay(np.array([3]), np.array([3]))) == 0


def _hull(p):
    """Points on the convex hull, those along its sides included."""
    out = []
    for k in range(len(p)):
        others = np.delete(p, k, 0) - p[k]
        angle = np.sort(np.arctan2(others[:, 1], others[:, 0]))
        gaps = np.diff(np.append(angle, angle[0] + 2 * np.pi))
        if gaps.max() >= np.pi - 1e-9:
            out.append(k)
    return out


def _has_empty_circle(p, a, b):
    """Whether some circle through a and b holds no other point inside."""
    m, d = (p[a] + p[b]) / 2, (p[b] - p[a]).astype(float)
    normal = np.array([-d[1], d[0]])
    lo, hi = -np.inf, np.inf
    for k in range(len(p)):
        if k in (a, b):
            continue
        w = p[k] - m
        # |w - t n|^2 >= |d|^2 / 4 + t^2 |n|^2
        side, room = 2 * (w @ normal), w @ w - d @ d / 4
        if side > 0:
            hi = min(hi, room / side)
        elif side < 0:
            lo = max(lo, room / side)
        elif room < -1e-9:
            return False
    return lo <= hi + 1e-9


def test_delaunay_by_category(spark):
    raster = from_rows(spark, [[1, 1], [1, 2]])
    edges = points.delaunay_edges(raster.cells)
    assert edges.where("v = 1").count() == 3 and edges.where("v = 2").count() == 0
    assert points.edge_histogram(edges).agg(F.sum("count")).first()[0] == 3


def test_registered_delaunay_is_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a = np.where(rng.random((150, 9)) < 0.2, 3, 1).astype(np.uint8)
    monkeypatch.setattr(catalog, "_l", lambda s, d: Raster.from_array(s, a))
    p = np.argwhere(a == 3)
    got = {((r.i1, r.j1), (r.i2, r.j2)) for r in catalog.delaunay_edges(spark, "").collect()}
    got = {tuple(sorted(e)) for e in got}
    assert got == {tuple(sorted((tuple(p[x].tolist()), tuple(p[y].tolist())))) for x, y in points.delaunay(*p.T)}
    assert len(got) == 3 * len(p) - 3 - len(_hull(p)) and any(x[0] // 64 != y[0] // 64 for x, y in got)
    at = {tuple(q): k for k, q in enumerate(p.tolist())}
    assert all(_has_empty_circle(p, at[x], at[y]) for x, y in got)


def test_files(spark, tmp_path):
    a = np.arange(7 * 24, dtype=np.uint8).reshape(7, 24)
    raster = Raster.from_array(spark, a)
    path = str(tmp_path / "a.tif")
    files.write_tiff(raster, path)
    assert tuple(files.tiff_dimensions(spark, path).first())[1:] == (7, 24)
    back = files.read_tiff(spark, path)
    assert (back.rows, back.cols) == (7, 24)
    assert back.cells.exceptAll(raster.cells).count() == 0
    kept = files.read_tiff(spark, path, orient="keep").flip_rows()
    assert kept.cells.exceptAll(raster.cells).count() == 0
    tags = {r.tag: r.value for r in files.tiff_tags(spark, path).collect()}
    assert tags["bits_per_sample"] == "8" and tags["compression"] == "1"
    with pytest.raises(ValueError):
        files.parse_tiff(b"plain text")

    (tmp_path / "b.dat").write_bytes(np.array([[1, 2, 3], [4, 5, 200]], np.uint8).tobytes())
    dat = files.read_dat(spark, str(tmp_path / "b.dat"), (2, 3))
    want = {(0, 1): 1, (1, 1): 2, (2, 1): 3, (0, 0): 4, (1, 0): 5, (2, 0): 200}
    assert {(r.i, r.j): r.v for r in dat.cells.collect()} == want and (dat.rows, dat.cols) == (3, 2)

    files.write_pgm(from_rows(spark, [[1, 2, 3], [4, 5, 6]]), str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["P2 3 2 255", "4 5 6", "1 2 3"]

    (tmp_path / "t.txt").write_text("f 1 2 3\ng 9\n\n")
    assert {(r.name, r.seq): r.value for r in files.read_times(spark, str(tmp_path / "t.txt")).collect()} == {("f", 0): 1, ("f", 1): 2, ("f", 2): 3, ("g", 0): 9}
    files.by_storage_order(raster, str(tmp_path / "m"), 4)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 168


def test_long_lines_of_times_are_split_once(spark, tmp_path):
    (tmp_path / "t.txt").write_text(f"f {' '.join(map(str, range(5000)))}\n\n  g 9 \nh\n")
    times = files.read_times(spark, str(tmp_path / "t.txt"))
    rows = sorted((r.name, r.seq, r.value) for r in times.collect())
    assert rows == [("f", k, k) for k in range(5000)] + [("g", 0, 9)]
    # What stands above the explosion is done for every value.
    above = times._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "posexplode" not in above and "split(" not in above


def test_run_store(spark, tmp_path):
    from datetime import datetime

    store = runs.RunStore(spark, str(tmp_path / "store"))
    assert store.catalog().count() == 0
    store.add({"one": [(1, 50), (1, 60)]}, {"cpu": "x"}, {"flags": "-g"}, started=datetime(2024, 1, 2))
    store.add({"one": [(1, 70)], "two": []}, {"cpu": "x"}, {"flags": "-g"}, {"side": "100"}, datetime(2024, 1, 1))
    assert [r.attributes for r in store.catalog().orderBy("idx").collect()] == [{"side": "100"}, {}]
    assert [tuple(r) for r in store.series(1, "one").collect()] == [(0, 1, 50), (1, 1, 60)]
    assert store.table("machine").count() == 1
    assert runs.lines(store.table("timing").where("ns < 65")).first().line == "one\t1 50 1 60"
    assert set(runs.compare({"a": lambda: 1, "b": lambda: spark.range(1)}, rounds=2)) == {"a", "b"}
    row = spark.range(1).select(runs.parse_started(F.lit("2014-Jan-31 12:00:00")).cast("string"), runs.optimization(F.lit("x = 1\toptimization = -O2\ty")), runs.plain_uuid(F.lit("a-b"))).first()
    assert tuple(row) == ("2014-01-31 12:00:00", "-O2", "ab")


def test_cells_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 1), ("2024-01-01 00:31:00", 2)]
    df = spark.createDataFrame(rows, "t string, v int").selectExpr("cast(t as timestamp) as ts", "v")
    df.write.parquet(str(tmp_path / "in"))
    query = category_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cells_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.v, r.cells) for r in spark.table("cells_out").collect()] == [(1, 2)]
    assert category_counts(df).count() == 2
