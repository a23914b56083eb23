"""Registered queries that go through files and run tables, and variants of operators; each with its SQL.

Files are written below the scratch folder first and read back, so a query
covers a sink and its source.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.operators import clusters, fractal, points, regress, series
from terrazzo.plans import catalog, oracles
from terrazzo.plans.oracles import BOXES, EL, LL, MONTHS, OFF, E, L
from terrazzo.raster import Raster, grid
from terrazzo.sources import files, runs, synth
from terrazzo.storage import scratch_root


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _tiff(spark: SparkSession, d: str) -> str:
    path = _fresh(spark, "raster") + ".tif"
    files.write_tiff(synth.shipping_raster(spark, d), path)
    return path


def _dat(spark: SparkSession, d: str) -> tuple[str, tuple[int, int]]:
    raster, path = synth.shipping_raster(spark, d), _fresh(spark, "raster") + ".dat"
    files.write_dat(raster, path)
    return path, (raster.rows, raster.cols)


def tiff_dimensions(spark, d):
    return files.tiff_dimensions(spark, _tiff(spark, d)).select("height", "width")


def tiff_tags(spark, d):
    return files.tiff_tags(spark, _tiff(spark, d)).select("tag", "value")


def read_tiff(spark, d):
    return files.read_tiff(spark, _tiff(spark, d)).cells


def read_gdal(spark, d):
    return files.read_tiff(spark, _tiff(spark, d), orient="keep").cells


def read_dat(spark, d):
    return files.read_dat(spark, *_dat(spark, d)).cells


def start(spark, d):
    return files.start(spark, *_dat(spark, d))[1]


def from_numpy(spark, d):
    import numpy as np

    i, j = np.indices((60, 45))
    return Raster.from_array(spark, ((i * 3571 + j * 2663) % 256).astype(np.uint8)).cells


def pgm_file(spark, d):
    path = _fresh(spark, "raster") + ".pgm"
    files.write_pgm(synth.shipping_raster(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def capacities_text(spark, d):
    path = _fresh(spark, "capacities")
    curve = fractal.box_count(synth.shipping_raster(spark, d), oracles.BOX_EPS)
    files.write_capacities(curve, path)
    line = F.col("value")
    field = lambda a, n, kind: F.trim(F.substring(line, a, n)).cast(kind)
    return spark.read.text(path).select(
        F.round(field(1, 20, "double"), 9).alias("boxsize"),
        field(21, 8, "long").alias("boxes"),
        F.round(field(29, 20, "double"), 9).alias("log_boxsize"),
        F.round(field(49, 20, "double"), 9).alias("log_boxes"),
        F.length(line).cast("long").alias("width"),
    )


def saved_results(spark, d):
    """Box counts and cluster sizes, saved and loaded."""
    raster, path = synth.shipping_raster(spark, d), _fresh(spark, "results")
    files.save_results({"boxes": fractal.box_count(raster, oracles.BOX_EPS), "clusters": clusters.sizes(clusters.label(raster))}, path)
    boxes, sizes = (files.load_results(spark, path, name) for name in ("boxes", "clusters"))
    return boxes.select(F.lit("boxes").alias("kind"), "v", F.col("eps").alias("key"), F.col("boxes").alias("n")).unionByName(sizes.select(F.lit("clusters").alias("kind"), "v", F.col("cluster_id").alias("key"), F.col("size").alias("n")))


def stored_in_order(spark, d):
    path = _fresh(spark, "morton")
    files.by_storage_order(synth.shipping_raster(spark, d), path)
    return spark.read.parquet(path).select("i", "j", "v")


#: Runs of the store queries: when, build, machine, and per test its (iterations, nanoseconds).
RUNS = (
    ("2014-Feb-03 08:30:00", {"optimization": "-O2", "compiler": "one"}, {"host": "a"}, {"sort": [(1, 70), (2, 130)], "merge": [(1, 40)]}),
    ("2014-Jan-31 12:00:00", {"optimization": "-O3", "compiler": "one"}, {"host": "b"}, {"sort": [(1, 50), (2, 90), (4, 170)]}),
    ("2014-Mar-01 00:00:00", {"optimization": "-O2", "compiler": "one"}, {"host": "a"}, {"merge": [(3, 100)]}),
)


def _store(spark: SparkSession) -> runs.RunStore:
    store = runs.RunStore(spark, _fresh(spark, "runs"))
    for when, build, machine, timings in RUNS:
        store.add(timings, machine, build, started=datetime.strptime(when, "%Y-%b-%d %H:%M:%S"))
    return store


def run_store(spark, d):
    """Runs of a store in order of their start; equal builds and machines are kept once."""
    store = _store(spark)
    kept = store.table("build").select(F.count("*").alias("builds")).join(store.table("machine").select(F.count("*").alias("machines")))
    rows = store.catalog().select("idx", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.col("build.optimization").alias("optimization"), F.col("machine.host").alias("host"))
    return rows.join(F.broadcast(kept))


def run_series(spark, d):
    return _store(spark).series(0, "sort").select("seq", "iterations", "ns")


def parse_started(spark, d):
    text = F.date_format("ts", "yyyy-MMM-dd HH:mm:ss")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_format(runs.parse_started(text), "yyyy-MM-dd HH:mm:ss").alias("started"))


def timing_text(spark, d):
    """Lines ``name v1 v2 ...``, one per kind and day of events, written and parsed."""
    path = _fresh(spark, "times")
    ids = F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string"))
    named = spark.read.parquet(f"{d}/events.parquet").groupBy(F.concat_ws("@", "event_type", F.to_date("ts").cast("string")).alias("name")).agg(ids.alias("ids"))
    named.select(F.concat(F.col("name"), F.lit(" "), F.array_join("ids", " "))).write.text(path)
    return files.read_times(spark, path).select("name", F.col("seq").cast("long").alias("seq"), "value")


def _descriptors(spark, d) -> DataFrame:
    by = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("test"), F.to_date("ts").alias("day"))
    rows = by.agg(F.count("*").cast("int").alias("n"), F.slice(F.sort_array(F.collect_list("event_id")), 1, 3).alias("times"))
    return rows.select(F.array("n", F.lit(2)).alias("size"), "test", "times", F.col("day").cast("timestamp").alias("when"))


def _flat(rows: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select(text("size"), "test", text("times"), F.date_format("when", "yyyy-MM-dd").alias("day"))


def descriptors_json(spark, d):
    path = _fresh(spark, "descriptors")
    files.write_descriptors(_descriptors(spark, d), path)
    return _flat(files.read_descriptors(spark, path))


def descriptors_yaml(spark, d):
    path = _fresh(spark, "descriptors")
    files.write_descriptors_yaml(_descriptors(spark, d), path)
    return _flat(files.read_descriptors_yaml(spark, path))


def pretty_table(spark, d):
    return series.pretty(synth.embedding_raster(spark, d).cells.groupBy("v").agg(F.count("*").alias("cells")), {"v": "category"})


def levels_of_shapes(spark, d):
    h = grid(spark, 70, 70).select((F.col("i") + 1).alias("rows"), (F.col("j") * 9 + 1).alias("cols"))
    return h.withColumn("levels", address.levels_of("rows", "cols"))


def build_settings(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    h = F.md5(F.col("event_id").cast("string"))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.concat(F.lit("compiler = x\toptimization = -O"), F.col("user_id") % 4, F.lit("\tflags="), F.col("event_type"))
    return e.select("event_id", runs.plain_uuid(dashed).alias("plain"), runs.optimization(text).alias("optimization"))


def tolerant_clusters(spark, d):
    near = lambda a, b: F.abs(a - b) <= 1
    return clusters.label(catalog._l(spark, d), predicate=near).select("n", "v", "cluster_id")


def eight_clusters(spark, d):
    return clusters.label(synth.embedding_raster(spark, d), connectivity=8).select("n", "v", "cluster_id")


def t_test_p(spark, d):
    out = series.pairwise_t(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value", with_p=True)
    return out.select("a", "b", F.round("p", 6).alias("p"))


def size_distribution_compat(spark, d):
    return clusters.size_distribution(catalog._labels_e(spark, d), compat=True)


def window_regression_compat(spark, d):
    w = regress.window_regressions(catalog.monthly_orders(spark, d), "x", "y", "m", compat=True)
    return w.select("start", "width", F.round(F.col("r") + OFF, 6).alias("r"))


def timers(spark, d):
    """What the timers of a job say of themselves: all three clocks run, and a mean is not a sum."""
    job = lambda: spark.range(1000).agg(F.sum("id"))
    wall, cpu, use = runs.timeit(job, 2), runs.time_clock(lambda: sum(range(10**6)), 2), runs.usage(lambda: sum(range(10**6)), 2)
    both = runs.compare({"a": job, "b": job}, rounds=2)
    return spark.createDataFrame(
        [("timeit", wall > 0), ("time_clock", 0 < cpu < 10), ("usage", use["user"] + use["system"] > 0 and use["max_rss"] > 0), ("compare", sorted(map(len, both.values())) == [2, 2])],
        "timer string, runs boolean",
    )


def delaunay_nearest(spark, d):
    """Length of every point's shortest Delaunay edge, which leads to its nearest neighbour."""
    e = catalog.delaunay_edges(spark, d)
    ends = e.select(F.col("i1").alias("i"), F.col("j1").alias("j"), "length").unionByName(e.select(F.col("i2").alias("i"), F.col("j2").alias("j"), "length"))
    return ends.groupBy("i", "j").agg(F.round(F.min("length"), 9).alias("nearest"))


def shuffled_places(spark, d):
    return series.numbered(series.shuffle(spark.read.parquet(f"{d}/events.parquet").select("event_id"), "event_id", seed=3), "place")


QUERIES = {
    f.__name__: f
    for f in (
        tiff_dimensions, tiff_tags, read_tiff, read_gdal, read_dat, start, from_numpy, pgm_file, capacities_text, saved_results,
        stored_in_order, run_store, run_series, parse_started, timing_text, descriptors_json, descriptors_yaml, pretty_table, levels_of_shapes, build_settings,
        tolerant_clusters, eight_clusters, t_test_p, size_distribution_compat, window_regression_compat, timers, delaunay_nearest, shuffled_places,
    )
}


def _runs_sql() -> str:
    rows = sorted((datetime.strptime(w, "%Y-%b-%d %H:%M:%S").isoformat(sep=" "), b["optimization"], m["host"]) for w, b, m, _ in RUNS)
    values = ", ".join(f"({k}::BIGINT, '{w}', '{o}', '{h}', {len({str(r[1]) for r in RUNS})}::BIGINT, {len({str(r[2]) for r in RUNS})}::BIGINT)" for k, (w, o, h) in enumerate(rows))
    return f"SELECT * FROM (VALUES {values}) AS t(idx, started, optimization, host, builds, machines)"


def _connected(start: str, touch: str) -> str:
    """Labels of cells joined where ``touch`` says so."""
    return f"""{start},
  cells AS MATERIALIZED (SELECT i * {{w}} + j AS n, i, j, v FROM {{r}}),
  sym AS MATERIALIZED (SELECT a.n AS s, b.n AS t FROM cells a, {touch}),
  reach(n, l) USING KEY (n) AS (SELECT n, n FROM cells UNION
    SELECT x.t, x.m FROM (SELECT sym.t, min(reach.l) AS m FROM reach JOIN sym ON sym.s = reach.n GROUP BY sym.t) x JOIN recurring.reach rr ON rr.n = x.t WHERE x.m < rr.l)
  SELECT c.n, c.v, r.l AS cluster_id FROM cells c JOIN reach r ON r.n = c.n"""


_FOUR = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(di, dj), cells b WHERE b.i = a.i + di AND b.j = a.j + dj"
_EIGHT = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)) AS o(di, dj), cells b WHERE b.i = a.i + di AND b.j = a.j + dj"
_DESCRIPTORS = "SELECT count(*)::VARCHAR || ',2' AS size, event_type AS test, array_to_string(list_sort(list(event_id))[1:3], ',') AS times, strftime(ts::DATE, '%Y-%m-%d') AS day FROM events GROUP BY event_type, ts::DATE"
_STRIPS = "(SELECT height, unnest(range(0, (height + 63) // 64)) AS k FROM dim)"

ORACLES = {
    "tiff_dimensions": f"WITH {L} SELECT height, 50::BIGINT AS width FROM dim",
    "tiff_tags": f"""WITH {L} SELECT tag, value FROM (VALUES ('width', '50'), ('bits_per_sample', '8'), ('compression', '1'), ('photometric', '1'), ('samples_per_pixel', '1'), ('rows_per_strip', '64')) AS t(tag, value)
      UNION ALL SELECT 'height', height::VARCHAR FROM dim UNION ALL SELECT 'strip_offsets', string_agg((8 + k * 3200)::VARCHAR, ',' ORDER BY k) FROM {_STRIPS}
      UNION ALL SELECT 'strip_byte_counts', string_agg((least(64, height - k * 64) * 50)::VARCHAR, ',' ORDER BY k) FROM {_STRIPS}""",
    "read_tiff": f"WITH {L} SELECT i, j, v FROM l",
    "read_gdal": f"WITH {L} SELECT height - 1 - i AS i, j, v FROM l CROSS JOIN dim",
    "read_dat": f"WITH {L} SELECT j AS i, height - 1 - i AS j, v FROM l CROSS JOIN dim",
    "start": f"WITH {L} SELECT DISTINCT v FROM l",
    "from_numpy": "SELECT a.i, b.j, ((3571 * a.i + 2663 * b.j) % 256)::INTEGER AS v FROM (SELECT unnest(range(0, 60)) AS i) a CROSS JOIN (SELECT unnest(range(0, 45)) AS j) b",
    "pgm_file": f"WITH {L} SELECT string_agg(v::VARCHAR, ' ' ORDER BY j) AS line FROM l GROUP BY i UNION ALL SELECT 'P2 50 ' || height::VARCHAR || ' 255' FROM dim",
    "capacities_text": f"WITH {BOXES} SELECT round(height::DOUBLE / nx, 9) AS boxsize, count(*) AS boxes, round(log10(height::DOUBLE / nx), 9) AS log_boxsize, round(log10(count(*)), 9) AS log_boxes, 68::BIGINT AS width FROM boxes CROSS JOIN dim GROUP BY v, eps, nx, height",
    "saved_results": f"{LL}, sc AS (SELECT unnest([{', '.join(map(str, oracles.BOX_EPS))}])::BIGINT AS eps), boxes AS (SELECT DISTINCT v, eps, i * (height // eps) // height AS bx, j * (50 // eps) // 50 AS by FROM l CROSS JOIN sc CROSS JOIN dim) SELECT 'boxes' AS kind, v, eps AS key, count(*) AS n FROM boxes GROUP BY v, eps UNION ALL SELECT 'clusters', v, cluster_id, count(*) FROM lab GROUP BY v, cluster_id",
    "stored_in_order": f"WITH {L} SELECT i, j, v FROM l",
    "run_store": _runs_sql(),
    "run_series": "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 50::BIGINT), (1, 2, 90), (2, 4, 170)) AS t(seq, iterations, ns)",
    "parse_started": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started FROM events",
    "timing_text": "SELECT event_type || '@' || ts::DATE::VARCHAR AS name, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) - 1 AS seq, event_id AS value FROM events",
    "descriptors_json": _DESCRIPTORS,
    "descriptors_yaml": _DESCRIPTORS,
    "pretty_table": f"WITH {E}, c AS (SELECT v::VARCHAR AS v, count(*)::VARCHAR AS cells FROM e GROUP BY e.v) SELECT lpad(v, greatest(8, (SELECT max(length(v)) FROM c))::INTEGER, ' ') || ' ' || lpad(cells, greatest(5, (SELECT max(length(cells)) FROM c))::INTEGER, ' ') AS line FROM c",
    "levels_of_shapes": "SELECT a AS rows, b AS cols, CASE WHEN greatest(a, b) = 1 THEN 0 ELSE length(bin(greatest(a, b) - 1)) END::INTEGER AS levels FROM (SELECT unnest(range(1, 71)) AS a) CROSS JOIN (SELECT unnest(range(0, 70)) * 9 + 1 AS b)",
    "build_settings": "SELECT event_id, md5(event_id::VARCHAR) AS plain, '-O' || (user_id % 4)::VARCHAR AS optimization FROM events",
    "tolerant_clusters": _connected(f"WITH RECURSIVE {L}", f"{_FOUR} AND abs(a.v - b.v) <= 1").format(w=50, r="l"),
    "eight_clusters": _connected(f"WITH RECURSIVE {E}", f"{_EIGHT} AND a.v = b.v").format(w=64, r="e"),
    "t_test_p": """WITH m AS (SELECT event_type AS k, count(value) AS n, avg(value) AS m, var_samp(value) AS s FROM events GROUP BY 1),
      t AS (SELECT a.k AS a, b.k AS b, (a.n + b.n - 2)::DOUBLE AS df, abs(a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t FROM m a JOIN m b ON a.k <> b.k),
      x AS (SELECT a, b, df, t / 4000.0::DOUBLE AS h, unnest(range(0, 4001)) AS k, t FROM t),
      area AS (SELECT a, b, df, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(df + 1) / 2 * ln(1 + (h * k) * (h * k) / df))) * any_value(h) / 3 AS s FROM x GROUP BY a, b, df)
      SELECT a, b, round(greatest(0, 1 - 2 * s * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())), 6) AS p FROM area""",
    "size_distribution_compat": f"""{EL}, s AS (SELECT v, cluster_id, count(*) AS size FROM lab GROUP BY ALL), m AS (SELECT v, min(size) AS lo, max(size) AS hi FROM s GROUP BY v),
      c AS (SELECT s.v, (CASE WHEN hi > lo THEN least(floor((size - lo) * hi / (hi - lo)::DOUBLE), hi - 1) ELSE floor(hi / 2.0::DOUBLE) END + 1)::BIGINT AS bin, count(*) AS clusters FROM s JOIN m ON m.v = s.v GROUP BY 1, 2),
      d AS (SELECT v, unnest(range(1, hi + 1)) AS bin FROM m)
      SELECT d.v, d.bin, coalesce(clusters, 0)::BIGINT AS clusters, (coalesce(sum(clusters) OVER (PARTITION BY d.v ORDER BY d.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM d LEFT JOIN c ON c.v = d.v AND c.bin = d.bin""",
    "window_regression_compat": f"WITH {MONTHS} SELECT start, width, round(r + 1 + {OFF}::DOUBLE, 6) AS r FROM fit",
    "timers": "SELECT * FROM (VALUES ('timeit', true), ('time_clock', true), ('usage', true), ('compare', true)) AS t(timer, runs)",
    "delaunay_nearest": f"WITH {L}, p AS (SELECT i, j FROM l WHERE v = 3) SELECT a.i, a.j, round(sqrt(min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))::DOUBLE), 9) AS nearest FROM p a JOIN p b ON a.i <> b.i OR a.j <> b.j GROUP BY a.i, a.j",
    "shuffled_places": "SELECT event_id, row_number() OVER (ORDER BY md5('3:' || event_id::VARCHAR), event_id) - 1 AS place FROM events",
}
