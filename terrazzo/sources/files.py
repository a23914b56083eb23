"""File sources and sinks: headerless rasters, TIFF, PGM, timing text, run descriptors."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.raster import Raster

CELLS = "path string, i long, j long, v int"
# TIFF tag numbers and their names.
TIFF_TAGS = {
    256: "width", 257: "height", 258: "bits_per_sample", 259: "compression", 262: "photometric", 266: "fill_order",
    273: "strip_offsets", 274: "orientation", 277: "samples_per_pixel", 278: "rows_per_strip", 279: "strip_byte_counts",
    280: "min_sample", 281: "max_sample", 284: "planar_config", 297: "page_number", 32997: "image_depth", 339: "sample_format",
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 8: 2, 9: 4}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def parse_tiff(data: bytes) -> dict[str, list[int]]:
    """Tags of the first directory of a baseline TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        number, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _CODES:
            continue
        size = _SIZES[kind] * count
        raw = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:12])[0]) : p + size]
        tags[TIFF_TAGS.get(number, str(number))] = list(struct.unpack(f"{order}{count}{_CODES[kind]}", raw))
    return tags


def tiff_pixels(data: bytes, flip: bool = True) -> np.ndarray:
    """Bytes of an uncompressed 8-bit single-band image, the last scanline first if ``flip``."""
    tags = parse_tiff(data)
    one = lambda name, default: tags.get(name, [default])[0]
    if one("compression", 1) != 1 or one("bits_per_sample", 1) != 8 or one("samples_per_pixel", 1) != 1:
        raise ValueError("only uncompressed 8-bit single-band TIFF files are read")
    height, width = one("height", 0), one("width", 0)
    strips = b"".join(data[o : o + n] for o, n in zip(tags["strip_offsets"], tags["strip_byte_counts"]))
    a = np.frombuffer(strips, np.uint8)[: height * width].reshape(height, width)
    return a[::-1] if flip else a


def encode_tiff(array: np.ndarray, rows_per_strip: int = 64) -> bytes:
    """A baseline 8-bit TIFF of an array, its first row as the last scanline."""
    a = np.ascontiguousarray(array[::-1], np.uint8)
    head, tail = _tiff_frame(*a.shape, rows_per_strip)
    return head + a.tobytes() + tail


def _tiff_frame(height: int, width: int, rows_per_strip: int) -> tuple[bytes, bytes]:
    """What stands before and after the strips of a baseline TIFF."""
    sizes = [min(rows_per_strip, height - r) * width for r in range(0, height, rows_per_strip)]
    n, offsets = len(sizes), [8 + k * rows_per_strip * width for k in range(len(sizes))]
    lists_at = 8 + height * width
    lists = struct.pack(f"<{n}I{n}I", *offsets, *sizes)
    one = n == 1
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, n, offsets[0] if one else lists_at), (277, 3, 1, 1), (278, 4, 1, rows_per_strip), (279, 4, n, sizes[0] if one else lists_at + 4 * n)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
    return b"II" + struct.pack("<HI", 42, lists_at + len(lists)), lists + directory


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def tiff_tags(spark: SparkSession, path: str) -> DataFrame:
    """``(path, tag, value)`` of every file; lists are comma-joined."""

    def run(batches):
        for b in batches:
            rows = [(p, t, ",".join(map(str, v))) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t, v in parse_tiff(c).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "tag", "value"])

    return _files(spark, path).mapInArrow(run, "path string, tag string, value string")


def tiff_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """``(path, height, width)``; a file that is no TIFF fails the query."""
    tags = tiff_tags(spark, path).where(F.col("tag").isin("height", "width"))
    return tags.groupBy("path").agg(*[F.max(F.when(F.col("tag") == t, F.col("value").cast("long"))).alias(t) for t in ("height", "width")])


def tiff_cells(spark: SparkSession, path: str, flip: bool = True) -> DataFrame:
    """``(path, i, j, v)`` of every file, a file a task, in slices of rows."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = tiff_pixels(c, flip)
                step = max(1, (1 << 20) // max(1, a.shape[1]))
                for r in range(0, a.shape[0], step):
                    part = a[r : r + step]
                    i, j = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * part.size, pa.string()), pa.array(i.ravel() + r, pa.int64()), pa.array(j.ravel(), pa.int64()), pa.array(part.ravel().astype(np.int32))], ["path", "i", "j", "v"])

    return _files(spark, path).mapInArrow(run, CELLS)


def read_tiff(spark: SparkSession, path: str, orient: str = "flip") -> Raster:
    """Raster of one file; ``orient="flip"`` puts the last scanline in row 0, ``"keep"`` the first."""
    size = tiff_dimensions(spark, path).first()
    return Raster(tiff_cells(spark, path, orient == "flip").select("i", "j", "v"), size.height, size.width)


def read_dat(spark: SparkSession, path: str, shape: tuple[int, int]) -> Raster:
    """Headerless signed bytes of ``shape`` (H, W): file cell (r, c) becomes (i = c, j = H - 1 - r).

    The whole-number categories of the format keep their sign bit as 128 to 255.
    """
    height, width = shape

    def run(batches):
        for b in batches:
            for c in b.column(1).to_pylist():
                a = np.frombuffer(c, np.uint8)[: height * width].reshape(height, width)
                step = max(1, (1 << 20) // max(1, width))
                for r in range(0, height, step):
                    part = a[r : r + step]
                    y, x = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([""] * part.size), pa.array(x.ravel(), pa.int64()), pa.array(height - 1 - r - y.ravel(), pa.int64()), pa.array(part.ravel().astype(np.int32))], ["path", "i", "j", "v"])

    return Raster(_files(spark, path).mapInArrow(run, CELLS).select("i", "j", "v"), width, height)


def _scanlines(raster: Raster, flip: bool, block: int) -> DataFrame:
    """``(strip, bytes)``: runs of ``block`` scanlines of a raster, absent cells 0; the last row comes first if ``flip``."""
    height, width = raster.rows, raster.cols
    line = F.lit(height - 1) - F.col("i") if flip else F.col("i")
    rows = raster.cells.select(address.quotient(line, block).alias("strip"), F.pmod(line, F.lit(block)).alias("line"), "j", "v")

    def run(table: pa.Table) -> pa.Table:
        strip = table.column("strip")[0].as_py()
        a = np.zeros((min(block, height - strip * block), width), np.uint8)
        a[table.column("line").to_numpy(), table.column("j").to_numpy()] = table.column("v").to_numpy().astype(np.uint8)
        return pa.table({"strip": pa.array([strip], pa.int64()), "bytes": pa.array([a.tobytes()], pa.binary())})

    found = rows.groupBy("strip").applyInArrow(run, "strip long, bytes binary")
    every = raster.cells.sparkSession.range(-(-height // block)).select(F.col("id").alias("strip"))
    return every.join(found, "strip", "left").orderBy("strip")


def _write_strips(raster: Raster, path: str, head: bytes, tail: bytes, flip: bool, block: int) -> None:
    """One file, strip by strip, wherever Spark can write; executors build the strips and the driver holds one of them."""
    spark = raster.cells.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(head))
        for row in _scanlines(raster, flip, block).toLocalIterator():
            out.write(bytearray(row.bytes) if row.bytes is not None else bytearray(min(block, raster.rows - row.strip * block) * raster.cols))
        out.write(bytearray(tail))
    finally:
        out.close()


def write_tiff(raster: Raster, path: str, rows_per_strip: int = 64) -> None:
    """A baseline TIFF, the last row as the first scanline; a TIFF is one file, below 4 GB."""
    head, tail = _tiff_frame(raster.rows, raster.cols, rows_per_strip)
    _write_strips(raster, path, head, tail, True, rows_per_strip)


def write_dat(raster: Raster, path: str) -> None:
    """Headerless bytes, a row after the other."""
    _write_strips(raster, path, b"", b"", False, 64)


def pgm_lines(raster: Raster, maxval: int = 255) -> DataFrame:
    """``(place, line)`` of an ASCII graymap, rows from the last to the first; absent cells are 0."""
    spark = raster.cells.sparkSession
    # Rows are as long as the raster is wide: one array each.
    rows = raster.cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    every = spark.range(raster.rows).select(F.col("id").alias("i")).join(rows, "i", "left")
    value = lambda j: F.coalesce(F.element_at("m", j), F.lit(0)).cast("string")
    body = every.select((F.lit(raster.rows) - F.col("i")).alias("place"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(raster.cols - 1).cast("long")), value)).alias("line"))
    head = spark.createDataFrame([(0, f"P2 {raster.cols} {raster.rows} {maxval}")], "place long, line string")
    return head.unionByName(body)


def write_pgm(raster: Raster, path: str) -> None:
    pgm_lines(raster).orderBy("place").select("line").coalesce(1).write.text(path)


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """``(name, seq, value)`` of lines ``name v1 v2 ...``."""
    parts = F.split(F.trim("value"), r"\s+")
    # Lines are split below the explosion; above it, each would be split again for every one of its values.
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("name"), F.slice(parts, F.lit(2), F.size(parts)).alias("values"))
    return rows.select("name", F.posexplode("values").alias("seq", "value")).select("name", "seq", F.col("value").cast("long").alias("value"))


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """``(size, test, times, when)`` of run descriptors, one JSON object a line."""
    return spark.read.schema("size array<int>, test string, times array<long>, when timestamp").json(path)


def write_descriptors(rows: DataFrame, path: str) -> None:
    rows.select("size", "test", "times", "when").write.json(path)


def write_descriptors_yaml(rows: DataFrame, path: str) -> None:
    """One YAML document per run descriptor, parted by the usual ``---`` lines."""
    item = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    lines = (F.lit("---"), F.concat(F.lit("size: "), item("size")), F.concat(F.lit("test: "), F.to_json(F.struct("test")).substr(F.lit(9), F.length(F.to_json(F.struct("test"))) - 9)), F.concat(F.lit("times: "), item("times")), F.concat(F.lit("when: "), F.date_format("when", "yyyy-MM-dd HH:mm:ss")))
    rows.select(F.concat_ws("\n", *lines)).write.text(path)


def read_descriptors_yaml(spark: SparkSession, path: str) -> DataFrame:
    """``(size, test, times, when)`` of all YAML documents below a path or glob; empty files and documents give no rows."""
    import yaml

    def run(batches):
        for batch in batches:
            found = [d for text in batch.column(0).to_pylist() for d in yaml.safe_load_all(text) if d]
            cols = [[d.get(c) for d in found] for c in ("size", "test", "times", "when")]
            kinds = (pa.list_(pa.int32()), pa.string(), pa.list_(pa.int64()))
            when = [str(w) if w is not None else None for w in cols[3]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(when, pa.string())], ["size", "test", "times", "when"])

    rows = spark.read.text(path, wholetext=True).mapInArrow(run, "size array<int>, test string, times array<long>, when string")
    return rows.withColumn("when", F.to_timestamp("when"))


def save_results(results: dict[str, DataFrame], path: str) -> None:
    """Named result tables below one path."""
    for name, df in results.items():
        df.write.parquet(f"{path}/{name}")


def load_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_capacities(curve: DataFrame, path: str) -> None:
    """A box-count curve as text, whose lines carry sizes and counts only."""
    capacity_lines(curve).select("line").write.text(path)


def capacity_lines(curve: DataFrame) -> DataFrame:
    """``(v, eps, line)``: a box-count curve as fixed-width text."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    return curve.select("v", "eps", F.concat(pad("boxsize", 20), pad("boxes", 8), pad("log_boxsize", 20), pad("log_boxes", 20)).alias("line"))


def start(spark: SparkSession, path: str, shape: tuple[int, int]) -> tuple[Raster, DataFrame]:
    """A headerless raster and its categories."""
    raster = read_dat(spark, path, shape)
    return raster, raster.cells.select("v").distinct()


def by_storage_order(raster: Raster, path: str, parts: int = 16) -> None:
    """Cells as Parquet along the Morton curve, so that readers skip by min and max."""
    raster.sorted_by(address.morton("i", "j"), parts).write.parquet(path)
