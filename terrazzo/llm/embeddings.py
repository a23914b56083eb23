"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on seeded Gaussian lines and the projections rounded
to steps. ``CELL``-wide pieces of a few further projections form the key of a
table; there are as many tables as it takes for two vectors at the threshold to
share a key with probability ``RECALL``. Inside a key, members are sorted along
every line, and for every member as query centre the window collisions with the
others are counted, first on ``FIRST`` lines for all, then on all lines for the
pairs that are left. Both counts that a pair has to reach are calibrated: pairs
at the threshold miss each with a probability of at most ``MISS``, which
follows from the normal distribution of a projected difference.

Tables are searched twice. At first only rounded projections travel, a byte a
line, and members with a passing pair are marked. Then marked members meet once
more with their vectors, and pairs that pass are verified by their cosine in
double precision.

Equal vectors are collapsed before. Keys and projections are computed once and
travel with a vector, so a pair that meets in several tables counts in the
first of them. Tasks emit a count per member and a spanning forest, never the
pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm.tiles import tiled
from terrazzo.operators.components import connected_components
from terrazzo.operators.labels import merge_labels
from terrazzo.storage import materialize

COSINE = 0.95
RECALL, MISS = 0.995, 0.0005
SEED = 20240607
#: Lines whose collisions are counted, how many for all pairs, the step of a rounded projection and a window's half-width in steps.
LINES, FIRST, STEP, HALF = 24, 16, 0.05, 16
#: Width of a key's cells.
CELL = 2.0
#: Members of a key that unlike vectors make up; rows of a tile of a larger key; pairs counted at a time.
FEW, TILE, BLOCK = 512, 4096, 1 << 20


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def cell_share(distance: float) -> float:
    """Probability that two points so far apart fall in one randomly offset cell."""
    t = CELL / distance
    return 2 * _phi(t) - 1 - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Directions of a key, and number of tables, for ``n`` vectors."""
    near, far = cell_share(math.sqrt(2 - 2 * cosine)), cell_share(math.sqrt(2))
    width = max(2, round(math.log(max(2, n / FEW)) / -math.log(far)))
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - near**width))


def least_collisions(cosine: float, lines: int) -> int:
    """Largest count of ``lines`` that pairs at the threshold miss with probability at most ``MISS``."""
    # Rounding moves a difference by a step at most.
    p = 2 * _phi((HALF - 1) * STEP / math.sqrt(2 - 2 * cosine)) - 1
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > MISS:
            return k
    return lines


class Projector:
    def __init__(self, dim: int, width: int, tables: int):
        rng = np.random.default_rng([SEED, dim])
        self.lines = rng.standard_normal((dim, LINES))
        self.axes = rng.standard_normal((dim, width * tables))
        self.shift = rng.random(width * tables)
        self.mix = rng.integers(1, 1 << 62, width, dtype=np.int64) | 1
        self.shape = (tables, width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A key for every vector and table."""
        cells = np.floor(unit @ self.axes / CELL + self.shift).astype(np.int64).reshape(-1, *self.shape)
        h = (cells * self.mix).sum(2)
        return (h ^ (h >> 29)) * np.int64(0x2545F4914F6CDD1D) + np.arange(self.shape[0])

    def steps(self, unit: np.ndarray) -> np.ndarray:
        """Projections in steps, a byte each; far ends are drawn in, which makes nothing miss."""
        return np.clip(np.rint(unit @ self.lines / STEP), -127, 127).astype(np.int8)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _steps(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, LINES).astype(np.int16)


def collisions(left: np.ndarray, right: np.ndarray, bounds: tuple[int, int]):
    """Yields positions ``(x, y)`` of pairs that collide on enough of the first, and on enough of all lines."""
    order = np.argsort(right[:, :FIRST], axis=0, kind="stable")
    rank = np.empty((FIRST, len(right)), np.uint16)
    for line in range(FIRST):
        rank[line, order[:, line]] = np.arange(len(right), dtype=np.uint16)
    step = max(1, BLOCK // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        counts = np.zeros((len(part), len(right)), np.uint8)
        for line in range(FIRST):
            along = right[order[:, line], line]
            low = np.searchsorted(along, part[:, line] - HALF, "left").astype(np.uint16)
            width = np.searchsorted(along, part[:, line] + HALF, "right").astype(np.uint16) - low
            # Ranks before the window wrap around to large numbers.
            counts += rank[line] - low[:, None] < width[:, None]
        x, y = np.nonzero(counts >= bounds[0])
        enough = (np.abs(part[x] - right[y]) <= HALF).sum(1) >= bounds[1]
        yield x[enough] + at, y[enough]


def _pairs(rows: pa.Table, bounds: tuple[int, int]):
    """Yields row positions of the passing pairs of every group of a table, once each, with the group's first row."""
    key, lo, hi, mine = (rows.column(c).to_numpy() for c in ("key", "_lo", "_hi", "_mine"))
    steps = _steps(rows.column("steps"))
    cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
    for a, b in zip(cuts, cuts[1:]):
        if b - a < 2:
            continue
        own = np.arange(a, b)
        same = lo[a] == hi[a]
        left = own if same else own[mine[a:b] == lo[a]]
        right = own if same else own[mine[a:b] != lo[a]]
        for x, y in collisions(steps[left], steps[right], bounds):
            x, y = left[x], right[y]
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield a, x, y


def links(vectors: DataFrame, dim: int, cosine: float, n: int) -> DataFrame:
    """Partial results ``(rep, links, other)`` over classes ``(rep, n, embedding)`` of one dimension.

    ``links`` counts vectors linked to ``rep``; ``other`` is a spanning link or null.
    """
    width, tables = plan(n, cosine)
    bounds = least_collisions(cosine, FIRST), least_collisions(cosine, LINES)

    def project(batches):
        tool = Projector(dim, width, tables)
        for batch in batches:
            unit = _units(batch.column("embedding"), dim)
            steps = tool.steps(unit).tobytes()
            ends = pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32())
            keys = pa.ListArray.from_arrays(ends, pa.array(tool.keys(unit).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array([steps[k : k + LINES] for k in range(0, len(steps), LINES)], pa.binary()), keys], ["rep", "n", "steps", "keys"])

    signs, _ = materialize(vectors.select("rep", "n", "embedding").mapInArrow(project, "rep long, n long, steps binary, keys array<long>"), "vector-signs")
    group = ["key", "_lo", "_hi"]

    def mark(batches):
        for rows in _by_key(batches):
            seen = np.zeros(rows.num_rows, bool)
            for _, x, y in _pairs(rows, bounds):
                seen[x] = seen[y] = True
            if seen.any():
                yield pa.Table.from_arrays([rows.column(c).filter(pa.array(seen)) for c in ("rep", "table", "key")], ["rep", "table", "key"]).combine_chunks().to_batches()[0]

    spread = signs.select("rep", "steps", F.posexplode("keys").alias("table", "key"))
    met = tiled(spread, "key", "rep", TILE).repartition(*group).sortWithinPartitions(*group)
    marked = met.select(*group, "_mine", "rep", "table", "steps").mapInArrow(mark, "rep long, table int, key long").distinct()
    marked, _ = materialize(marked, "vector-marks")

    def count(batches):
        for rows in _by_key(batches):
            unit = _units(rows.column("embedding"), dim)
            rep, weight, table = (rows.column(c).to_numpy() for c in ("rep", "n", "table"))
            keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)
            total = np.zeros(len(rep), np.int64)
            labels = np.arange(len(rep))
            for a, x, y in _pairs(rows, bounds):
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                x, y = x[near], y[near]
                t = int(table[a])
                new = ~(keys[x, :t] == keys[y, :t]).any(1)
                np.add.at(total, x[new], weight[y[new]])
                np.add.at(total, y[new], weight[x[new]])
                labels = merge_labels(labels, x, y)
            some = np.flatnonzero((total > 0) | (labels != np.arange(len(rep))))
            if len(some):
                other = pa.array(rep[labels[some]], mask=labels[some] == some)
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(total[some]), other], ["rep", "links", "other"])

    whole = tiled(marked, "key", "rep", TILE).join(signs, "rep").join(vectors.select("rep", "embedding"), "rep")
    whole = whole.select(*group, "_mine", "table", "rep", "n", "steps", "keys", "embedding").repartition(*group).sortWithinPartitions(*group)
    return whole.mapInArrow(count, "rep long, links long, other long")


def _by_key(batches, at_least: int = 4096):
    """Tables of whole groups, several small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        c = [batch.column(k).to_numpy() for k in ("key", "_lo", "_hi")]
        new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in c], axis=0)]))
        if held and tuple(held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in ("key", "_lo", "_hi")) != tuple(int(x[0]) for x in c) and sum(b.num_rows for b in held) >= at_least:
            yield pa.Table.from_batches(held)
            held = []
        last = int(new[-1])
        if last and sum(b.num_rows for b in held) + last >= at_least:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors link at a cosine of at least ``cosine``; never below it. Null,
    empty or zero vectors, and those with a null or non-finite component, link
    with nothing, as do vectors of different dimension. Rows of equal id are
    vectors of their own for ``n_links``. Rows with a null id belong to the
    vectors equal to them; where no row of equal vectors has an id, they link
    with nothing. An empty table gives an empty result; other columns are not
    read.
    """
    x = F.col("embedding")
    fit = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    # Single precision is kept as it is stored; cosines are computed in double precision either way.
    kind = "array<float>" if "array<float>" in dict(vectors.dtypes)["embedding"] else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(kind).alias("embedding"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    key = F.struct(F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(11), "embedding").alias("h2"))
    keyed, _ = materialize(rows.select("vec_id", "fit", key.alias("cls"), F.when(F.col("fit"), x).alias("embedding")), "vectors")
    classes = keyed.where("fit").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")).where("rep is not null")
    classes, _ = materialize(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    # Dimensions are a property of the model: a handful of values.
    parts = None
    for row in classes.groupBy("dim").count().collect():
        part = links(classes.where(F.col("dim") == row.dim), row.dim, cosine, row["count"])
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = keyed.sparkSession.createDataFrame([], "rep long, links long, other long")
    found, _ = materialize(parts, "vector-links")
    comps = connected_components(found.where("other is not null").select("rep", "other"), "rep", "other")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_r")
    info = classes.select("cls", "rep", "n").join(linked, F.col("rep") == F.col("_r"), "left").join(comps, F.col("rep") == F.col("node"), "left")
    info = info.select(F.col("cls").alias("_c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    component = F.coalesce(F.when(F.col("fit"), F.col("component_id")), F.col("vec_id"))
    out = keyed.select("vec_id", "fit", "cls").join(info, F.col("fit") & (F.col("cls") == F.col("_c")), "left")
    return out.select("vec_id", F.when(F.col("fit"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
