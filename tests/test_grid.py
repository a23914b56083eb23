"""Addressing, neighbourhood, resizing and quadtrees against goldens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import address
from terrazzo.operators import quadtree, topology
from terrazzo.raster import from_rows, grid
from terrazzo.sources import synth


def one(spark, column):
    return spark.range(1).select(F.array(*column) if isinstance(column, tuple) else column).first()[0]


def test_linear_and_morton(spark):
    assert [one(spark, address.linear(i, j, 512)) for i, j in ((0, 0), (0, 100), (2, 100))] == [0, 100, 1124]
    assert one(spark, address.morton(0b011, 0b110)) == 0b101101
    assert [one(spark, address.morton(*p)) for p in ((1, 1), (1, 2), (2, 1))] == [3, 9, 6]
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 2**31, (200, 2))]
    df = spark.createDataFrame(rows, "x long, y long").withColumn("n", address.morton("x", "y"))
    x, y = address.unmorton("n")
    assert df.where((x != F.col("x")) | (y != F.col("y"))).count() == 0


def test_interleaved_sums(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(int, r)) for r in rng.integers(0, 32768, (100, 4))]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = address.interleaved_add(address.morton("a", "b"), address.morton("c", "d"))
    assert df.where(got != address.morton(F.col("a") + F.col("c"), F.col("b") + F.col("d"))).count() == 0


@pytest.mark.parametrize("rows,cols,block", [(8, 8, 4), (7, 10, 4), (5, 3, 2)])
def test_full_blocks_round_trip(spark, rows, cols, block):
    df = grid(spark, rows, cols).withColumn("n", address.full_blocked("i", "j", cols, block))
    i, j = address.full_unblocked("n", cols, block)
    assert df.where((i != F.col("i")) | (j != F.col("j"))).count() == 0
    assert df.select("n").distinct().count() == rows * cols


def test_location_codes(spark):
    assert one(spark, address.from_digits(F.array(F.lit(3), F.lit(2), F.lit(0)))) == 0b111000
    assert one(spark, address.digits(F.lit(0b1110), 2)) == [3, 2]
    assert one(spark, address.unmorton(F.lit(0b111000))) == [4, 6]
    assert one(spark, address.bounding_box(F.lit(0b010000), F.lit(1), 3)) == [4, 0, 8, 4]
    around = [one(spark, address.neighbor(F.lit(0), F.lit(3), 3, F.lit(x), F.lit(y))) for x, y in address.COMPASS]
    assert around == [1, 3, 2, 0b010111, 0b010101, 0b111111, 0b101010, 0b101011]
    assert one(spark, address.child(F.lit(0), F.lit(0), 3, F.lit(2))) == 0b100000
    assert [address.levels_for(*s) for s in ((8, 8), (9, 2), (1, 1), (358, 50))] == [3, 4, 0, 9]


def test_degrees(spark):
    def degrees(rows, cols):
        raster = synth.hash_pattern(spark, rows, cols)
        return {r.degree: r.cells for r in topology.neighbor_degree(raster).collect()}

    assert degrees(10, 10) == {4: 64, 3: 32, 2: 4}
    assert sum(k * c for k, c in degrees(3, 3).items()) == 24
    assert sum(k * c for k, c in degrees(256, 512).items()) == 522_752


def test_seams_by_value(spark):
    rects = spark.createDataFrame([("a", 0, 10, 0, 10), ("b", 0, 10, 10, 20), ("c", 10, 20, 0, 10), ("d", 10, 20, 10, 20), ("e", 0, 10, 30, 40), ("f", 5, 12, 20, 30)], "name string, r0 long, r1 long, c0 long, c1 long")
    got = {(r.a, r.b): (r.vertical, r.line, r.lo, r.hi) for r in topology.seams(rects).collect()}
    assert got == {("a", "b"): (True, 10, 0, 10), ("a", "c"): (False, 10, 0, 10), ("b", "d"): (False, 10, 10, 20), ("c", "d"): (True, 10, 10, 20), ("b", "f"): (True, 20, 5, 10), ("d", "f"): (True, 20, 10, 12), ("f", "e"): (True, 30, 5, 10)}
    edges = topology.seam_edges(topology.seams(rects).where("a = 'b' and b = 'f'"), 100).orderBy("s").collect()
    assert [(r.s, r.t) for r in edges] == [(i * 100 + 19, i * 100 + 20) for i in range(5, 10)]


def test_resizing(spark):
    r = from_rows(spark, [[1, 2, 3], [1, 2, 3], [4, 5, 6]])

    def dense(x):
        a = np.zeros((x.rows, x.cols), int)
        for c in x.cells.collect():
            a[c.i, c.j] = c.v
        return a.tolist()

    assert dense(r.tile_to(3, 3)) == dense(r) == [[1, 2, 3], [1, 2, 3], [4, 5, 6]]
    assert dense(r.tile_to(2, 2)) == [[1, 2], [1, 2]]
    assert dense(r.tile_to(4, 4)) == [[1, 2, 3, 1], [1, 2, 3, 1], [4, 5, 6, 4], [1, 2, 3, 1]]
    assert dense(r.flip_rows()) == [[4, 5, 6], [1, 2, 3], [1, 2, 3]]
    assert dense(r.transpose().flip_cols()) == [[4, 1, 1], [5, 2, 2], [6, 3, 3]]


def test_multi_value(spark):
    assert synth.multi_value(spark, 100, 100, 3, 36).cells.select("v").distinct().count() == 33
    with pytest.raises(ValueError):
        synth.multi_value(spark, 2, 2, 0, 25)


# Digits, level, colour and level differences (east, north, west, south; None at the border).
LEAVES = [
    ((0, 0, 0), 1, "white", (1, 0, None, None)), ((1, 0, 0), 2, "white", (0, 0, -1, None)), ((1, 1, 0), 2, "white", (None, 0, 0, None)),
    ((1, 2, 0), 2, "black", (0, 0, -1, 0)), ((1, 3, 0), 2, "black", (None, 0, 0, 0)), ((2, 0, 0), 1, "black", (1, None, None, 0)),
    ((3, 0, 0), 2, "black", (0, 1, -1, 0)), ((3, 1, 0), 2, "white", (None, 0, 0, 0)), ((3, 2, 0), 3, "black", (0, 0, -2, -1)),
    ((3, 2, 1), 3, "white", (-1, 0, 0, -1)), ((3, 2, 2), 3, "black", (0, None, -2, 0)), ((3, 2, 3), 3, "white", (-1, None, 0, 0)),
    ((3, 3, 0), 2, "white", (None, None, 1, 0)),
]


def _code(digits):
    return digits[0] << 4 | digits[1] << 2 | digits[2]


def test_quadtree_of_the_example(spark):
    black = synth.example_image(spark).category(1).selectExpr("i as x", "j as y")
    tree = quadtree.leaves(black, 3)
    got = {(r.code, r.level): (r.color, (r.east, r.north, r.west, r.south)) for r in quadtree.level_differences(tree, 3).collect()}
    want = {(_code(d), level): (color, sides) for d, level, color, sides in LEAVES}
    # The last leaf's sides: outside twice, a subdivided neighbour to the west, an equal one to the south.
    assert got == want
    near = {(r.code, r.d): r.to_code for r in quadtree.neighbors(tree, 3).collect()}
    assert near[_code((3, 0, 0)), 2] == _code((2, 0, 0)) and (_code((3, 0, 0)), 1) not in near
    parts = {(r.code, r.level): r.component for r in quadtree.components(tree, 3).collect()}
    assert len({c for k, c in parts.items() if want[k][0] == "black"}) == 1
    assert quadtree.locate(tree, 5, 5, 3).first().color == "black"


def test_quadtree_edges(spark):
    none = spark.createDataFrame([], "x long, y long")
    assert [tuple(r) for r in quadtree.leaves(none, 3).collect()] == [(0, 0, "white")]
    full = grid(spark, 4, 4).selectExpr("i as x", "j as y")
    assert [tuple(r) for r in quadtree.leaves(full, 2).collect()] == [(0, 0, "black")]
    padded = quadtree.leaves(grid(spark, 3, 3).selectExpr("i as x", "j as y"), 2)
    assert padded.where("color = 'black'").selectExpr("sum(power(4, 2 - level))").first()[0] == 9
