"""Clusters against goldens, a flood fill, and each other."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays
from pyspark.sql import functions as F

from terrazzo.operators import clusters
from terrazzo.operators.components import connected_components
from terrazzo.raster import Raster, from_rows
from terrazzo.sources import synth


def flood(a):
    out, rows, cols = {}, *a.shape
    for n in range(rows * cols):
        if n in out:
            continue
        stack = [n]
        out[n] = n
        while stack:
            i, j = divmod(stack.pop(), cols)
            for x, y in ((i, j + 1), (i + 1, j), (i, j - 1), (i - 1, j)):
                m = x * cols + y
                if 0 <= x < rows and 0 <= y < cols and m not in out and a[x, y] == a[i, j]:
                    out[m] = n
                    stack.append(m)
    return out


def found(raster, **how):
    return {r.n: r.cluster_id for r in clusters.label(raster, **how).collect()}


GOLDEN = [
    ([[1, 1], [1, 1]], [[0, 1, 2, 3]]),
    ([[1, 1], [2, 2]], [[0, 1], [2, 3]]),
    ([[1, 1], [2, 6]], [[0, 1], [2], [3]]),
    ([[1, 2, 3], [1, 2, 3], [3, 2, 1]], [[0, 3], [1, 4, 7], [2, 5], [6], [8]]),
    ([[1, 1], [1, 2]], [[0, 1, 2], [3]]),
    ([[2, 1], [1, 1]], [[0], [1, 2, 3]]),
    ([[1, 2, 1], [1, 2, 1], [1, 1, 1]], [[0, 2, 3, 5, 6, 7, 8], [1, 4]]),
    ([[5]], [[0]]),
    ([[1, 1, 2, 2, 1]], [[0, 1], [2, 3], [4]]),
    ([[1], [1], [2]], [[0, 1], [2]]),
]


@pytest.mark.parametrize("rows,expected", GOLDEN)
@pytest.mark.parametrize("how", [{}, {"tile": 2}, {"strategy": "runs"}])
def test_golden(spark, rows, expected, how):
    labels = clusters.label(from_rows(spark, rows), **how)
    assert [r.members for r in clusters.members(labels).orderBy("cluster_id").collect()] == expected


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=arrays(np.uint8, st.tuples(st.integers(1, 12), st.integers(1, 12)), elements=st.integers(0, 2)))
def test_random_rasters_match_a_flood_fill(spark, a):
    want = flood(a)
    raster = Raster.from_array(spark, a)
    assert found(raster, tile=4) == want
    assert found(raster, strategy="runs") == want


def test_views_are_read_as_they_look(spark):
    a = np.array([[1, 2, 3], [1, 2, 3], [3, 2, 1]], np.uint8)
    assert found(Raster.from_array(spark, a[:2, :2])) == {0: 0, 1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("make", [synth.spiral, synth.serpentine])
def test_long_corridors(spark, make):
    raster = make(spark)
    a = np.zeros((raster.rows, raster.cols), np.uint8)
    for r in raster.cells.collect():
        a[r.i, r.j] = r.v
    assert found(raster, tile=16) == flood(a)


def test_known_counts(spark):
    for k in (1, 25, 100):
        labels = clusters.label(synth.multi_value(spark, 100, 100, 0, k), tile=32)
        assert clusters.count(labels).where("v is null").first().clusters == k


def test_empty_raster(spark):
    empty = Raster(spark.createDataFrame([], "i long, j long, v int"), 0, 0)
    assert clusters.label(empty).count() == 0


def test_predicate_and_diagonals(spark):
    raster = from_rows(spark, [[1, 3], [2, 1]])
    assert found(raster, predicate=lambda a, b: F.abs(a - b) <= 1) == {0: 0, 1: 1, 2: 0, 3: 0}
    assert found(raster, connectivity=8) == {0: 0, 1: 1, 2: 2, 3: 0}


def test_at_and_ranks(spark):
    labels = clusters.label(from_rows(spark, [[1, 2, 3], [1, 2, 3], [3, 2, 1]]))
    assert sorted(r.n for r in clusters.at(labels, 2).collect()) == [2, 5]
    assert clusters.at(labels, 9).count() == 0
    assert [r.cluster_id for r in clusters.ranked(labels).orderBy("k").collect()] == [0, 1, 2, 6, 8]


def test_size_distribution(spark):
    labels = clusters.label(from_rows(spark, [[1, 1, 1, 2, 1]]))
    got = {(r.v, r.bin): (r.clusters, r.before) for r in clusters.size_distribution(labels).collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (0, 1), (1, 3): (1, 1), (2, 1): (1, 0)}
    compat = {(r.v, r.bin): r.clusters for r in clusters.size_distribution(labels, compat=True).collect()}
    assert compat == {(1, 1): 1, (1, 2): 0, (1, 3): 1, (2, 1): 1}


def test_components_ignore_loops_nulls_and_repeats(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 5), (None, 4), (7, 9)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    assert connected_components(edges.where("a > 100")).count() == 0


def test_long_chain_settles(spark):
    edges = spark.range(600).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in connected_components(edges).collect()} == {0}
