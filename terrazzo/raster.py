"""The raster handle: a DataFrame of ``(i, j, v)`` cells and the domain it lies in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazzo.functions import address


@dataclass(frozen=True)
class Raster:
    """Cells ``(i BIGINT, j BIGINT, v INT)`` over ``rows`` x ``cols``; absent cells lie outside."""

    cells: DataFrame
    rows: int
    cols: int

    @classmethod
    def from_array(cls, spark: SparkSession, array) -> Raster:
        """Raster of a two-dimensional array of categories 0 to 255, views included."""
        import numpy as np

        a = np.ascontiguousarray(array)
        if a.ndim != 2 or a.dtype.kind not in "ui":
            raise ValueError("a two-dimensional array of integers is needed")
        if a.size and (a.min() < 0 or a.max() > 255):
            raise ValueError("categories lie between 0 and 255")
        i, j = np.indices(a.shape)
        import pyarrow as pa

        table = pa.table({"i": pa.array(i.ravel(), pa.int64()), "j": pa.array(j.ravel(), pa.int64()), "v": pa.array(a.ravel(), pa.int32())})
        return cls(spark.createDataFrame(table), *a.shape)

    def with_index(self, name: str = "n") -> DataFrame:
        return self.cells.withColumn(name, address.linear("i", "j", self.cols))

    def tile_to(self, rows: int, cols: int) -> Raster:
        """Repeat or crop to a new size: cell (i, j) takes (i mod rows, j mod cols)."""
        down = -(-rows // max(1, self.rows))
        across = -(-cols // max(1, self.cols))
        out = self.cells.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        out = out.select((F.col("i") + F.col("_a") * self.rows).alias("i"), (F.col("j") + F.col("_b") * self.cols).alias("j"), "v")
        return Raster(out.where((F.col("i") < rows) & (F.col("j") < cols)), rows, cols)

    def flip_rows(self) -> Raster:
        return Raster(self.cells.select((F.lit(self.rows - 1) - F.col("i")).alias("i"), "j", "v"), self.rows, self.cols)

    def flip_cols(self) -> Raster:
        return Raster(self.cells.select("i", (F.lit(self.cols - 1) - F.col("j")).alias("j"), "v"), self.rows, self.cols)

    def transpose(self) -> Raster:
        return Raster(self.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.cols, self.rows)

    def category(self, *values: int) -> DataFrame:
        """Cells of some categories; none match an absent category."""
        return self.cells.where(F.col("v").isin(list(values)))

    def within(self, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
        """Cells of a half-open rectangle."""
        return self.cells.where((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))

    def runs(self) -> DataFrame:
        """``(i, j0, j1, v)``: maximal runs of equal neighbours along each row, ends inclusive."""
        row = Window.partitionBy("i").orderBy("j")
        new = F.coalesce((F.lag("v").over(row) != F.col("v")) | (F.lag("j").over(row) != F.col("j") - 1), F.lit(True))
        marked = self.cells.withColumn("_run", F.sum(new.cast("int")).over(row))
        return marked.groupBy("i", "_run").agg(F.min("j").alias("j0"), F.max("j").alias("j1"), F.first("v").alias("v")).drop("_run")

    def sorted_by(self, key, parts: int) -> DataFrame:
        """Cells range-partitioned and sorted along a storage order, for min-max skipping when written."""
        return self.cells.withColumn("_k", key).repartitionByRange(parts, "_k").sortWithinPartitions("_k").drop("_k")


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """All ``(i, j)`` of a domain."""
    n = spark.range(rows * cols)
    i, j = address.unlinear("id", max(1, cols))
    return n.select(i.alias("i"), j.alias("j"))


def from_rows(spark: SparkSession, rows: Sequence[Sequence[int]]) -> Raster:
    """Raster of nested lists."""
    import numpy as np

    return Raster.from_array(spark, np.array(rows, np.uint8).reshape(len(rows), len(rows[0]) if rows else 0))
