"""Rasters that arrive as streams of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(cells: DataFrame, ts: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``(start, v, cells)``: categories per tumbling window of event time.

    Works on static and streaming tables alike; on a stream, cells later than
    the watermark are dropped, and windows come out once they are complete.
    """
    marked = cells.withWatermark(ts, late) if cells.isStreaming else cells
    return marked.groupBy(F.window(ts, window).alias("w"), "v").agg(F.count("*").alias("cells")).select(F.col("w.start").alias("start"), "v", "cells")
