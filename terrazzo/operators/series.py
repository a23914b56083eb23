"""Statistics of measured series: limits, moments, histograms, pairwise tests, merges."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.storage import materialize


def stats(series: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, low, high, mean, stdev)`` with the population deviation; nulls do not count."""
    v = F.col(value).cast("double")
    return series.groupBy(key).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"))


def clip(series: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows strictly between the limits."""
    return series.where((F.col(value) > low) & (F.col(value) < high))


def histogram(series: DataFrame, key: str, value: str, bins: int = 100, binsize: float | None = None) -> DataFrame:
    """``(key, bin, lo, hi, count)`` of equal-width bins, the last closed; empty bins have no row.

    Bins span a key's values; with ``binsize`` they are ceil(high / binsize) - 1
    bins from 1 to ceil(high), and values outside do not count.
    """
    v = F.col(value).cast("double")
    span = series.where(v.isNotNull()).groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    if binsize is not None:
        span = span.select(key, F.lit(1.0).alias("_lo"), F.ceil("_hi").cast("double").alias("_hi"), F.greatest(F.lit(1), F.ceil(F.col("_hi") / binsize) - 1).alias("_n"))
    else:
        span = span.withColumn("_n", F.lit(bins))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_n")
    joined = series.select(F.col(key), v.alias("_v")).where("_v is not null").join(span, key).where("_v >= _lo and _v <= _hi")
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.col("_n") - 1)).otherwise(F.lit(0)).cast("long")
    counted = joined.groupBy(key, "_lo", "_hi", "_n", place.alias("bin")).agg(F.count("*").alias("count"))
    return counted.select(key, "bin", (F.col("_lo") + F.col("bin") * width).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"), "count")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_tail(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_tail(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)) for a, b in zip(t, df)], dtype="Float64").astype(float)

    return run(t, df)


def pairwise_t(series: DataFrame, key: str, value: str, with_p: bool = False) -> DataFrame:
    """``(a, b, t, df)`` of two-sample t-tests with pooled variance for every ordered pair of keys.

    Moments come first, so the pairs are of one row per key.
    """
    v = F.col(value).cast("double")
    m = series.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s"))
    a, b = (m.select(*[F.col(c).alias(f"{p}_{c}") for c in (key, "n", "m", "s")]) for p in "ab")
    pairs = a.join(b, F.col(f"a_{key}") != F.col(f"b_{key}"))
    df = F.col("a_n") + F.col("b_n") - 2
    pooled = ((F.col("a_n") - 1) * F.col("a_s") + (F.col("b_n") - 1) * F.col("b_s")) / df
    t = (F.col("a_m") - F.col("b_m")) / F.sqrt(pooled * (F.lit(1.0) / F.col("a_n") + F.lit(1.0) / F.col("b_n")))
    out = pairs.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), t.alias("t"), df.alias("df"))
    return out.withColumn("p", p_value(F.col("t"), F.col("df").cast("double"))) if with_p else out


def merge_keep_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two keyed tables; where both have a key, the first's row stays."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def pretty(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``line``: columns as text, padded to their widest value, blank-joined; headings are not rows."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    text = df.select(*cols)
    heads = {c: len((aliases or {}).get(c, c)) for c in df.columns}
    widths = text.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in df.columns]).first()
    return text.select(F.concat_ws(" ", *[F.lpad(c, max(widths[c], heads[c]), " ") for c in df.columns]).alias("line"))


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a seeded random order of their keys, whatever the layout; equal keys stay together."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """An ordered table with places from 0: written by its partitions, whose sizes say where each starts."""
    rows, _ = materialize(ordered.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # One row a partition.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    placed = rows.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return placed.select(*ordered.columns, (F.col("_at") + inside).alias(name))


def running_total(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``df`` with ``before``: the sum of earlier values, 0 for the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
