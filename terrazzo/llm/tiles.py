"""Dealing bucketed self-joins to tasks, with large buckets cut into tiles.

A bucket of n rows becomes one group while n is at most ``size``; a larger one
is dealt by hash into ceil(n / size) chunks and every pair of chunks becomes a
group of its own. No row is dropped, no group exceeds about twice ``size``
rows, and a hot bucket is spread over as many tasks as it has chunk pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, key: str, deal_by: str, size: int) -> DataFrame:
    """``rows`` with ``_lo``, ``_hi`` and ``_mine``: the tile, and the row's own chunk."""
    hot = rows.groupBy(key).count().where(F.col("count") > size).select(F.col(key).alias("_key"), F.ceil(F.col("count") / size).cast("int").alias("_g"))
    chunk = F.pmod(F.xxhash64(F.lit(7), deal_by), F.col("_g")).cast("int")
    return (
        rows.join(hot, F.col(key) == F.col("_key"), "left")
        .drop("_key")
        .withColumn("_g", F.coalesce("_g", F.lit(1)))
        .withColumn("_mine", chunk)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .withColumn("_lo", F.least("_mine", "_other"))
        .withColumn("_hi", F.greatest("_mine", "_other"))
        .drop("_other", "_g")
    )


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group side by side in one partition, for ``by_group``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], few: int = 2) -> Iterator[pa.Table]:
    """Tables of one group each, for groups of at least ``few`` rows.

    Input rows are sorted by ``keys``. A group's rows are held at once, never a
    partition's.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(new).tolist(), n]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            if sum(b.num_rows for b in held) >= few:
                yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if b == n:
                held.append(part)
            elif a == 0 and held:
                held.append(part)
                if sum(x.num_rows for x in held) >= few:
                    yield pa.Table.from_batches(held)
                held = []
            elif b - a >= few:
                yield pa.Table.from_batches([part])
        last = tuple(c[-1] for c in cols)
    if sum(b.num_rows for b in held) >= few:
        yield pa.Table.from_batches(held)
