"""Shared scratch tables: how multi-round plans cut their lineage.

A round is written as Parquet below the folder named by
``spark.checkpoint.dir`` and read back, so that later rounds neither recompute
it after losing an executor nor carry its plan statistics along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no checkpoint folder (tests, the bench).
LOCAL_DIR = "/tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder. A session with executors of its own has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/") + "/terrazzo"


#: Scratch tables written inside each open ``scratch`` block.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the scratch tables written inside, but for paths taken off the list it yields."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            discard(spark, path)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared scratch folder; return it re-read, and its path.

    Results of operators read such tables lazily, so outside a ``scratch``
    block they stay until the folder is emptied.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
