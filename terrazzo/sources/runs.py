"""Benchmark runs as Parquet tables: machine, build, run and timing."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "machine": "machine_id string, attributes map<string,string>",
    "build": "build_id string, attributes map<string,string>",
    "run": "run_id string, machine_id string, build_id string, started timestamp, attributes map<string,string>",
    "timing": "run_id string, test string, seq long, iterations long, ns long",
}


def _key(attributes: Mapping[str, str]) -> str:
    return hashlib.sha1("\t".join(f"{k}={v}" for k, v in sorted(attributes.items())).encode()).hexdigest()


def parse_started(text) -> Column:
    """Timestamps written like 2014-Jan-31 12:00:00."""
    return F.to_timestamp(text, "yyyy-MMM-dd HH:mm:ss")


class RunStore:
    """Append-only store below one path; equal machines and builds share an id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def add(self, timings: Mapping[str, list[tuple[int, int]]], machine: Mapping[str, str], build: Mapping[str, str], options: Mapping[str, str] | None = None, started: datetime | None = None) -> str:
        """Record a run of ``{test: [(iterations, ns), ...]}``; returns its id."""
        run_id, m, b = str(uuid.uuid4()), _key(machine), _key(build)
        for name, key, attributes in (("machine", m, machine), ("build", b, build)):
            if self.table(name).where(F.col(f"{name}_id") == key).isEmpty():
                self._append(name, [(key, dict(attributes))])
        self._append("run", [(run_id, m, b, started or datetime.now(), dict(options or {}))])
        rows = [(run_id, test, k, *map(int, pair)) for test, pairs in timings.items() for k, pair in enumerate(pairs)]
        if rows:
            self._append("timing", rows)
        return run_id

    def catalog(self) -> DataFrame:
        """Runs in order of their start, numbered from 0, with their build's and machine's attributes."""
        run = self.table("run").join(self.table("build").withColumnRenamed("attributes", "build"), "build_id", "left").join(self.table("machine").withColumnRenamed("attributes", "machine"), "machine_id", "left")
        return run.withColumn("idx", (F.row_number().over(Window.orderBy("started", "run_id")) - 1).cast("long"))

    def series(self, idx: int, test: str) -> DataFrame:
        """``(seq, iterations, ns)`` of one test of the idx-th run."""
        run = self.catalog().where(F.col("idx") == idx).select("run_id")
        return self.table("timing").where(F.col("test") == test).join(run, "run_id", "left_semi").select("seq", "iterations", "ns").orderBy("seq")


def timeit(fn: Callable[[], object], n: int = 1) -> float:
    """Mean nanoseconds of a call; DataFrames that it returns are run to their end."""
    began = time.perf_counter_ns()
    for _ in range(n):
        out = fn()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
    return (time.perf_counter_ns() - began) / n


def time_clock(fn: Callable[[], object], n: int = 1) -> float:
    """Mean CPU seconds of a call on the driver."""
    began = time.process_time()
    for _ in range(n):
        fn()
    return (time.process_time() - began) / n


def usage(fn: Callable[[], object], n: int = 1) -> dict[str, float]:
    """What ``n`` calls used of the driver: seconds in user and system code, page faults, and the peak of resident KB."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF)
    for _ in range(n):
        fn()
    after = resource.getrusage(resource.RUSAGE_SELF)
    return {"user": after.ru_utime - before.ru_utime, "system": after.ru_stime - before.ru_stime, "faults": after.ru_minflt + after.ru_majflt - before.ru_minflt - before.ru_majflt, "max_rss": after.ru_maxrss}


def compare(fns: Mapping[str, Callable[[], object]], rounds: int = 5, seed: int = 0) -> dict[str, list[int]]:
    """Times of several functions, in a new random order each round so that none is always first."""
    import random

    order, out = random.Random(seed), {name: [] for name in fns}
    for _ in range(rounds):
        for name in order.sample(list(fns), len(fns)):
            out[name].append(int(timeit(fns[name])))
    return out


def lines(timing: DataFrame) -> DataFrame:
    """``(test, line)``: a test's iterations and times as one line of text."""
    pairs = F.sort_array(F.collect_list(F.struct("seq", "iterations", "ns")))
    return timing.groupBy("test").agg(pairs.alias("p")).select("test", F.concat_ws("\t", "test", F.concat_ws(" ", F.transform("p", lambda p: F.concat_ws(" ", p["iterations"].cast("string"), p["ns"].cast("string"))))).alias("line"))


def optimization(text) -> Column:
    """The value of ``optimization = x`` in tab-joined build settings."""
    return F.regexp_extract(text, r"(?:^|\t)optimization\s*=\s*([^\t]*)", 1)


def plain_uuid(text) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))
