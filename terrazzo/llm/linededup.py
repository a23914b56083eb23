"""Line dedup by overlapping three-line windows.

Every run of ``window`` consecutive lines is hashed to 128 bits. Windows that
occur again anywhere are found with one pre-aggregated first occurrence per
hash; all later ones mark their positions, and the positions a document's
marked windows cover are merged and removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import repeats
from terrazzo.storage import materialize

WINDOW = 3
SCHEMA = "doc_id long, n_lines long, n_removed long, kept string"


def windows(docs: DataFrame, window: int) -> DataFrame:
    """``(h1, h2, doc_id, tag, place)`` of every run of ``window`` lines."""

    def run(batches):
        for batch in batches:
            rows, places, digests = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                b = text.encode()
                ends = [*np.flatnonzero(np.frombuffer(b, np.uint8) == 10).tolist(), len(b)]
                starts = [0, *(e + 1 for e in ends)]
                own = [xxhash.xxh3_128_digest(b[s:e]) for s, e in zip(starts, ends[window - 1 :])]
                digests += own
                rows += [k] * len(own)
                places += range(len(own))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc_id").take(index), batch.column("tag").take(index), pa.array(places, pa.int64())],
                ["h1", "h2", "doc_id", "tag", "place"],
            )

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, tag long, place long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept)``: texts without lines of repeated windows.

    Lines end at ``\\n`` and compare exactly. A line goes if a window over it
    also starts earlier: in a smaller doc_id, or before it in the same text.
    ``kept`` is the remaining lines joined by ``\\n``, or its SHA-256 if
    ``digest``. Texts with fewer lines than a window lose nothing; a null text
    has no lines and an empty kept text, an empty text one empty line; a null
    doc_id orders first; rows that repeat id and text are one document and give
    equal results. Empty tables give empty results; other columns are not read.
    """
    rows = repeats.keyed(docs)
    return _apply(repeats.with_ranges(rows, _later(rows, window)), digest)


def _later(rows: DataFrame, window: int) -> DataFrame:
    """Ranges of lines under windows that occur earlier too.

    Windows are hashed and written once; so are the first places of those that
    repeat, so that both sides of the join are dealt afresh and the rows of a
    very common window can be split.
    """
    found, _ = materialize(windows(rows, window), "lines")
    spot = F.struct("doc_id", "tag", "place")
    firsts = found.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = found.join(materialize(firsts, "firsts")[0], ["h1", "h2"]).where(~(F.struct("doc_id", "tag", "place").eqNullSafe(F.col("first"))))
    return later.select("doc_id", "tag", F.col("place").alias("a"), (F.col("place") + F.lit(window)).alias("b"))


def _left(lines: list[str], spans) -> list[str]:
    at, left = 0, []
    for a, b in repeats.merged(spans):
        left += lines[at:a]
        at = b
    return left + lines[at:]


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, with later repeats of line windows cut from ``text``.

    Removal, nulls, ties and repeated rows as in ``remove_repeats``; null texts
    stay null, and ``n_chars``, where there is one, follows the text.
    """
    rows = repeats.keyed(docs)
    per = repeats.by_document(_later(rows, window))
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tag"))

    @F.pandas_udf("string")
    def rest(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        spans = ([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())] for a, b in zip(starts, ends))
        return pd.Series(["\n".join(_left(t.split("\n"), s)) for t, s in zip(text, spans)], dtype=object)

    joined = whole.join(per, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_tag") == F.col("_t")), "left")
    # Rows without ranges carry empty lists past the function.
    bounds = [F.coalesce(F.col(f"ranges.{c}"), F.array().cast("array<bigint>")) for c in ("a", "b")]
    cut = joined.withColumn("_text", F.when(F.col("ranges").isNull(), F.col("_row.text")).otherwise(rest(F.coalesce("_row.text", F.lit("")), *bounds)))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return cut.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


def _apply(rows: DataFrame, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                lines = text.split("\n") if text is not None else []
                left = _left(lines, spans)
                total.append(len(lines))
                gone.append(len(lines) - len(left))
                joined = "\n".join(left)
                kept.append(hashlib.sha256(joined.encode()).hexdigest() if digest else joined)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept"])

    return rows.mapInArrow(run, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
win AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k FROM win WHERE body IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k))
SELECT d.doc_id, count(l.line)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id
"""
