"""Mixing sources to target weights by capped water-filling.

Everything is DataFrame arithmetic on ``(doc_id, source, size)``; texts are
only measured, never shuffled. Every source gets a target in proportion to its
weight, clamped at ``cap`` times its size; what a clamp frees goes to the
others by weight until nothing is above its clamp. The fixed point is found in
closed form: order sources by clamp / weight, and the water level is the first
prefix level that its own source does not exceed.

Repetitions are seeded: a document is taken floor(target / size of source)
whole times, and the remainder goes to documents in a seeded order, whole
copies first and one fractional copy where the quota ends. A source is dealt
into strata of about ``STRATUM`` documents by the same seed, each with its own
quota, so that no source's documents meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
STRATUM = 512


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``(source, source_size, source_docs, target)`` for ``(source, size)`` rows.

    There is one row per source, and a mix states one weight per source, so
    the ordering windows run over a table of that length only. Sources rank by
    code point, null last; weights repeat along that rank.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        per.withColumn("rank", rank)
        .withColumn("weight", weight.cast("long"))
        .withColumn("clamp", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("ratio", F.col("clamp") / F.col("weight"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("clamp").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    )
    target = F.least(F.col("clamp").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("clamp").cast("double")))
    return ranked.select("source", "source_size", "source_docs", target.alias("target"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per input row.

    ``taken`` counts the words the mix takes from a row, repetitions included:
    never above ``cap`` times its size for share <= cap. Null or blank texts
    have size 0 and are taken 0 times; a null ``source`` is a source of its
    own; rows repeated with the same doc_id are dealt like different documents.
    An empty table gives an empty result. Other columns are not read.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return deal(sizes, weights, share, cap, seed)


def deal(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """``mix`` on measured rows; extra columns of ``sizes`` are carried along."""
    # Written first: the planner then knows its size, and joins it to unshuffled documents while it is small.
    targets, _ = materialize(source_targets(sizes, weights, share, cap).withColumnRenamed("source", "_source"), "targets")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    strata = F.ceil(F.col("source_docs") / STRATUM)
    inside = Window.partitionBy("source", "_stratum")
    order = inside.orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.floor(F.col("_rate")).cast("long")
    quota = F.floor((F.col("_rate") - F.floor(F.col("_rate"))) * F.sum("size").over(inside)).cast("long")
    left = F.col("_quota") - (F.col("_upto") - F.col("size"))
    carried = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    return (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_key", key)
        .withColumn("_stratum", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % strata)
        .withColumn("_quota", quota)
        .withColumn("_upto", F.sum("size").over(order))
        .withColumn("taken", whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
        .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), *carried)
    )


def apply(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """``docs``, all columns, as the mix takes them.

    A row comes out once for every whole repetition; where a quota ends inside
    a document, one more row holds the first words that are still taken,
    joined by spaces, with ``n_chars``, where there is one, following. Rows
    taken no times, blank ones among them, go. Ties and nulls as in ``mix``.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("_row"))
    dealt = deal(sizes, weights, share, cap, seed).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = dealt.select("_row", F.explode(copies).alias("_words"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words")), " ")
    rows = rows.withColumn("_text", F.when(F.col("_words") == 0, F.col("_row.text")).otherwise(part))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, (CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS weight, source_size * 2 AS clamp,
  sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM ranked),
ratios AS (SELECT *, clamp::DOUBLE / weight::DOUBLE AS ratio FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(clamp) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM ratios),
water AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS lam FROM levels),
targets AS (SELECT source, source_size, source_docs, least(clamp::DOUBLE, coalesce(lam * weight::DOUBLE, clamp::DOUBLE)) AS target FROM water),
joined AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.source_docs,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
  md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')) AS key
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, ('0x' || key[1:8])::BIGINT % ceil(source_docs / 512.0)::BIGINT AS stratum FROM joined),
quotas AS (SELECT *, floor((rate - floor(rate)) * (sum(size) OVER (PARTITION BY source, stratum))::DOUBLE)::BIGINT AS quota,
  sum(size) OVER (PARTITION BY source, stratum ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM dealt)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT * size + greatest(0, least(size, quota - (upto - size))))::BIGINT AS taken FROM quotas
"""


def op9(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
