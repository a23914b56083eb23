"""SpotSigs document fingerprints, in DataFrame functions only.

A spot is a common word; its signature is the word with the next two content
words, common words between them passed over; in stretches without common words,
every word with its next word is a signature too. A fingerprint is the set of a
text's signatures, hashed to 32 bits and listed in order. Likeness is the
Jaccard share of two sets. ``near_duplicates`` partitions sets by length, so
that only sets whose sizes allow the threshold meet, and compares them by
their first signatures; ``against_edit`` compares every document with its
successor and with an edited copy of itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazzo.operators.components import connected_components
from terrazzo.storage import materialize

# Common words that start a spot, in four languages.
COMMON = """the of and to in a is it that for on with as was by be this from are or an at not
le la les de des du et en un une est que qui dans pour sur par avec au ne pas
der die das und den dem ein eine ist von zu mit auf für im nicht sich als auch
el los las y del es por con para su se lo al""".split()
_STOP = "(?:" + "|".join(dict.fromkeys(COMMON)) + ")"
_GAP = rf"(?: {_STOP}(?= ))*+"
_SPOT = rf"(?<![^ ])(?=({_STOP}(?= ){_GAP} [^ ]+{_GAP} [^ ]+))"
_PAIR = r"(?<![^ ])(?=([^ ]+ [^ ]+))"
_BETWEEN = rf" {_STOP}(?= )"
#: Stretches of so many words without a common one give the pairs of their words too.
SPARSE = 8
_COMMON = rf"(?<![^ ])(?=[^ ]{{1,{max(map(len, COMMON))}}}(?: |$)){_STOP}(?![^ ])"
#: Documents of a bucket of neighbouring ids; pieces of the id distribution.
BUCKET, PIECES = 256, 200


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the sorted distinct signatures of column ``text``, as longs.

    Words are lower-cased runs of letters and digits. Beside its spots a text
    has the word pairs of every stretch of ``SPARSE`` or more words between
    common ones. Both depend on near words only, so texts that share a passage
    share its signatures whatever else they hold. A text with neither takes all
    its word pairs; one of one word, or of none, is a signature by itself; null
    and empty texts have none.
    """
    norm = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))
    count = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    words = count(F.col("_n"))
    spots = F.transform(F.regexp_extract_all("_n", F.lit(_SPOT), F.lit(1)), lambda s: F.regexp_replace(s, _BETWEEN, ""))
    stretches = F.filter(F.transform(F.split("_n", _COMMON), lambda p: F.trim(p)), lambda p: count(p) >= SPARSE)
    lone = F.flatten(F.transform(stretches, lambda p: F.regexp_extract_all(p, F.lit(_PAIR), F.lit(1))))
    pairs = F.regexp_extract_all("_n", F.lit(_PAIR), F.lit(1))
    chains = F.when(F.size("_s") > 0, F.col("_s")).when(words > 1, pairs).when(F.length(text) > 0, F.array(F.when(F.length("_n") > 0, F.col("_n")).otherwise(F.col(text)))).otherwise(F.array().cast("array<string>"))
    hashed = F.transform(chains, lambda s: F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumn("_n", norm).withColumn("_s", F.concat(spots, lone)).withColumn(name, F.coalesce(F.sort_array(F.array_distinct(hashed)), F.array().cast("array<bigint>"))).drop("_n", "_s")


def fingerprint(sigs: str) -> Column:
    """The signatures in order, eight hex digits each."""
    return F.lower(F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 8, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Jaccard share of two signature sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def buckets(docs: DataFrame) -> tuple[Column, int]:
    """Expression that deals ``doc_id`` into ordered buckets of about ``BUCKET`` rows, and buckets per piece.

    The distribution of ids is taken as linear between ``PIECES`` quantiles,
    so ids may be spread in any way; null ids come last, in order of ``tag``,
    a hash and so evenly spread, in as many further pieces at most.
    """
    stats = docs.agg(F.count("doc_id").alias("n"), F.count("*").alias("all"), F.percentile_approx("doc_id", [k / PIECES for k in range(PIECES + 1)], 20 * PIECES).alias("q")).first()
    cuts, voids = sorted(set(stats.q or [0])), stats["all"] - stats.n
    fine = max(1, math.ceil(stats.n / max(1, len(cuts) - 1) / BUCKET), math.ceil(voids / PIECES / BUCKET))
    bounds = F.array(*[F.lit(int(c)) for c in cuts])
    piece = F.greatest(F.lit(1), F.least(F.lit(max(1, len(cuts) - 1)), F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))))
    low = F.element_at(bounds, piece)
    high = F.element_at(bounds, F.least(piece + 1, F.lit(len(cuts))))
    part = F.floor((F.col("doc_id") - low).cast("double") / F.greatest(F.lit(1), high - low + 1).cast("double") * fine)
    inside = F.greatest(F.lit(0), F.least(F.lit(fine - 1), part))
    lots = max(1, math.ceil(voids / BUCKET))
    void = F.least(F.lit(lots - 1), F.floor((F.col("tag").cast("double") / 2.0**64 + 0.5) * lots)) + (PIECES + 2) * fine
    # greatest and least pass over nulls, so a null id has to be asked for.
    return F.when(F.col("doc_id").isNull(), void).otherwise(piece.cast("long") * fine + inside).cast("long"), fine


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, own, next_text, following)``: texts and signatures, also of the next document.

    The order is ascending by id, then a hash of the text; the last row is
    followed by the first. Texts move once, to their bucket; the first row of
    each bucket is also dealt to the end of the bucket before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket, fine = buckets(rows)
    keyed = rows.withColumn("tag", F.xxhash64("text")).withColumn("bucket", bucket)
    spot = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id"), F.col("tag"))
    heads = keyed.groupBy("bucket").agg(F.min(spot).alias("head"))
    heads, _ = materialize(heads.withColumn("piece", F.call_function("div", F.col("bucket"), F.lit(fine).cast("long"))), "heads")
    # Buckets follow one another inside a piece; of pieces there are twice PIECES and a few more at most.
    tails = heads.groupBy("piece").agg(F.max("bucket").alias("tail"))
    every = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = tails.select(F.col("piece").alias("_piece"), F.lag("tail").over(Window.orderBy("piece")).alias("_tail"), F.max("tail").over(every).alias("_last"))
    before = F.lag("bucket").over(Window.partitionBy("piece").orderBy("bucket"))
    heads = heads.withColumn("_before", before).join(F.broadcast(tails), F.col("piece") == F.col("_piece"))
    heads = heads.select(F.col("head.doc_id").alias("_d"), F.col("head.tag").alias("_t"), F.coalesce("_before", "_tail").alias("_before"), "_last")
    marked = keyed.join(heads, keyed["doc_id"].eqNullSafe(heads["_d"]) & (keyed["tag"] == heads["_t"]), "left")
    here = F.struct(F.col("bucket"), F.lit(0).alias("extra"))
    there = F.struct(F.coalesce("_before", "_last").alias("bucket"), F.lit(1).alias("extra"))
    dealt = marked.select("doc_id", "tag", "text", F.explode(F.when(F.col("_t").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at")).select("doc_id", "tag", "text", "at.*")
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_last(), "tag")
    # Both windows share the one exchange and sort.
    paired = with_signatures(dealt.withColumn("next_text", F.lead("text").over(order)), "text", "own").withColumn("following", F.lead("own").over(order))
    return paired.where("extra = 0").select("doc_id", "text", "own", "next_text", "following")


def against_edit(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many of the next document, which for the last document is the
    first. One row per input row; null texts count as empty. Two texts without
    signatures are fully alike. A null doc_id orders last, rows of equal id by
    a hash of their text; empty tables give empty results; other columns are
    not read.
    """
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    return with_signatures(rows, "edited", "other").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, component_id, n_links)``: classes of texts at least ``threshold`` alike.

    Equal sets are one class from the start. Sets are partitioned by length,
    each class of lengths reaching as far as the threshold allows. Signatures
    are ordered from the rarest; two sets that are alike enough share one of
    their first in that order, as many as the threshold leaves, so they meet on
    an equi-join of those, and what all texts have in common brings none
    together. Only numbers of sets travel there; the pairs that are left fetch
    their sets and are compared exactly. ``n_links`` counts the other classes
    linked directly. Texts without signatures form one class; rows of equal id
    but other texts are texts of their own; ``component_id`` is the smallest id
    of the class, null where none has an id; empty tables give empty results.
    """
    rows = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "sigs").select("doc_id", "sigs")
    rows, _ = materialize(rows.withColumn("set_key", F.md5(F.array_join(F.transform("sigs", lambda s: F.hex(s)), ","))), "spots")
    sets = rows.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("sigs").alias("sigs"))
    sets, _ = materialize(sets.withColumn("size", F.size("sigs")).withColumn("node", F.monotonically_increasing_id()), "spot-sets")
    each = sets.select("node", "size", F.explode("sigs").alias("sig"))
    often, _ = materialize(each.groupBy("sig").agg(F.count("*").alias("n")), "spot-counts")
    ranked = each.join(often, "sig").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("order"))
    size = F.col("size")
    # Half a unit in the last places keeps a share at the threshold from being rounded off.
    first = F.slice("order", F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
    part = F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    spread, _ = materialize(ranked.select("node", "size", part.alias("part"), F.explode(first).alias("at")).select("node", "size", "part", F.col("at.sig").alias("sig")), "spot-prefixes")
    a = spread.select(F.col("node").alias("a"), F.col("size").alias("na"), "part", "sig")
    # A partner's length class is the same or next to it: each set looks one class up.
    up = spread.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "sig", F.col("part").alias("own"))
    met = a.join(up, ["part", "sig"]).where((F.col("own") > F.col("part")) | (F.col("a") < F.col("b")))
    met = met.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = lambda n: sets.select(F.col("node").alias(n), F.col("sigs").alias(f"s{n}"))
    pairs, _ = materialize(met.join(own("a"), "a").join(own("b"), "b").where(likeness("sa", "sb") >= threshold).select("a", "b"), "spot-pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("_n")).groupBy("_n").agg(F.count("*").alias("n_links"))
    found = connected_components(pairs).select(F.col("node").alias("_node"), "component")
    classes = sets.select("set_key", "node", "least").join(found, F.col("node") == F.col("_node"), "left").join(degree, F.col("node") == F.col("_n"), "left")
    classes = classes.select("set_key", "least", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "set_key").join(classes.join(named, "component").select("set_key", "component_id", "n_links"), "set_key").select("doc_id", "component_id", "n_links")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
