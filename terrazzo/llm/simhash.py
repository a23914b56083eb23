"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that may differ in ``bits`` places are cut into more than ``bits``
blocks: any two within that distance agree on all but ``bits`` of them, so they
are dealt by every choice of so many blocks. The number of blocks, and with it
the length of a key, follows from the number of fingerprints. Inside a key,
distinct fingerprints are sorted by Gray rank, so that neighbours share
most of their bits; runs of ``FAN`` neighbours factor what they share (a mask
and a pattern) into an upper node, level by level. A search walks down from
the root, adding the differences of each node's own mask, and drops a whole
group as soon as the sum exceeds the bound; at a leaf the sum is the distance.

Equal fingerprints are collapsed before any dealing and a task emits a
spanning forest of its links, so groups of copies never become pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazzo.llm.anchors import mixed
from terrazzo.llm.tiles import by_group, grouped, tiled
from terrazzo.operators.components import connected_components
from terrazzo.operators.labels import merge_labels
from terrazzo.storage import materialize

FAN = 8
SEED = 42
#: Rows of a tile; frontier entries that a search holds at once.
TILE, FRONTIER = 8192, 1 << 21
EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, A-Z lower-cased, repeats included."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    x = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if len(w) < words:
        return np.array([x(joined, SEED)], np.uint64)
    ends = list(accumulate(len(v) + 1 for v in w))
    starts = [0, *ends]
    return np.array([x(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(0, dtype=np.uint32 if len(bits) > 65535 else np.uint16).astype(np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long, one row per input row."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy of shared bit patterns over fingerprints sorted by Gray rank."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pats, agree = [codes[self.order]], [np.full(len(codes), EVERY)]
        while len(pats[-1]) > FAN:
            at = np.arange(0, len(pats[-1]), FAN)
            first = np.repeat(pats[-1][at], FAN)[: len(pats[-1])]
            apart = np.bitwise_or.reduceat((pats[-1] ^ first) | ~agree[-1], at)
            agree.append(~apart)
            pats.append(pats[-1][at] & ~apart)
        #: From the top: patterns, and the bits that the node above does not share.
        self.levels = []
        for k in range(len(pats) - 1, -1, -1):
            above = np.repeat(agree[k + 1], FAN)[: len(pats[k])] if k + 1 < len(pats) else np.uint64(0)
            self.levels.append((pats[k], agree[k] & ~above))

    def within(self, queries: np.ndarray, bound: int):
        """Yields ``(query positions, code positions)`` of all pairs up to ``bound`` bits apart."""
        step = max(1, FRONTIER // max(1, len(self.order)))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            top = len(self.levels[0][0])
            who = np.repeat(np.arange(len(q)), top)
            node = np.tile(np.arange(top), len(q))
            cost = np.zeros(len(who), np.uint8)
            for depth, (pat, own) in enumerate(self.levels):
                if depth:
                    who = np.repeat(who, FAN)
                    cost = np.repeat(cost, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(pat)
                    if not real.all():
                        who, cost, node = who[real], cost[real], node[real]
                cost = cost + np.bitwise_count((q[who] ^ pat[node]) & own[node])
                keep = cost <= bound
                who, cost, node = who[keep], cost[keep], node[keep]
            yield who + at, self.order[node]


def link_tile(codes: np.ndarray, lower: np.ndarray, same: bool, bound: int) -> np.ndarray:
    """Labels of a tile's codes: members of the first chunk query the index of the second."""
    labels, every = np.arange(len(codes)), np.arange(len(codes))
    left = np.flatnonzero(lower) if not same else every
    right = np.flatnonzero(~lower) if not same else every
    index = GrayIndex(codes[right])
    for a, b in index.within(codes[left], bound):
        labels = merge_labels(labels, left[a], right[b])
    return labels


def block_count(n: int, bits: int) -> int:
    """Blocks to cut 64 bits into, so that ``n`` spread fingerprints put at most ``TILE`` into a key; at most ``bits`` + 4."""
    for blocks in range(bits + 1, bits + 4):
        if n >> (64 * (blocks - bits) // blocks) <= TILE:
            return blocks
    return bits + 4


def keys_of(fp: str, bits: int, blocks: int) -> list[Column]:
    """A key for every choice of ``blocks - bits`` blocks: the blocks' bits, told apart by the choice."""
    cuts = [round(k * 64 / blocks) for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - bits)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, cuts[k + 1] - cuts[k]).bitwiseOR(part[k])
        out.append(key)
    return out


def links(reps: DataFrame, bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Spanning links ``(a, b)`` between the ``rep`` of distinct ``fp`` within ``bits`` bits."""
    blocks = blocks or block_count(reps.count(), bits)
    dealt = tiled(reps.withColumn("block", F.explode(F.array(*keys_of("fp", bits, blocks)))), "block", "fp", TILE)
    keys = ["block", "_lo", "_hi"]

    def run(batches):
        for t in by_group(batches, keys):
            codes = t.column("fp").to_numpy().view(np.uint64)
            reps = t.column("rep").to_numpy()
            lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
            lower = t.column("_mine").to_numpy() == lo
            labels = link_tile(codes, lower, lo == hi, bits)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(reps[linked]), pa.array(reps[labels[linked]])], ["a", "b"])

    return grouped(dealt.select(*keys, "_mine", "fp", "rep"), keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest
    doc_id reachable by links of at most ``bits`` differing bits. Null and
    blank texts have fingerprint zero and link like any other; texts shorter
    than a shingle are one shingle. Rows with equal ids keep a row each; a null
    doc_id takes the component of its fingerprint, or null if no row there has
    an id. An empty table gives an empty result.
    """
    prints, _ = materialize(fingerprints(docs, words), "simhash")
    reps, _ = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    found = connected_components(links(reps.where("rep is not null"), bits))
    classes = reps.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", text.alias("fingerprint"), "component_id")


#: Bands of a MinHash signature and minima in a band: one agrees at 0.8 with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.99993.
BANDS, DEEP = 24, 5
#: Sets of a tile of exact comparisons; shingles whose minima are taken at once.
SETS, STRETCH = 2048, 4096
_FACTORS = mixed(np.arange(1, BANDS * DEEP + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of hashes, each of ``DEEP`` minima under orders of their own."""
    low = np.full(BANDS * DEEP, EVERY)
    for at in range(0, len(shingles), STRETCH):
        low = np.minimum(low, np.multiply.outer(_FACTORS, shingles[at : at + STRETCH]).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, DEEP).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key


def link_sets(flat: np.ndarray, size: np.ndarray, lower: np.ndarray, same: bool, similarity: float) -> np.ndarray:
    """Labels of a tile's sets, linked where their exact Jaccard share is at least ``similarity``.

    ``flat`` holds the sets one after the other. They are taken by size, each
    against the larger ones whose size allows the similarity.
    """
    n, order = len(size), np.argsort(size, kind="stable")
    old, size, lower = (np.cumsum(size) - size)[order], size[order], lower[order]
    starts = np.append(0, np.cumsum(size))
    words, flat = np.unique(flat[np.repeat(old - starts[:-1], size) + np.arange(starts[-1])], return_inverse=True)
    ends = np.searchsorted(size, size / similarity * (1 + 1e-9), "right")
    labels, mine = np.arange(n), np.zeros(len(words), np.uint8)
    for k in range(n - 1):
        end = ends[k]
        open_ = labels[k + 1 : end] != labels[k]
        if not same:
            open_ &= lower[k + 1 : end] != lower[k]
        if not open_.any():
            continue
        own = flat[starts[k] : starts[k + 1]]
        mine[own] = 1
        both = np.add.reduceat(mine[flat[starts[k + 1] : starts[end]]], starts[k + 1 : end] - starts[k + 1], dtype=np.int64)
        mine[own] = 0
        near = k + 1 + np.flatnonzero(open_ & (both / (size[k] + size[k + 1 : end] - both) >= similarity))
        labels = merge_labels(labels, np.full(len(near), k), near)
    out = np.empty(n, np.int64)
    out[order] = order[labels]
    return out


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    key = xxhash.xxh3_128_intdigest(shingles.tobytes(), SEED)
    return key >> 64, key & 0xFFFFFFFFFFFFFFFF


def candidates(sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose classes hold together nearly all similar sets, and others.

    ``sets`` has ``(node, fp, bands)``. By SimHash, sets of equal fingerprints
    and of ones that the Gray-order index finds; by MinHash, sets that share a
    band, linked to the band's smallest. Tasks emit spanning forests.
    """
    prints, _ = materialize(sets.groupBy("fp").agg(F.min("node").alias("rep")), "simhash-prints")
    equal = sets.select("fp", "node").join(prints, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    banded = sets.select("node", F.explode("bands").alias("band"))
    low = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("_top")).where("b < _top").drop("_top")
    # The second key has both sides exchanged, so that the rows of a hot band can be split.
    half = F.shiftright("band", 1)
    shared = banded.withColumn("k", half).join(low.withColumn("k", half), ["band", "k"]).where("node <> b").select(F.col("node").alias("a"), "b")
    return links(prints).unionByName(equal).unionByName(shared)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by id and text: ``_void``, ``_id`` and ``_tag`` are never null, and ``_row`` holds every column."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").isNull().alias("_void"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("text").alias("_tag"))


_KEY = ["_void", "_id", "_tag"]


def _first_rows(rows: DataFrame) -> DataFrame:
    """One of the rows that repeat both id and text."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*_KEY).orderBy(*_KEY))).where("_n = 1").drop("_n")


def verified(docs: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Spanning links ``(a, b)`` of the pairs inside a class whose shingle sets are similar enough, compared exactly.

    ``classes`` has ``(node, component)`` of every set with a candidate, and
    the ``head`` row whose text it is.
    """

    def sets(batches):
        for batch in batches:
            # A few texts at a time: their sets are as large as the texts.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique(shingle_hashes(t, words)) for t in part.column(2).to_pylist()]
                ends = pa.array(np.append(0, np.cumsum([len(s) for s in found])), pa.int32())
                flat = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, flat)], ["component", "node", "shingles"])

    heads = classes.select("component", "node", F.col("head.void").alias("_void"), F.coalesce("head.doc_id", F.lit(0)).alias("_id"), F.col("head.tag").alias("_tag"))
    texts = _first_rows(_keyed(docs.select("doc_id", "text")).join(heads, _KEY)).select("component", "node", F.col("_row.text").alias("text"))
    held, _ = materialize(texts.mapInArrow(sets, "component long, node long, shingles array<long>"), "simhash-sets")
    keys = ["component", "_lo", "_hi"]

    def run(batches):
        for t in by_group(batches, keys):
            lists, nodes = t.column("shingles").combine_chunks(), t.column("node").to_numpy()
            lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
            lower = t.column("_mine").to_numpy() == lo
            size = lists.value_lengths().to_numpy().astype(np.int64)
            labels = link_sets(lists.flatten().to_numpy(), size, lower, lo == hi, similarity)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[labels[linked]])], ["a", "b"])

    dealt = tiled(held, "component", "node", SETS)
    return grouped(dealt.select(*keys, "_mine", "node", "shingles"), keys).mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, k0, k1, fp)``, and their sets ``(k0, k1, head, component)``; ``head`` is a set's first row."""

    def prints(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in batch.column(2).to_pylist()]
            key = np.array([_set_key(s) for s in found], np.uint64).reshape(-1, 2).view(np.int64)
            fp = np.array([fingerprint(s) for s in found], np.uint64).view(np.int64)
            size = pa.array([len(s) for s in found], pa.int64())
            band = np.array([bands(s) for s in found], np.uint64).reshape(-1).view(np.int64)
            band = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(band))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, key.T.copy()), pa.array(fp), size, band], ["doc_id", "tag", "k0", "k1", "fp", "size", "bands"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    rows, _ = materialize(texts.mapInArrow(prints, "doc_id long, tag long, k0 long, k1 long, fp long, size long, bands array<long>"), "simhash")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "tag")).alias("head")
    # Rows of equal keys are of equal sets, and their other columns agree. Sets are numbered as they are written.
    sets = rows.groupBy("k0", "k1").agg(head, F.min(F.struct("fp", "size", "bands")).alias("of")).select("k0", "k1", "head", "of.*")
    sets, _ = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "simhash-reps")
    near = connected_components(candidates(sets.where("size > 0")))
    closer, _ = materialize(sets.join(near, "node").select("node", "head", "component"), "simhash-near")
    found = connected_components(verified(docs, closer, words, similarity))
    sets = sets.join(found, "node", "left").select("k0", "k1", "head", F.coalesce("component", "node").alias("component"))
    return rows, sets


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: classes of texts of at least that similarity.

    Similarity is the exact Jaccard share of shingle sets: pairs below it never
    link. ``candidates`` gathers sets into classes, and all pairs inside one
    are compared; a pair at the bound escapes it with a chance of about 1 in
    13,000, a closer one less. Equal sets are collapsed first. Nulls, short
    texts and repeated rows as in ``near_duplicates``, except that blank texts
    are only similar to each other and rows of one id but other texts are
    documents of their own. ``fingerprint`` is of the set.
    """
    rows, sets = _classes(docs, words, similarity)
    first = sets.groupBy("component").agg(F.min("head").alias("first"))
    named = sets.join(first, "component").select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), F.col("first.doc_id").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, (F.col("k0") == F.col("_k0")) & (F.col("k1") == F.col("_k1"))).select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, one of each class of ``similar``: the one of the smallest id.

    Rows without an id come after those that have one, rows of equal id are in
    order of a hash of their text, and of rows that repeat both one stays. Null
    and blank texts are one class. An empty table stays empty.
    """
    _, sets = _classes(docs, words, similarity)
    kept = sets.groupBy("component").agg(F.min("head").alias("head"))
    kept = kept.select(F.col("head.void").alias("_void"), F.coalesce("head.doc_id", F.lit(0)).alias("_id"), F.col("head.tag").alias("_tag"))
    rows = _first_rows(_keyed(docs).join(kept, _KEY))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, bits=4)
