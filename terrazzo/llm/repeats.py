"""Exact repeated windows across all documents, without a row per window.

Stages shared by the byte and the word operator:

1. every text gives its anchored regions (see ``anchors``), equal ones of one
   text as one row, so that a text that repeats a line thousands of times does
   not make a hot key; anchors that occur once are dropped after a pre-aggregated count;
2. regions of equal anchor and content are copies: one row stays for each
   content, the others are settled at once;
3. anchors that still have several contents are resolved by the operator's own
   method over the token sequences of those few regions, one anchor at a time;
4. an anchor with more than ``LIMIT`` contents is too much for a task: its
   regions are cut into blocks of windows that start alike far before the
   anchor, keyed by the tokens that all windows of a block hold, which equal
   windows share. Blocks go through 2 and 3 like regions; ever smaller ones as
   ``BLOCKS`` says, and windows of keys that are still too much, or of regions
   too short for blocks, become rows of their own, hashed to 128 bits and
   pre-aggregated;
5. covered ranges go back to their documents, whose texts are exchanged once.

Rows of a document are keyed by ``doc_id`` and a hash of its text, so rows that
repeat an id stay apart, rows that repeat a text under the same id are one
document, and a null id is an id like any other (ordered first).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.anchors import regions
from terrazzo.storage import materialize

KEYS = ("doc_id", "tag")
RANGES = "doc_id long, tag long, a long, b long"
#: Regions with their tokens.
BARE = "anchor long, doc_id long, tag long, place long, extent long, many boolean, payload binary"
#: Contents of one anchor that one task resolves.
LIMIT = 1024
#: Windows of a block, for anchors with more contents and for blocks of that size in turn.
BLOCKS = (32, 4)
_BITS = 20


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


def same_doc(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & left["tag"].eqNullSafe(right["tag"])


def _again(anchor: np.ndarray, content: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, dict[int, list]]:
    """Positions of the first of equal regions, in order, and the ranges that the others of each cover, merged."""
    _, first, which = np.unique(anchor * np.uint64(3) + content, return_index=True, return_inverse=True)
    if len(first) == len(lo):
        return np.arange(len(lo)), {}
    more: dict[int, list] = {}
    for k in np.flatnonzero(first[which] != np.arange(len(lo))).tolist():
        ranges = more.setdefault(int(first[which[k]]), [])
        a, b = int(lo[k]), int(lo[k] + width[k])
        if ranges and a <= ranges[-1]["b"]:
            ranges[-1]["b"] = max(b, ranges[-1]["b"])
        else:
            ranges.append({"a": a, "b": b})
    return np.sort(first), more


def all_regions(docs: DataFrame, tokens: Callable[[str], tuple[np.ndarray, bytes]], window: int, gram: int) -> DataFrame:
    """``(anchor, content, doc_id, tag, place, extent, more)``, one row for equal regions of a text.

    ``extent`` packs count and offset of the first of them; ``more`` holds the
    ranges of tokens that the others cover.
    """
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in batches:
            parts, rows, again = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                r = regions(*tokens(text), window, gram) if text else None
                if r is not None and len(r.lo):
                    first, more = _again(r.anchor, r.content, r.lo, r.count + window - 1)
                    parts.append((r.anchor[first], r.content[first], r.lo[first], (r.count << _BITS | r.offset)[first]))
                    again += [more.get(x) for x in first.tolist()] if more else [None] * len(first)
                    rows.append((k, len(first)))
            if not parts:
                continue
            which = np.repeat([k for k, _ in rows], [n for _, n in rows])
            anchor, content, lo, extent = (np.concatenate(c) for c in zip(*parts))
            index = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(index), batch.column("tag").take(index), pa.array(lo), pa.array(extent), pa.array(again, kind)],
                ["anchor", "content", "doc_id", "tag", "place", "extent", "more"],
            )

    return docs.mapInArrow(run, "anchor long, content long, doc_id long, tag long, place long, extent long, more array<struct<a:long,b:long>>")


def divided(regions: DataFrame, cut: Callable[[bytes], Callable[[int, int], bytes]], window: int, gram: int, size: int) -> DataFrame:
    """``regions``, rows of ``BARE``, in blocks of at most ``size`` windows, with ``content``, keyed anew.

    A window that starts k tokens before its anchor is in block k div ``size``;
    a key hashes what any window of that block holds in common.
    """

    def run(batches):
        x = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, contents, rows = [], [], []
            for doc, tag, place, extent, many, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "place", "extent", "many", "payload"))):
                take, (count, offset) = cut(payload), extents(extent)
                for block in range((offset - count + 1) // size, offset // size + 1):
                    least, most = block * size, min(block * size + size - 1, window - gram)
                    far = min(offset, most)
                    at, n = offset - far, far - max(offset - count + 1, least) + 1
                    tokens = take(at, at + n + window - 1)
                    keys.append(x(take(offset - least, offset - most + window), seed=block))
                    contents.append(x(tokens))
                    rows.append((doc, tag, place + at, n << _BITS | far, many, tokens))
            cols = list(zip(*rows)) or [()] * 6
            hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (keys, contents)]
            kinds = (*[pa.int64()] * 4, pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([*hashes, *map(pa.array, cols, kinds)], ["anchor", "content", "doc_id", "tag", "place", "extent", "many", "payload"])

    return regions.mapInArrow(run, BARE.replace("anchor long", "anchor long, content long"))


def _by_content(found: DataFrame, window: int, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranges that regions of equal anchor and content settle; one row for each content of anchors with several, and those anchors."""
    rest = [c for c in found.columns if c not in ("anchor", "content", "many", "more")]
    first = F.min(F.struct(*rest)).alias("first")
    classes, _ = materialize(found.groupBy("anchor", "content").agg(first, ((F.count("*") > 1) | F.max("many")).alias("many")), "classes")
    reach = F.col("place") + F.shiftright("extent", _BITS) + F.lit(window - 1)
    copies = classes.where("many").select("anchor", "content", *([F.col("first")] if keep_first else []))
    settled = found.drop("many").join(copies, ["anchor", "content"])
    if keep_first:
        settled = settled.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("tag").eqNullSafe(F.col("first.tag")) & (F.col("place") == F.col("first.place"))))
    settled = settled.select("doc_id", "tag", F.col("place").alias("a"), reach.alias("b"))
    several, _ = materialize(classes.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1"), "several")
    return settled, classes.join(several, "anchor").select("anchor", "many", "contents", "first.*"), several


def covered(
    docs: DataFrame,
    tokens: Callable[[str], tuple[np.ndarray, bytes]],
    cut: Callable[[bytes], Callable[[int, int], bytes]],
    resolve: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    window: int,
    gram: int,
    keep_first: bool,
) -> DataFrame:
    """Ranges ``(doc_id, tag, a, b)`` of tokens to remove, one or more per document.

    ``tokens(text)`` gives hashes of the tokens and the tokens as bytes;
    ``cut(raw)(a, b)`` the payload of tokens a to b of a text or a payload; ``resolve`` gets
    regions sorted by ``anchor, doc_id, tag, place`` with ``many`` (whether
    another region has the same content) and emits ranges; it passes over a
    region that repeats the one before (a row given twice). ``keep_first``: the
    first of equal windows stays, else all go.
    """
    anchors = all_regions(docs, tokens, window, gram)
    # Written, so that both sides of a join are dealt afresh and a hot anchor can be split.
    inside = F.col("more").isNotNull()
    again, _ = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.max(inside).alias("inside")).where("n > 1 or inside").select("anchor"), "anchors")
    found, _ = materialize(anchors.join(again, "anchor", "left_semi").withColumn("many", inside), "regions")
    settled, still, several = _by_content(found, window, keep_first)
    # Later regions of a text that equal an earlier one of its own go in any case.
    out = settled.unionByName(found.where(inside).select("doc_id", "tag", F.explode("more").alias("_r")).select("doc_id", "tag", "_r.a", "_r.b"))
    few, hot = f"contents <= {LIMIT}", f"contents > {LIMIT}"

    def asked(which: str) -> DataFrame:
        """The regions asked of each text."""
        asks = still.where(which).groupBy(*KEYS).agg(F.collect_list(F.struct("anchor", "many", "place", "extent")).alias("asked"))
        return asks.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), "asked")

    def payloads(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                take = cut(batch.column("text")[k].as_py().encode())
                asks = batch.column("asked")[k].as_py()
                n = len(asks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["anchor"] for x in asks], pa.int64()),
                        pa.array([batch.column("doc_id")[k].as_py()] * n, pa.int64()),
                        pa.array([batch.column("tag")[k].as_py()] * n, pa.int64()),
                        pa.array([x["place"] for x in asks], pa.int64()),
                        pa.array([x["extent"] for x in asks], pa.int64()),
                        pa.array([x["many"] for x in asks], pa.bool_()),
                        pa.array([take(x["place"], x["place"] + (x["extent"] >> _BITS) + window - 1) for x in asks], pa.binary()),
                    ],
                    ["anchor", "doc_id", "tag", "place", "extent", "many", "payload"],
                )

    def read(asks: DataFrame) -> DataFrame:
        return docs.join(asks, docs["doc_id"].eqNullSafe(asks["_d"]) & docs["tag"].eqNullSafe(asks["_t"])).select("doc_id", "tag", "text", "asked").mapInArrow(payloads, BARE)

    def windows(batches):
        for batch in batches:
            digests, rows = [], []
            for doc, tag, place, extent, many, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "place", "extent", "many", "payload"))):
                take = cut(payload)
                for at in range(extent >> _BITS):
                    digests.append(xxhash.xxh3_128_digest(take(at, at + window)))
                    rows.append((doc, tag, place + at, many))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kinds = (*[pa.int64()] * 3, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *map(pa.array, list(zip(*rows)) or [()] * 4, kinds)], ["h1", "h2", "doc_id", "tag", "place", "many"])

    bare = read(asked(few))
    names = bare.columns
    if not several.where(hot).isEmpty():
        # Blocks of a few windows would save little: without them windows stay in one plan, which exchanges texts once.
        sizes = [b for b in BLOCKS if 4 * b <= window - gram + 1]
        # Asks are written: where they are small, their size shows, and no texts are exchanged for them.
        left = read(materialize(asked(hot), "asks")[0] if sizes else asked(hot))
        for size in sizes:
            blocks, _ = materialize(divided(left, cut, window, gram, size), "blocks")
            again, _ = materialize(blocks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
            found, _ = materialize(blocks.join(again, "anchor", "left_semi"), "regions")
            settled, still, several = _by_content(found, window, keep_first)
            out, bare = out.unionByName(settled), bare.unionByName(still.where(few).select(names))
            left = still.where(hot).select(names)
            if several.where(hot).isEmpty():
                break
        else:
            each = left.mapInArrow(windows, "h1 long, h2 long, doc_id long, tag long, place long, many boolean")
            if sizes:
                each, _ = materialize(each, "windows")
            spot = F.struct("doc_id", "tag", "place")
            # The third key says nothing new, but makes both sides of the join be dealt afresh: a hot window can be split.
            often = each.groupBy("h1", "h2").agg(F.min(spot).alias("least"), F.max(spot).alias("most"), F.max("many").alias("copied"))
            often = often.where("copied or least <> most").withColumn("k", F.shiftright("h1", 1)).select("h1", "h2", "k", "least")
            all_hot = each.withColumn("k", F.shiftright("h1", 1)).join(often, ["h1", "h2", "k"])
            if keep_first:
                all_hot = all_hot.where(~spot.eqNullSafe(F.col("least")))
            out = out.unionByName(all_hot.select("doc_id", "tag", F.col("place").alias("a"), (F.col("place") + F.lit(window)).alias("b")))
    # Regions and blocks of all sizes are dealt together.
    return out.unionByName(bare.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "tag", "place").mapInArrow(resolve, RANGES))


def extents(extent: int) -> tuple[int, int]:
    """Number of windows, and offset of the anchor in the first."""
    return extent >> _BITS, extent & ((1 << _BITS) - 1)


def by_document(ranges: DataFrame) -> DataFrame:
    """``(_d, _t, ranges)``: the ranges of each document as one list."""
    return ranges.groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b")).alias("ranges")).select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), "ranges")


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents with the list of their ranges, null where they have none."""
    per = by_document(ranges)
    return docs.join(per, docs["doc_id"].eqNullSafe(per["_d"]) & docs["tag"].eqNullSafe(per["_t"]), "left").select("doc_id", "text", "ranges")


def merged(ranges: list[dict] | None) -> list[list[int]]:
    """Disjoint, sorted, maximal ranges."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges that windows at sorted ``starts`` cover, one per run of neighbours."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[[0, *(cuts + 1)]].tolist(), (starts[[*cuts, -1]] + window).tolist()))
