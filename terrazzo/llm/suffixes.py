"""Repeated byte strings by blockwise suffix sorting with a difference cover.

Remove every byte that lies in a ``window``-byte string which also starts
somewhere else, in the same or another text. Candidate suffixes come in
buckets of equal anchors (see ``repeats``); a block of whole buckets is sorted
at a time. Suffixes are sorted by their first ``COVER`` bytes. Ties are
resolved by ranks computed beforehand for the block's cover sample, the places
whose residue modulo ``COVER`` is in ``RESIDUES``: for any two residues there is
a shift below ``COVER`` that takes both suffixes to the sample, where two ranks
say how the suffixes go on. A block needs memory for its sample's ranks and a
few numbers per suffix, never for the suffixes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession

from terrazzo.llm import anchors, repeats

WINDOW, GRAM = 400, 100
COVER = 31
#: A perfect difference set modulo 31: every difference occurs once.
RESIDUES = (0, 1, 3, 8, 12, 18)
#: For two residues, the shift that takes places of both into the set.
SHIFT = np.array([[next(s for s in range(COVER) if (a + s) % COVER in RESIDUES and (b + s) % COVER in RESIDUES) for b in range(COVER)] for a in range(COVER)])
#: Suffixes sorted at a time.
BATCH = 1 << 16


def byte_tokens(text: str) -> tuple[np.ndarray, bytes]:
    raw = text.encode()
    return anchors.BYTE_VALUES[np.frombuffer(raw, np.uint8)], raw


def _cut(raw: bytes):
    return lambda x, y: raw[x:y]


def _gram_ranks(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the ``size`` bytes at every place."""
    rows = np.ascontiguousarray(sliding_window_view(text, size)[places])
    return np.unique(rows.view(f"V{size}").ravel(), return_inverse=True)[1]


def _pair_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.unique(first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def window_ranks(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first ``window`` bytes: equal where those are.

    ``text`` holds at least ``window`` bytes from every start.
    """
    if window < 2 * COVER:
        return _gram_ranks(text, starts, window)
    blocks = (window - COVER + 1) // COVER
    # One ranking of all strings of COVER bytes that are needed: heads, tails and the sample's.
    sample = np.flatnonzero(np.isin(np.arange(len(text) - COVER + 1) % COVER, RESIDUES))
    tails = [starts + window - 2 * COVER, starts + window - COVER]
    grams = _gram_ranks(text, np.concatenate([starts, *tails, sample]), COVER)
    head, *tails, rank = np.split(grams, np.cumsum([len(starts)] * 3))
    # Doubling: places a multiple of COVER apart are in the sample together.
    at = np.full(len(text) + blocks * COVER + 1, -1)
    at[sample] = np.arange(len(sample))
    size = 1
    while size < blocks:
        step = min(size, blocks - size)
        ahead = at[sample + step * COVER]
        rank = _pair_ranks(rank, np.where(ahead >= 0, rank[ahead] + 1, 0))
        size += step
    cover = np.full(len(text) + blocks * COVER + 1, -1)
    cover[sample] = rank
    return _resolve_ties(head, starts, cover, tails)


def _resolve_ties(head: np.ndarray, starts: np.ndarray, cover: np.ndarray, tails: list[np.ndarray]) -> np.ndarray:
    """Suffix ranks: all groups of equal heads are partitioned at once, each around a suffix of its own.

    Two suffixes compare by the cover ranks at their common shift, then by
    their tails; what equals the pivot is done, the rest go on.
    """
    order = np.argsort(head, kind="stable")
    sizes = np.bincount(head)
    rank = (np.cumsum(sizes) - sizes)[head]
    open_ = order[sizes[head[order]] > 1]
    residue = starts % COVER
    while len(open_):
        # ``open_`` is in order of rank; a group is a run of equal ranks.
        group = rank[open_]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(open_)))
        pivot = np.repeat(open_[first + size // 2], size)
        shift = SHIFT[residue[open_], residue[pivot]]
        sign = np.sign(cover[starts[open_] + shift] - cover[starts[pivot] + shift])
        for tail in tails:
            sign = np.where(sign == 0, np.sign(tail[open_] - tail[pivot]), sign)
        again = np.lexsort((sign, group))
        open_, group, sign = open_[again], group[again], sign[again]
        part = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (sign[1:] != sign[:-1])]))
        length = np.diff(np.append(part, len(open_)))
        # The rank of a part is where it starts.
        rank[open_] = np.repeat(group[part] + part - np.repeat(first, size)[part], length)
        open_ = open_[(sign != 0) & (np.repeat(length, length) > 1)]
    return rank


def repeated(regions: list[tuple[bytes, int, bool]], window: int) -> list[np.ndarray]:
    """For regions ``(payload, windows, many)``: starts of repeated windows."""
    sizes = [len(r[0]) for r in regions]
    text = np.frombuffer(b"".join(r[0] for r in regions), np.uint8)
    counts = np.array([r[1] for r in regions])
    places = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(p, p + n) for p, n in zip(places, counts)])
    rank = window_ranks(text, starts, window)
    weight = np.repeat([2 if r[2] else 1 for r in regions], counts)
    often = (np.bincount(rank, weights=weight) > 1)[rank]
    return [np.flatnonzero(x) for x in np.split(often, np.cumsum(counts)[:-1])]


def _resolver(window: int):
    def resolve(batches):
        held, last, size, seen = [], None, 0, None

        def flush():
            out = []
            for (doc, tag, place, _), starts in zip(held, repeated([h[3] for h in held], window)):
                out += [(doc, tag, place + a, place + b) for a, b in repeats.runs(starts, window)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, ["doc_id", "tag", "a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "tag", "place", "extent", "many", "payload")]
            for anchor, doc, tag, place, extent, many, payload in zip(*cols):
                if seen == (seen := (anchor, doc, tag, place)):
                    continue
                if anchor != last and size >= BATCH:
                    yield flush()
                    held, size = [], 0
                last = anchor
                count = repeats.extents(extent)[0]
                held.append((doc, tag, place, (payload, count, many)))
                size += count
        if held:
            yield flush()

    return resolve


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _apply(rows: DataFrame, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            size, gone, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                b = (text or "").encode()
                ranges = repeats.merged(found)
                at, left = 0, []
                for x, y in ranges:
                    left.append(b[at:x])
                    at = y
                left.append(b[at:])
                rest = b"".join(left)
                size.append(len(b))
                gone.append(len(b) - len(rest))
                spans.append(len(ranges))
                kept.append(hashlib.sha256(rest).hexdigest().encode() if digest else rest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, SCHEMA)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: texts without repeated byte strings.

    All copies go, the first included. Spans are maximal runs of removed
    bytes; what is left may not be valid UTF-8, so ``kept`` is binary, or the
    SHA-256 of it in hex if ``digest``. Null, empty and shorter texts lose
    nothing. Rows that repeat both id and text count as copies of each other;
    a null doc_id is kept as it is; empty tables give empty results; other
    columns are not read.
    """
    rows = repeats.keyed(docs)
    spans = repeats.covered(rows, byte_tokens, _cut, _resolver(window), window, min(GRAM, window), keep_first=False)
    return _apply(repeats.with_ranges(rows, spans), digest)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.withColumn("kept", out["kept"].cast("string")).withColumnRenamed("kept", "kept_sha256")
