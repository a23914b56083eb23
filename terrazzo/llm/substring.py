"""Repeated word passages, found with suffix automata.

A window is ``window`` consecutive words. Documents are streamed against
suffix automata of reference shards: the matching statistics of a text (the
longest suffix, at each word, that the reference holds) show every span at or
above the window length.

``remove_against`` writes the automata of a reference table, each of a bounded
number of words, and broadcasts as many at a time as ``BROADCAST`` bytes hold.
``remove_repeats`` takes the corpus itself as reference. That has no size bound
to broadcast, so its shards are keyed: all regions that share an anchor are one
shard, streamed in document order through an automaton that grows by what it
has already seen (see ``repeats``), so each match is one that starts earlier.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import repeats
from terrazzo.llm.tiles import by_group
from terrazzo.storage import discard, materialize

WINDOW, GRAM = 20, 6
#: Words of a broadcast shard: its automaton has at most twice as many states.
SHARD = 50_000
#: Bytes of automata that are broadcast at once.
BROADCAST = 64 << 20


class Automaton:
    """Suffix automaton of word sequences, extended online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def _extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        new, at = len(nxt), self.last
        nxt.append({})
        length.append(length[at] + 1)
        link.append(0)
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            to = nxt[at][word]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and nxt[at].get(word) == to:
                    nxt[at][word] = copy
                    at = link[at]
                link[to] = link[new] = copy
        self.last = new

    def add(self, words: Iterable[bytes]) -> None:
        """Take in a sequence; a separator that equals no word keeps sequences apart."""
        for w in words:
            self._extend(w)
        self._extend(len(self.next))

    def window_starts(self, words: list[bytes], window: int) -> np.ndarray:
        """Starts of windows of ``words`` that a sequence taken in holds."""
        nxt, link, length, state, run, out = self.next, self.link, self.length, 0, 0, []
        for k, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            if w in nxt[state]:
                state, run = nxt[state][w], run + 1
            if run >= window:
                out.append(k - window + 1)
        return np.array(out, np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_tokens(text: str) -> tuple[np.ndarray, bytes]:
    x = xxhash.xxh3_64_intdigest
    hashes = np.array([x(w) for w in words_of(text)], np.uint64)
    return hashes, hashes.tobytes()


def _cut(raw: bytes):
    w = raw.split()
    return lambda a, b: b" ".join(w[a:b])


def _resolver(window: int):
    def resolve(batches):
        last, automaton, seen = None, Automaton(), None
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "tag", "place", "payload")]
            for anchor, doc, tag, place, payload in zip(*cols):
                if seen == (seen := (anchor, doc, tag, place)):
                    continue
                if anchor != last:
                    last, automaton = anchor, Automaton()
                words = payload.split()
                starts = automaton.window_starts(words, window)
                out += [(doc, tag, place + a, place + b) for a, b in repeats.runs(starts, window)]
                if len(starts) < len(words) - window + 1:
                    automaton.add(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "tag", "a", "b"])

    return resolve


SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def _apply(rows: DataFrame, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = words_of(text)
                total.append(len(words))
                at, left = 0, []
                for a, b in repeats.merged(spans):
                    left += words[at:a]
                    at = b
                left += words[at:]
                gone.append(len(words) - len(left))
                joined = b" ".join(left)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, SCHEMA)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: texts without words that repeat an earlier window.

    A word goes if a window over it also starts earlier, in a smaller doc_id
    or before it in the same text. ``kept`` is the rest joined by one space, or
    its SHA-256 if ``digest``. Null, empty and shorter texts lose nothing; a
    null doc_id orders first; rows that repeat id and text are one document and
    give equal results, rows that repeat only the id order by a hash of their
    text. Empty tables give empty results; other columns are not read.
    """
    rows = repeats.keyed(docs)
    spans = repeats.covered(rows, word_tokens, _cut, _resolver(window), window, min(GRAM, window), keep_first=True)
    return _apply(repeats.with_ranges(rows, spans), digest)


def _short(words: list[bytes]) -> list[bytes]:
    """Words of 16 bytes or more by their 128-bit hash, so that an automaton's size follows from its words."""
    return [w if len(w) < 16 else xxhash.xxh3_128_digest(w) for w in words]


def automata(reference: DataFrame, window: int) -> tuple[DataFrame, str]:
    """Written ``(shard, automaton)`` of ``reference``'s texts, and the path.

    Texts are cut into pieces that overlap by a window less one word; equal
    pieces are one, and pieces are dealt by hash to shards of about ``SHARD`` words.
    """

    def cut(batches):
        for batch in batches:
            pieces = []
            for text in batch.column(0).to_pylist():
                w = words_of(text)
                pieces += [w[a : a + SHARD // 2 + window - 1] for a in range(0, len(w) - window + 1, SHARD // 2)]
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(p) for p in pieces], pa.binary()), pa.array(list(map(len, pieces)), pa.int64())], ["piece", "n"])

    def build(batches):
        for group in by_group(batches, ["shard"], few=1):
            automaton = Automaton()
            for piece in group.column("piece").to_pylist():
                automaton.add(_short(piece.split()))
            yield pa.RecordBatch.from_arrays([group.column("shard").combine_chunks().slice(0, 1), pa.array([pickle.dumps(automaton, 5)], pa.binary())], ["shard", "automaton"])

    pieces, path = materialize(reference.select("text").mapInArrow(cut, "piece binary, n long").dropDuplicates(["piece"]), "pieces")
    words = pieces.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(words / SHARD))
    dealt = pieces.select(F.pmod(F.xxhash64("piece"), F.lit(shards)).cast("long").alias("shard"), "piece")
    built, built_path = materialize(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, automaton binary"), "automata")
    discard(reference.sparkSession, path)
    return built, built_path


def remove_against(docs: DataFrame, reference: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """As ``remove_repeats``, for windows that a ``text`` of ``reference`` holds.

    Every round broadcasts serialised automata of at most ``BROADCAST`` bytes,
    or one if that is larger, streams all documents against them and writes
    what it found. Null reference texts are passed over; with an empty
    reference nothing is removed.
    """
    spark = docs.sparkSession
    rows = repeats.keyed(docs)
    built, path = automata(reference, window)
    rounds, size = [], BROADCAST
    for r in built.select("shard", F.length("automaton").alias("n")).orderBy("shard").collect():
        if size + r.n > BROADCAST:
            rounds.append([])
            size = 0
        rounds[-1].append(r.shard)
        size += r.n
    spans = spark.createDataFrame([], repeats.RANGES)
    for members in rounds:
        held = built.where(F.col("shard").isin(members)).select("automaton").collect()
        shared = spark.sparkContext.broadcast([bytes(r.automaton) for r in held])

        def run(batches, shared=shared):
            known = [pickle.loads(blob) for blob in shared.value]
            for batch in batches:
                out = []
                for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text"))):
                    words = _short(words_of(text))
                    out += [(doc, tag, a, b) for k in known for a, b in repeats.runs(k.window_starts(words, window), window)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "tag", "a", "b"])

        spans = spans.unionByName(materialize(rows.mapInArrow(run, repeats.RANGES), "matches")[0])
        shared.destroy()
    discard(spark, path)
    return _apply(repeats.with_ranges(rows, spans), digest)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")
