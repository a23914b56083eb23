"""SentencePiece BPE encoding with source offsets, and decoding.

``Model`` reads a compiled ``.model`` file. Text is normalised by longest
prefix through the model's compiled character map (a double-array trie),
recording for every normalised character the source bytes it came from; byte
pair merges then run inside chunks that no piece can cross, and each piece is
projected back to the span of original bytes it covers. Where every character
stays one, texts are encoded many at a time: cut wherever no piece holds two
neighbours, and the parts not remembered merged together, a merge of each a
round.

The model file is small and fixed, so it is shipped to executors by value.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts of texts whose pieces a worker remembers between texts.
CACHE = 60_000
#: Characters from which a part is merged by itself and soon forgotten.
LONG = 64
#: Characters of texts encoded at a time.
AT_ONCE = 1 << 18
#: Score of a pair that is no piece.
NEVER = float("-inf")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        out |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return out, i


def _fields(b: bytes):
    """``(number, value)`` of a protobuf message; submessages stay bytes."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 1:
            value, i = b[i : i + 8], i + 8
        elif kind == 5:
            value, i = struct.unpack("<f", b[i : i + 4])[0], i + 4
        else:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class CharMap:
    """Longest-prefix rewriting by a compiled character map."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            n = struct.unpack("<I", blob[:4])[0]
            self.units = list(struct.unpack(f"<{n // 4}I", blob[4 : 4 + n]))
            self.strings = blob[4 + n :]

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``b[i:]`` and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & (1 << 9)) >> 6)
        for j in range(i, len(b)):
            node ^= b[j]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 255) != b[j]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                at = units[node] & 0x7FFFFFFF
                found = (j + 1 - i, self.strings[at : self.strings.index(b"\0", at)])
        return found


class Model:
    """One SentencePiece BPE model: ``encode``, ``encode_spans``, ``decode``.

    Unknown characters fall back to byte pieces where the model has them, and
    to one unknown id per character where it has none.
    """

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.unk, charmap = 0, b""
        self.prefix = self.squeeze = self.escape = True
        for number, value in _fields(blob):
            if number == 1:
                f = dict(_fields(value))
                if f.get(3, 1) == 2:
                    self.unk = len(self.pieces)
                self.pieces.append(f.get(1, b"").decode())
                self.kinds.append(f.get(3, 1))
                scores.append(f.get(2, 0.0))
            elif number == 3:
                f = dict(_fields(value))
                charmap = f.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        self.charmap = CharMap(charmap)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (1, 4, 5)}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: What a piece decodes to by itself; None where that takes its neighbours or its kind.
        self.texts = [p.replace(SPACE, " ") if p and k in (1, 4, 5) else None for p, k in zip(self.pieces, self.kinds)]
        self.user = any(k == 4 for k in self.kinds)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Characters that stand side by side in some piece; None where chunks can't be cut.
        self.pairs = None if inner or self.user else {ab for p in self.ids for ab in zip(p, p[1:])}
        #: Chunks start at a run of spaces: sound as long as no piece holds a space after another character.
        self.chunks = re.compile("(?s).+" if inner or self.user else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: Whether every character of a text stays one, so that chunks can be normalised and aligned one by one.
        self.plain = not self.charmap.units and not self.squeeze and self.escape and bool(self.bytes)
        if self.plain and self.pairs is not None:
            self._tables()

    def _tables(self) -> None:
        """What ``merge_many`` and the memory of parts look up."""
        chars = sorted({c for ab in self.pairs for c in ab})
        #: Symbols are pieces by id and, after them, the characters of pieces that are no pieces.
        symbols = dict(self.ids)
        for c in chars:
            symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.base = max(symbols.values(), default=0) + 1
        #: Classes of characters: 0 for those in no pair, which are cut off on both sides.
        self.top = max(map(ord, [" ", *chars])) + 1
        self.klass, self.symbol = np.zeros(self.top + 1, np.int32), np.full(self.top + 1, -1)
        for k, c in enumerate(chars):
            self.klass[ord(c)], self.symbol[ord(c)] = k + 1, symbols[c]
        # Parts keep their spaces as they are: texts with space signs of their own go another way.
        self.klass[ord(" ")], self.symbol[ord(" ")] = (x[ord(SPACE)] if self.top > ord(SPACE) else 0 for x in (self.klass, self.symbol))
        self.width = len(chars) + 1
        self.together = np.zeros(self.width**2, bool)
        for a, b in self.pairs:
            self.together[self.klass[ord(a)] * self.width + self.klass[ord(b)]] = True
        joins = sorted((symbols[p[:k]] * self.base + symbols[p[k:]], i, self.scores[p]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.joins, self.joined = (np.array([j[k] for j in joins], np.int64) for k in (0, 1))
        #: Equal scores have equal ranks; the best is 0, ``none`` stands for a pair that is no piece.
        order = np.unique([-j[2] for j in joins], return_inverse=True)[1]
        self.rank, self.none = order.astype(np.int64), len(joins)
        self.covers = np.array([1 if k == 6 else len(p.replace(SPACE, " ").encode()) for p, k in zip(self.pieces, self.kinds)], np.uint8)
        self.listed = [f",{i}" for i in range(len(self.pieces))]
        #: Slots of remembered parts, in order; by slot: ids as listed, decoded text, place and number of ids, uses.
        self.known: dict[str, int] = {}
        self.lists: list[str] = []
        self.decoded: list[str] = []
        self.first, self.count, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.tokens = np.zeros(0, np.int32)

    def mapped(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Characters after longest-prefix rewriting and, for each, the source byte span."""
        if not self.charmap.units:
            # No key to look for: every character stands for its own bytes.
            ends = list(range(1, len(text) + 1)) if text.isascii() else list(accumulate(len(c.encode()) for c in text))
            return list(text), [0, *ends[:-1]], ends
        b = text.encode()
        out, starts, ends, i = [], [], [], 0
        while i < len(b):
            hit = self.charmap.longest(b, i)
            if hit:
                n, to = hit[0], hit[1].decode()
            else:
                n = 1 if b[i] < 128 else 2 if b[i] < 224 else 3 if b[i] < 240 else 4
                to = b[i : i + n].decode()
            out += to
            starts += [i] * len(to)
            ends += [i + n] * len(to)
            i += n
        return out, starts, ends

    def normalise(self, text: str) -> tuple[str, list[int], list[int]]:
        """Normalised text and, for each of its characters, the source byte span."""
        out, starts, ends = self.mapped(text)
        if self.squeeze:
            keep = [k for k, c in enumerate(out) if c != " " or (k and out[k - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                keep.pop()
            out, starts, ends = ([x[k] for k in keep] for x in (out, starts, ends))
        if self.prefix and out:
            out, starts, ends = [" ", *out], [0, *starts], [0, *ends]
        s = "".join(out)
        return s.replace(" ", SPACE) if self.escape else s, starts, ends

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk: the best-scored neighbours join first, leftmost on ties."""
        parts, scores = list(chunk), self.scores
        ranks = [scores.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = scores.get(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = scores.get(parts[at] + parts[at + 1], NEVER)
        return parts

    def merge_long(self, chunk: str) -> list[str]:
        """``merge`` with a heap, for chunks too long to scan at every step."""
        import heapq

        n = len(chunk)
        part, left, right = list(chunk), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (r := self.scores.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-r, i, j, part[i] + part[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[i] or right[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j], right[i] = both, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i])
            push(i)
        return [p for p in part if p]

    def _piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unk] * len(piece)

    def _pieces(self, chunk: str) -> list[str]:
        return self.merge(chunk) if len(chunk) < 64 else self.merge_long(chunk)

    def encode(self, text: str) -> list[int]:
        return next(self._aligned([text]))[0].tolist()

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """``(id, start, end)``: every piece with the original bytes it covers."""
        s, starts, ends = self.normalise(text)
        out, at = [], 0
        for c in self.chunks.findall(s):
            for p in self._pieces(c):
                a, e = starts[at], ends[at + len(p) - 1]
                ids = self._piece_ids(p)
                # Byte pieces of a character left as it was cover a byte each.
                each = len(ids) > 1 and len(ids) == e - a
                out += [(i, a + k, a + k + 1) if each else (i, a, e) for k, i in enumerate(ids)]
                at += len(p)
        return out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids: byte pieces joined to characters, broken ones as U+FFFD.

        ``first``: the ids start a text, so a leading dummy space is dropped.
        """
        texts = self.texts
        out = list(map(texts.__getitem__, ids))
        lead = 0
        if None in out:
            special = [k for k, t in enumerate(out) if t is None]
            run, nxt = bytearray(), None
            for k in reversed(special):
                b = self.byte_of.get(ids[k])
                if b is None:
                    out[k] = " ⁇ " if self.kinds[ids[k]] == 2 else ""
                    continue
                # A run of byte pieces is read from its first one.
                run = bytearray([b]) + run if nxt == k + 1 else bytearray([b])
                nxt = k
                out[k] = "" if k and ids[k - 1] in self.byte_of else self._broken(bytes(run))
            while lead < len(ids) and self.kinds[ids[lead]] == 3:
                lead += 1
        if first and self.prefix and lead < len(ids) and texts[ids[lead]] and texts[ids[lead]][0] == " ":
            out[lead] = out[lead][1:]
        return "".join(out)

    @staticmethod
    def _broken(run: bytes) -> str:
        """Bytes as UTF-8; every byte that starts no whole character gives one U+FFFD."""
        try:
            return run.decode()
        except UnicodeDecodeError:
            pass
        out, i = [], 0
        while i < len(run):
            n = 1 if run[i] < 128 else 2 if run[i] < 224 else 3 if run[i] < 240 else 4
            try:
                out.append(run[i : i + n].decode())
                i += n
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)

    def _joins(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols, and the pieces they make."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.joins, key), self.none - 1)
        return np.where(self.joins[at] == key, self.rank[at], self.none), self.joined[at]

    def merge_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many parts, all of whose characters are in ``pairs``, spaces as they are: symbols in order, and their number by part.

        Every round makes the best merge of each part, the leftmost on ties;
        parts without one are done.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        sym = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        out, count = np.full(len(sym), -1), np.zeros(len(parts), np.int64)
        part, first = np.arange(len(parts)), np.cumsum(sizes) - sizes
        place = first
        rank, to = self._joins(sym, np.append(sym[1:], 0))
        rank[first + sizes - 1] = self.none
        while len(part):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), first)
            live, at = best >> 32 < self.none, best & 0xFFFFFFFF
            stays = np.repeat(live, sizes)
            done = ~live
            if done.any():
                gone, n = ~stays, sizes[done]
                out[np.repeat(place[done] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = sym[gone]
                count[part[done]] = n
            at, offset = at[live], (at - first)[live]
            sym[at] = to[at]
            stays[at + 1] = False
            sym, rank, to = sym[stays], rank[stays], to[stays]
            part, place, sizes = part[live], place[live], sizes[live] - 1
            first = np.cumsum(sizes) - sizes
            at = first + offset
            # What was made has new neighbours on both sides.
            end = offset == sizes - 1
            rank[at[end]] = self.none
            new = np.concatenate([at[~end], at[offset > 0] - 1])
            if len(new):
                rank[new], to[new] = self._joins(sym[new], sym[new + 1])
        return out[out >= 0], count

    def _learn(self, parts: list[str]) -> None:
        """Gives parts slots. Their texts are decoded from their ids."""
        flat, count, many = np.zeros(0, np.int64), np.zeros(0, np.int64), [p for p in parts if 1 < len(p) < LONG]
        if many:
            flat, count = self.merge_many(many)
            if flat.max() >= len(self.pieces):
                # Characters that are no pieces become byte pieces, part by part.
                flat, count, many = flat[:0], count[:0], []
        ids, at = flat.tolist(), [0, *np.cumsum(count).tolist()]
        lists, texts = list(map(self.listed.__getitem__, ids)), list(map(self.texts.__getitem__, ids))
        self.lists += ["".join(lists[a:b]) for a, b in zip(at, at[1:])]
        self.decoded += ["".join(texts[a:b]) for a, b in zip(at, at[1:])]
        more, sizes, taken = [], [], set(many)
        rest = [p for p in parts if p not in taken]
        for p in rest:
            own = [i for piece in self._pieces(p.replace(" ", SPACE)) for i in self._piece_ids(piece)]
            self.lists.append("".join(map(self.listed.__getitem__, own)))
            self.decoded.append(self.decode(own, first=False))
            more += own
            sizes.append(len(own))
        self.known.update(zip([*many, *rest], range(len(self.known), len(self.known) + len(parts))))
        count = np.concatenate([count, np.array(sizes, np.int64)])
        self.first = np.concatenate([self.first, len(self.tokens) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(parts), np.int64)])
        self.tokens = np.concatenate([self.tokens, flat.astype(np.int32), np.array(more, np.int32)])

    def _forget(self) -> None:
        """Keeps at most half of ``CACHE`` parts, those used most."""
        parts, least = list(self.known), 2
        short = np.fromiter(map(len, parts), np.int64, len(parts)) < LONG
        while (stays := short & (self.uses >= least)).sum() > CACHE // 2:
            least *= 2
        slots = np.flatnonzero(stays)
        self.tokens = self.tokens[self._spread(slots)]
        self.count, self.uses = self.count[slots], self.uses[slots] // 2
        self.first = np.cumsum(self.count) - self.count
        slots = slots.tolist()
        self.known = {parts[k]: n for n, k in enumerate(slots)}
        self.lists, self.decoded = ([x[k] for k in slots] for x in (self.lists, self.decoded))

    def _spread(self, slots: np.ndarray) -> np.ndarray:
        """Places in ``tokens`` of all ids of slots."""
        n = self.count[slots]
        return np.repeat(self.first[slots] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def _slots(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Slots of all parts of texts, and the part with which each text starts, with an end."""
        if len(self.known) > CACHE or len(self.tokens) > 16 * CACHE:
            self._forget()
        own = [" " + t if t else "" for t in texts] if self.prefix else texts
        kind = self.klass[np.minimum(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32), self.top)]
        edges = np.cumsum([0, *map(len, own)])
        cut = np.ones(len(kind) + 1, bool)
        # Merges never cross where no piece holds the two characters side by side.
        cut[1:-1] = ~self.together[kind[:-1] * self.width + kind[1:]]
        cut[edges] = True
        cuts = np.flatnonzero(cut)
        bounds = np.searchsorted(cuts, edges)
        parts: list[str] = []
        for t, x, a, b in zip(own, edges, bounds, bounds[1:]):
            at = (cuts[a : b + 1] - x).tolist()
            parts += [t[i:j] for i, j in zip(at, at[1:])]
        slots = list(map(self.known.get, parts))
        if None in slots:
            self._learn(list(dict.fromkeys([p for p, k in zip(parts, slots) if k is None])))
            slots = [self.known[p] if k is None else k for p, k in zip(parts, slots)]
        return slots, bounds

    def _aligned(self, texts: list[str]):
        """``(ids, ends, listed, decoded)`` of each text: ids, the source byte at which each piece ends, ids joined by commas, their text."""
        if not self.plain or self.pairs is None:
            yield from map(self._alone, texts)
            return
        # Parts of a text with the space sign in it don't tell it from a space.
        slots, bounds = self._slots(["" if SPACE in t else t for t in texts])
        where = np.array(slots, np.int64)
        self.uses += np.bincount(where, minlength=len(self.uses))
        ids = self.tokens[self._spread(where)]
        ends = np.append(0, np.cumsum(self.covers[ids], dtype=np.int64))
        edges = np.append(0, np.cumsum(self.count[where]))[bounds].tolist()
        lists, decoded = list(map(self.lists.__getitem__, slots)), list(map(self.decoded.__getitem__, slots))
        bounds = bounds.tolist()
        for k, t in enumerate(texts):
            if SPACE in t:
                yield self._alone(t)
                continue
            (a, b), (x, y) = bounds[k : k + 2], edges[k : k + 2]
            back = "".join(decoded[a:b])
            if self.prefix and y > x and (self.texts[ids[x]] or "")[:1] == " ":
                back = back[1:]
            # The space put before the text has no source byte.
            yield ids[x:y], (ends[x + 1 : y + 1] - (ends[x] + self.prefix)).astype(np.int32), "".join(lists[a:b])[1:], back

    def _alone(self, text: str) -> tuple[np.ndarray, np.ndarray, str, str]:
        spans = self.encode_spans(text)
        ids = [i for i, _, _ in spans]
        return np.array(ids, np.int32), np.array([e for _, _, e in spans], np.int32), ",".join(map(str, ids)), self.decode(ids)

    def aligned(self, texts: list[str]):
        """``_aligned`` of any number of texts, some ``AT_ONCE`` characters of them at a time."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= AT_ONCE:
                yield from self._aligned(some)
                some, size = [], 0
        if some:
            yield from self._aligned(some)

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        """Ids, the source byte at which each piece ends, and the text that the ids decode to."""
        ids, ends, _, back = next(self._aligned([text]))
        return ids, ends, back

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, str]]:
        """For each text: number of ids, and digests of the ids, of the text they decode to, and of the ends of their spans."""
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [(len(ids), sha(listed.encode()), sha(back.encode()), sha(ends.astype("<i4").tobytes())) for ids, ends, listed, back in self.aligned(texts)]

    def digest(self, text: str) -> tuple[int, str, str, str]:
        return self.digests([text])[0]


_models: dict[bytes, Model] = {}


def shared(blob: bytes) -> Model:
    """The model of a worker process: its memory of chunks lives on between tasks."""
    key = hashlib.sha256(blob).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(blob)
    return _models[key]


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ends_sha256)``, one row per input row.

    Every text is rewritten, aligned, encoded and decoded from its ids;
    ``ends_sha256`` is over the bytes of the source at which pieces end, as
    little-endian 32-bit numbers. A null text counts as empty: no ids, digests of the empty string. Repeated
    rows give repeated results, a null doc_id stays null, an empty table gives
    an empty result; only ``doc_id`` and ``text`` are read.
    """
    blob = load(model_path)

    def run(batches):
        model = shared(blob)
        for batch in batches:
            rows = model.digests([t or "" for t in batch.column(1).to_pylist()])
            n, *shas = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in shas)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, starts, ends)``: ids and original byte spans of every row's text.

    Null and empty texts give empty arrays; otherwise as ``encode_digests``.
    """
    blob = load(model_path)

    def run(batches):
        model = shared(blob)
        for batch in batches:
            spans = [model.encode_spans(t or "") for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([[x[k] for x in s] for s in spans], kind) for k in range(3))], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, source, n_tokens, ids, ends, decoded)``, one row per input row.

    ``ends`` holds, for each id, the byte of the original text at which its
    piece ends; pieces follow one another, so each starts where the one before
    it ends. Null and empty texts give empty arrays and an empty ``decoded``.
    """
    blob = load(model_path)
    kind = pa.list_(pa.int32())

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32), pa.int32())).cast(kind)

    def run(batches):
        model = shared(blob)
        for batch in batches:
            # A part of a batch at a time: ids take more room than their text.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = list(model.aligned([t or "" for t in part.column(2).to_pylist()]))
                ids, ends = ([r[k] for r in rows] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(i) for i in ids], pa.int64()), lists(ids), lists(ends), pa.array([r[3] for r in rows], pa.string())],
                    ["doc_id", "source", "n_tokens", "ids", "ends", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, ends array<int>, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
