"""Secret scan: fixed patterns, and guess costs of values in credential context.

Three base patterns find assignments, access keys and hex runs. Beside them,
values that stand in credential context (``pwd: ...``, ``Bearer ...``,
``user:value@host``) are priced by dynamic programming: the cheapest way to
segment the value into dictionary words, dates, repeats, keyboard walks and
brute-force spans, in decimal digits of guesses. A value that no cheap
segmentation explains is reported as kind ``guess``.

The dictionary is a short list of password words and the ``WORDS`` most
frequent words of all texts, whatever their languages; values in credential
context do not count as text. Pricing takes time in proportion to a value.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.storage import discard, materialize

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
KINDS = ("assign", "access", "hex", "guess")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = ("password", "passwd", "secret", "token")
ASSIGN = re.compile("(" + "|".join(map(_either, _WORDS)) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What a folded text has to hold before a pattern is tried on it.
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Words that put the value after them in credential context, those of ASSIGN included.
_CONTEXT = ("passphrase", "passcode", "credential", "credentials", "private_key", "access_key", "auth", "bearer", "pwd", "pass", *_WORDS, "api_?key")
#: A value of six characters or more; an ampersand before the next name of a query string ends it.
_VALUE = r"((?:[A-Za-z0-9+/_.=!@#$%^*-]|&(?![A-Za-z0-9_]+=)){6,})"
CONTEXT = re.compile("(?i)(?<![A-Za-z0-9])(?:" + "|".join(_CONTEXT) + r""")["']?(?:\x20*[:=]\x20*|\x20+(?=[^\x20]*[0-9]))["']?""" + _VALUE)
#: Assignments as ASSIGN finds them, with their whole values.
ASSIGNED = re.compile("(?:" + "|".join(map(_either, _WORDS)) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?""" + _VALUE)
LOGIN = re.compile(r"://[A-Za-z0-9._-]+:([^\x20\x09-\x0D@/]{6,})@")
_CONTEXT_HINTS = (*_ASSIGN_HINTS, "pass", "pwd", "auth", "bearer", "_key", "credential", "://")

#: Decimal digits of guesses from which a value counts as secret.
MIN_DIGITS = 8.0
#: Longest repeated unit that the segmentation knows.
MAX_UNIT = 16
#: Words learned from the texts, and their letters.
WORDS = 20_000
_WORD = re.compile("[a-z]{4,24}")
#: Words that a task counts before it hands them on.
COUNTED = 200_000

# Frequent password words, most frequent first.
COMMON = """password love admin welcome dragon monkey letmein master shadow sunshine princess football baseball
superman michael jordan ashley bailey hello charlie donald freedom secret summer winter spring autumn flower
test guest root user login default changeme access example pass word key token the and for you not that with
this from have are was his her they but all one can our out day get has him how man new now old see two way who
boy did its let put say she too use home time year work life hand part child eye woman place week case point
company number group problem fact""".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_NEXT = {(a, b) for row in KEYBOARD for s in (row, row[::-1]) for a, b in zip(s, s[1:])}
_LEET = str.maketrans("0134578@$", "oleastbas")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?")


def _pool(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33


def _stretches(n: int, joined) -> Iterator[tuple[int, int]]:
    """Maximal ``[a, b)`` of three or more places, each ``joined`` to the next."""
    a = 0
    for k in range(1, n + 1):
        if k == n or not joined(k - 1):
            if k - a >= 3:
                yield a, k
            a = k


def _periodic(value: str) -> Iterator[tuple[int, int, int]]:
    """``(size, a, b)``: maximal runs of places that equal the place ``size`` on, long enough to repeat a unit."""
    n = len(value)
    if n > 200:
        code = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    for size in range(2, min(MAX_UNIT, n // 2) + 1):
        if n > 200:
            apart = np.flatnonzero(code[:-size] != code[size:]).tolist()
        else:
            apart = [k for k in range(n - size) if value[k] != value[k + size]]
        a = 0
        for b in [*apart, n - size]:
            if b - a >= size:
                yield size, a, b
            a = b + 1


class Guesser:
    """Prices values: ``ranks`` gives words and their places among the words tried first."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.ranks = {w: k + len(COMMON) for w, k in (ranks or {}).items()} | {w: k + 1 for k, w in enumerate(COMMON)}
        self.words = ahocorasick.Automaton()
        for w, k in self.ranks.items():
            self.words.add_word(w, (len(w), k))
        self.words.make_automaton()
        self.units: dict[str, float] = {}

    def _unit(self, unit: str) -> float:
        got = self.units.get(unit)
        if got is None:
            if len(self.units) > 50_000:
                self.units.clear()
            got = self.units[unit] = self.digits(unit)
        return got

    def _arcs(self, value: str) -> dict[int, list[tuple[int, float]]]:
        """Cheap segments, by start: their ends and costs."""
        n, low = len(value), value.lower()
        if len(low) != n:
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        arcs: dict[int, list[tuple[int, float]]] = {}
        join = math.log10(2)
        upper = [0]
        for c in value:
            upper.append(upper[-1] + c.isupper())
        plain = low.translate(_LEET)
        for text, more in ((low, 0.0), (plain, join)) if plain != low else ((low, 0.0),):
            for last, (size, rank) in self.words.iter(text):
                a, b = last + 1 - size, last + 1
                caps = upper[b] - upper[a]
                case = 0.0 if not caps else join if caps in (1, size) else join * caps
                arcs.setdefault(a, []).append((b, math.log10(rank) + case + more))
        for m in re.finditer("(?=(?:19|20)[0-9])", value):
            a = m.start()
            if d := _DATE.match(value, a):
                for b in {a + 4, d.end()}:
                    arcs.setdefault(a, []).append((b, math.log10(120 * (1 if b - a == 4 else 12 if b - a < 8 else 366))))
        far = [0] * (n + 1)
        step = [ord(y) - ord(x) for x, y in zip(value, value[1:])]
        kinds = (
            (lambda k: step[k] == 0, None),
            (lambda k: (low[k], low[k + 1]) in _NEXT, 48),
            (lambda k: step[k] == 1, 48),
            (lambda k: step[k] == -1, 48),
        )
        for joined, choices in kinds:
            for a, b in _stretches(n, joined):
                base = choices or _pool(value[a])
                # From its start a stretch may end anywhere, from inside it goes on to its end.
                for k in range(a + 3, b):
                    arcs.setdefault(a, []).append((k, math.log10(base * (k - a))))
                for k in range(a, b - 2):
                    arcs.setdefault(k, []).append((b, math.log10(base * (b - k))))
                    if choices is None:
                        far[k] = b
        for size, a, b in _periodic(value):
            for k in range(a, b - size + 1):
                times = 1 + (b - k) // size
                end = k + times * size
                # A shorter unit, or one character, says the same.
                if end > far[k]:
                    far[k] = end
                    arcs.setdefault(k, []).append((end, self._unit(value[k : k + size]) + math.log10(times)))
        return arcs

    def digits(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation of ``value`` needs.

        Every segment also costs a factor of 2 for saying where it ends, so that
        many cheap segments do not undercut a plain search. An empty value needs none.
        """
        arcs, join, run = self._arcs(value), math.log10(2), math.inf
        best = [0.0] + [math.inf] * len(value)
        for k, c in enumerate(value):
            here = best[k] + join
            run = min(run, here) + math.log10(_pool(c))
            if run < best[k + 1]:
                best[k + 1] = run
            for end, cost in arcs.get(k, ()):
                if here + cost < best[end]:
                    best[end] = here + cost
        return best[-1]


def _holds(folded: str, hints: tuple[str, ...]) -> bool:
    return any(h in folded for h in hints)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, by start, then kind."""
    out = []
    if _holds(text.casefold(), _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def values(text: str) -> dict[int, int]:
    """Values in credential context, assigned ones included: starts and ends."""
    found: dict[int, int] = {}
    if _holds(text.casefold(), _CONTEXT_HINTS):
        for pattern, group in ((ASSIGN, 2), (ASSIGNED, 1), (CONTEXT, 1), (LOGIN, 1)):
            for m in pattern.finditer(text):
                a, b = m.span(group)
                if b - a >= 6:
                    found[a] = max(b, found.get(a, 0))
    return found


def guessed_spans(text: str, guesser: Guesser) -> list[tuple[int, int, int]]:
    """Values in credential context that cost enough guesses."""
    return [(a, 3, b) for a, b in values(text).items() if guesser.digits(text[a:b]) >= MIN_DIGITS]


def word_ranks(docs: DataFrame, keep: int = WORDS) -> dict[str, int]:
    """The ``keep`` most frequent words of all texts, ranked from 1, ties by code point.

    Words are runs of 4 to 24 letters a to z, lower-cased; what stands in
    credential context is not counted. What comes to the driver is bounded by
    ``keep``. Null and empty texts have no words.
    """

    def run(batches):
        counts: Counter[str] = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                for a, b in values(text).items():
                    text = text[:a] + " " * (b - a) + text[b:]
                counts.update(_WORD.findall(text.lower()))
                if len(counts) >= COUNTED:
                    yield told()
        yield told()

    parts = docs.select("text").mapInArrow(run, "word string, n long")
    counts, path = materialize(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # How many words have about which count: a few hundred rows, which say how far down the first words lie.
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("long")
    held, least = 0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held, least = held + r["count"], r.level
        if held >= keep:
            break
    top = counts.where(level >= least).orderBy(F.desc("n"), "word").limit(keep).collect()
    discard(docs.sparkSession, path)
    return {r.word: k + 1 for k, r in enumerate(top)}


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per input row.

    ``ranks`` are the words that make a value cheap, by default those of
    ``docs`` themselves. Offsets are code points, ends exclusive. A null text counts as empty:
    zero counts, digest of the empty string, empty ``spans``. Repeated rows
    give repeated results and an empty table an empty one; other columns than
    ``doc_id`` and ``text`` are not read.
    """

    ranks = word_ranks(docs) if ranks is None else ranks

    def run(batches):
        guesser = Guesser(ranks)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                kinds = [k for _, k, _ in base]
                every = sorted(base + guessed_spans(text or "", guesser))
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
