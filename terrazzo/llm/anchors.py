"""Anchored regions: where equal windows of tokens must meet.

A window of ``window`` tokens (bytes or words) is anchored at the smallest
hash among its ``gram``-token substrings, the leftmost on ties. Equal windows
choose the same anchor at the same offset, so only windows with equal anchor
hashes need comparing. Consecutive windows with one anchor form a region:
``lo`` and ``count`` are its first window and their number, ``offset`` where
the anchor stands in the first window, and ``content`` a hash of the tokens
that the windows cover. Every window belongs to exactly one region of its text.

Anchors come from polynomial hashes, which may collide: unlike grams then share
a key, and their regions are told apart like any others of one key. Contents are
XXH3 hashes of the tokens themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bits of a packed key that hold the position; a piece of a text is no longer.
PLACE = 22
PIECE = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[bool, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = np.full(size, _INVERSE if inverse else BASE, np.uint64)
        have[0] = 1
        have = _powers[inverse] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


#: Scrambled values of the 256 bytes, so that sums of powers do not cancel.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


class Prefix:
    """Polynomial hashes of all substrings of a token sequence."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * _power(n, False), out=self.sums[1:])
        self.back = _power(n + 1, True)

    def hashes(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])


@dataclass
class Regions:
    anchor: np.ndarray
    content: np.ndarray
    lo: np.ndarray
    count: np.ndarray
    offset: np.ndarray


def sliding_low(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` keys, from block-wise running minima."""
    n = len(keys)
    pad = -n % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(tokens: np.ndarray, raw: bytes, window: int, gram: int) -> Regions:
    """Regions of one text. Texts shorter than a window have none.

    ``raw`` holds the tokens as bytes, equally many for each. A text longer
    than ``PIECE`` tokens is cut into overlapping pieces; a region that a cut
    divides becomes two regions of other content, which callers treat as they
    treat any regions that differ.
    """
    n = len(tokens) - window + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return Regions(none, none, *(np.zeros(0, np.int64) for _ in range(3)))
    unit = len(raw) // len(tokens)
    if n > PIECE:
        parts = []
        for a in range(0, n, PIECE):
            b = min(a + PIECE + window - 1, len(tokens))
            r = regions(tokens[a:b], raw[a * unit : b * unit], window, gram)
            r.lo += a
            parts.append((r.anchor, r.content, r.lo, r.count, r.offset))
        return Regions(*map(np.concatenate, zip(*parts)))
    m = len(tokens) - gram + 1
    grams = Prefix(tokens).hashes(slice(0, m), slice(gram, m + gram))
    place = np.arange(m, dtype=np.uint64)
    keys = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | place
    at = (sliding_low(keys, window - gram + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(starts, n))
    anchor = at[starts]
    x, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    ends = (starts + count + window - 1) * unit
    content = np.array([x(view[a:b]) for a, b in zip((starts * unit).tolist(), ends.tolist())], np.uint64)
    return Regions(grams[anchor], content, starts, count, anchor - starts)
