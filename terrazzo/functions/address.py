"""Grid addressing as Column expressions: storage orders, Morton codes, location codes.

All are built from integer arithmetic and bit operations, so they run inside
whole-stage code generation. Indices are BIGINT; Morton codes take up to 31
bits per axis.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every second bit: the row's from bit 0, the column's from bit 1.
EVEN_BITS = 0x5555555555555555
ODD_BITS = 0x2AAAAAAAAAAAAAAA
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, EVEN_BITS))
#: The eight neighbours as ``(dx, dy)``, counter-clockwise from the east; every second one shares a side.
COMPASS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _col(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("long")


def quotient(x, by) -> Column:
    """Integer quotient."""
    return F.call_function("div", _col(x), _col(by))


def linear(i, j, cols) -> Column:
    """Row-major index."""
    return _col(i) * _col(cols) + _col(j)


def unlinear(n, cols) -> tuple[Column, Column]:
    """Row and column of a row-major index."""
    return quotient(n, cols), F.pmod(_col(n), _col(cols))


def blocked(i, j, cols, block) -> Column:
    """Index with every run of block * block cells transposed in place."""
    n, b = linear(i, j, cols), _col(block)
    inside = F.pmod(n, b * b)
    return n - inside + quotient(inside, b) + F.pmod(inside, b) * b


def full_blocked(i, j, cols, block) -> Column:
    """Index by square blocks in row-major order, row-major inside each."""
    i, j, b = _col(i), _col(j), _col(block)
    across = quotient(_col(cols) - 1, b) + 1
    return (quotient(i, b) * across + quotient(j, b)) * b * b + F.pmod(i, b) * b + F.pmod(j, b)


def full_unblocked(n, cols, block) -> tuple[Column, Column]:
    """Row and column of a ``full_blocked`` index."""
    n, b = _col(n), _col(block)
    across = quotient(_col(cols) - 1, b) + 1
    tile, inside = quotient(n, b * b), F.pmod(n, b * b)
    return quotient(tile, across) * b + quotient(inside, b), F.pmod(tile, across) * b + F.pmod(inside, b)


def _spread(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x7FFFFFFF))
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(EVEN_BITS))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(i, j) -> Column:
    """Interleaved bits: ``i`` in even places, ``j`` in odd ones."""
    return _spread(_col(i)).bitwiseOR(F.shiftleft(_spread(_col(j)), 1))


def unmorton(n) -> tuple[Column, Column]:
    n = _col(n)
    return _gather(n), _gather(F.shiftright(n, 1))


def interleaved_add(n, d, even=EVEN_BITS, odd=ODD_BITS) -> Column:
    """Sum of two codes, each axis by itself: carries stay on their own bits."""
    n, d, even, odd = _col(n), _col(d), _col(even), _col(odd)
    x = (n.bitwiseOR(odd) + d.bitwiseAND(even)).bitwiseAND(even)
    y = (n.bitwiseOR(even) + d.bitwiseAND(odd)).bitwiseAND(odd)
    return x.bitwiseOR(y)


def _side(level, levels: int) -> Column:
    """Cells along a quadrant of that level."""
    return F.pow(F.lit(2.0), (F.lit(levels) - _col(level)).cast("double")).cast("long")


def neighbor(code, level, levels: int, dx, dy) -> Column:
    """Code of the quadrant of the same size ``(dx, dy)`` quadrants away; the image wraps around.

    The code is taken apart into its corner, the corner moved, and put together again.
    """
    x, y = unmorton(code)
    side, span = _side(level, levels), F.lit(1 << levels)
    return morton(F.pmod(x + _col(dx) * side, span), F.pmod(y + _col(dy) * side, span))


def child(code, level, levels: int, quarter) -> Column:
    """Code of a child quadrant: the corner of quarter 0 to 3, x first."""
    x, y = unmorton(code)
    half = _side(_col(level) + 1, levels)
    return morton(x + F.pmod(_col(quarter), F.lit(2)) * half, y + quotient(quarter, 2) * half)


def digits(code, levels: int) -> Column:
    """Base-4 digits of a code, most significant first."""
    return F.array(*[F.shiftright(_col(code), 2 * k).bitwiseAND(F.lit(3)) for k in range(levels - 1, -1, -1)])


def from_digits(values) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, d: F.shiftleft(a, 2).bitwiseOR(d.cast("long")))


def bounding_box(code, level, levels: int) -> tuple[Column, Column, Column, Column]:
    """Half-open ``x0, y0, x1, y1`` of a quadrant."""
    x, y = unmorton(code)
    side = _side(level, levels)
    return x, y, x + side, y + side


def levels_for(*shape: int) -> int:
    """Levels of a quadtree whose root spans a grid of that shape."""
    return max(0, max(shape) - 1).bit_length()


def levels_of(*extents) -> Column:
    """``levels_for`` of columns."""
    most = F.greatest(*[_col(e) for e in extents]) if len(extents) > 1 else _col(extents[0])
    return F.when(most <= 1, F.lit(0)).otherwise(F.length(F.bin(most - 1))).cast("int")
