"""Point patterns: Delaunay edges and their lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.operators.series import histogram


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edges, as index pairs, of a Delaunay triangulation of distinct integer points.

    Bowyer-Watson in exact integer arithmetic. Points enter in (x, y) order
    and a point on a circle counts as outside it, which fixes the choice among
    the triangulations of cocircular points; collinear points give the path
    along them.
    """
    pts = [(int(a), int(b)) for a, b in zip(x, y)]
    n = len(pts)
    order = sorted(range(n), key=lambda k: pts[k])
    if n < 2:
        return np.zeros((0, 2), np.int64)
    p0, p1 = pts[order[0]], pts[order[1]]
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if all(cross(p0, p1, pts[k]) == 0 for k in order[2:]):
        return np.array([sorted(e) for e in zip(order, order[1:])], np.int64)
    # Outer corners lie beyond the circle of any triangle of integer points of this span.
    span = max(max(abs(a), abs(b)) for a, b in pts) + 1
    far = span**3 * 64
    pts = [*pts, (-far * 3, -far * 3), (far * 3, -far * 3 + 1), (1, far * 3)]

    def inside(t: tuple[int, int, int], p: tuple[int, int]) -> bool:
        (ax, ay), (bx, by), (cx, cy) = ((pts[k][0] - p[0], pts[k][1] - p[1]) for k in t)
        return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    start = (n, n + 1, n + 2)
    triangles, owner = {start}, {(start[k], start[(k + 1) % 3]): start for k in range(3)}
    last = start
    for k in order:
        p = pts[k]
        # Walk towards p from the latest triangle, then grow the set of circles around it.
        t, steps = last if last in triangles else next(iter(triangles)), 0
        while True:
            out = next((e for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])) if cross(pts[e[0]], pts[e[1]], p) < 0), None)
            nxt = owner.get((out[1], out[0])) if out else None
            if nxt is None:
                break
            t, steps = nxt, steps + 1
        bad, stack = {t}, [t]
        while stack:
            u = stack.pop()
            for a, b in ((u[0], u[1]), (u[1], u[2]), (u[2], u[0])):
                o = owner.get((b, a))
                if o is not None and o not in bad and (inside(o, p) or cross(pts[a], pts[b], p) == 0):
                    bad.add(o)
                    stack.append(o)
        rim = [(a, b) for u in bad for a, b in ((u[0], u[1]), (u[1], u[2]), (u[2], u[0])) if owner.get((b, a)) not in bad]
        for u in bad:
            triangles.discard(u)
            for a, b in ((u[0], u[1]), (u[1], u[2]), (u[2], u[0])):
                owner.pop((a, b), None)
        for a, b in rim:
            u = (a, b, k)
            triangles.add(u)
            owner[a, b] = owner[b, k] = owner[k, a] = u
            last = u
    edges = {(min(a, b), max(a, b)) for a, b in owner if a < n and b < n}
    return np.array(sorted(edges), np.int64).reshape(-1, 2)


def delaunay_edges(cells: DataFrame, window: int = 64, by: str = "v") -> DataFrame:
    """``(v, wi, wj, i1, j1, i2, j2, length)``: Delaunay edges of each category's cells.

    A category may be of any size, so it is triangulated in windows of
    ``window`` x ``window`` cells, each a task's worth of points; edges across
    windows are left out. A window as large as the raster gives the whole
    triangulation of a category.
    """

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        e = delaunay(i, j)
        a, b = e[:, 0], e[:, 1]
        same = lambda c: pa.array([table.column(c)[0].as_py()] * len(e), table.column(c).type)
        length = np.sqrt(((i[a] - i[b]) ** 2 + (j[a] - j[b]) ** 2).astype(float))
        return pa.table([same("v"), same("wi"), same("wj"), *map(pa.array, (i[a], j[a], i[b], j[b], length))], names=["v", "wi", "wj", "i1", "j1", "i2", "j2", "length"])

    keyed = cells.select(F.col(by).cast("int").alias("v"), "i", "j", F.floor(F.col("i") / window).alias("wi"), F.floor(F.col("j") / window).alias("wj"))
    return keyed.groupBy("v", "wi", "wj").applyInArrow(run, "v int, wi long, wj long, i1 long, j1 long, i2 long, j2 long, length double")


def edge_histogram(edges: DataFrame, binsize: float = 1.0) -> DataFrame:
    """``(v, bin, lo, hi, count)`` of edge lengths, ceil(max / binsize) - 1 bins from 1 to ceil(max)."""
    return histogram(edges, "v", "length", binsize=binsize)
