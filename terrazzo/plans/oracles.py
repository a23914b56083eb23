"""DuckDB SQL of the raster queries, written independently of the DataFrame plans."""

from __future__ import annotations

E = """e AS (SELECT vec_id AS i, (k - 1)::BIGINT AS j, (CASE WHEN x > 0.05 THEN 2 WHEN x > -0.05 THEN 1 ELSE 0 END)::INTEGER AS v
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings))"""
L = """l0 AS MATERIALIZED (SELECT (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 7)::BIGINT AS i, (l_quantity::BIGINT - 1) AS j, count(*) AS c FROM lineitem GROUP BY 1, 2),
  dim AS (SELECT max(i) + 1 AS height FROM l0),
  l AS MATERIALIZED (SELECT a.i, b.j, least(coalesce(c, 0) // 2, 3)::INTEGER AS v FROM (SELECT unnest(range(0, (SELECT height FROM dim))) AS i) a
    CROSS JOIN (SELECT unnest(range(0, 50)) AS j) b LEFT JOIN l0 ON l0.i = a.i AND l0.j = b.j)"""
H = """h AS (SELECT a.i, b.j, ((3571 * a.i + 2663 * b.j) % 256)::INTEGER AS v FROM (SELECT unnest(range(0, 256)) AS i) a CROSS JOIN (SELECT unnest(range(0, 512)) AS j) b)"""
W_E, W_L, W_H = 64, 50, 512


def _spread(x: str, bits: int, at: int) -> str:
    return " | ".join(f"((({x} >> {k}) & 1) << {2 * k + at})" for k in range(bits))


def morton(x: str, y: str, bits: int) -> str:
    return f"({_spread(x, bits, 0)} | {_spread(y, bits, 1)})"


def cells(raster: str, width: int) -> str:
    return f"""cells AS MATERIALIZED (SELECT i * {width} + j AS n, i, j, v FROM {raster}),
  edges AS MATERIALIZED (SELECT a.n AS s, b.n AS t FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j + 1 AND b.v = a.v
    UNION ALL SELECT a.n, b.n FROM cells a JOIN cells b ON b.i = a.i + 1 AND b.j = a.j AND b.v = a.v)"""


def labelled(raster: str, width: int) -> str:
    return f"""{cells(raster, width)},
  sym AS MATERIALIZED (SELECT s, t FROM edges UNION ALL SELECT t, s FROM edges),
  reach(n, l) USING KEY (n) AS (SELECT n, n FROM cells UNION
    SELECT x.t, x.m FROM (SELECT sym.t, min(reach.l) AS m FROM reach JOIN sym ON sym.s = reach.n GROUP BY sym.t) x JOIN recurring.reach rr ON rr.n = x.t WHERE x.m < rr.l),
  lab AS MATERIALIZED (SELECT c.n, c.i, c.j, c.v, r.l AS cluster_id FROM cells c JOIN reach r ON r.n = c.n)"""


EL, LL = f"WITH RECURSIVE {E}, {labelled('e', W_E)}", f"WITH RECURSIVE {L}, {labelled('l', W_L)}"
EDGES4 = """SELECT a.n AS s, b.n AS t FROM cells a JOIN cells b ON (b.i = a.i AND abs(b.j - a.j) = 1) OR (b.j = a.j AND abs(b.i - a.i) = 1)"""
BOX_EPS = (1, 2, 4, 8, 16, 32)
BOXES = f"""{L}, sc AS (SELECT unnest([{", ".join(map(str, BOX_EPS))}])::BIGINT AS eps),
  boxes AS (SELECT v, eps, height // eps AS nx, 50 // eps AS ny, i * (height // eps) // height AS bx, j * (50 // eps) // 50 AS by, count(*) AS mass
    FROM l CROSS JOIN sc CROSS JOIN dim GROUP BY ALL)"""
RECTS = f"""{E}, dims AS (SELECT max(i) + 1 AS height FROM e), rects AS (SELECT bi, bj, bi * 32 AS r0, least(bi * 32 + 32, height) AS r1, bj * 32 AS c0, least(bj * 32 + 32, 64) AS c1
  FROM dims CROSS JOIN (SELECT unnest(range(0, (SELECT (height + 31) // 32 FROM dims))) AS bi) CROSS JOIN (SELECT unnest(range(0, 2)) AS bj))"""
SEAMS = f"""{RECTS}, named AS (SELECT bi * 1000 + bj AS name, * FROM rects),
  seams AS (SELECT a.name AS a, b.name AS b, true AS vertical, b.c0 AS line, greatest(a.r0, b.r0) AS lo, least(a.r1, b.r1) AS hi FROM named a JOIN named b ON a.c1 = b.c0 WHERE greatest(a.r0, b.r0) < least(a.r1, b.r1)
    UNION ALL SELECT a.name, b.name, false, b.r0, greatest(a.c0, b.c0), least(a.c1, b.c1) FROM named a JOIN named b ON a.r1 = b.r0 WHERE greatest(a.c0, b.c0) < least(a.c1, b.c1))"""
RUNS = f"""{E}, marked AS (SELECT i, j, v, sum(new) OVER (PARTITION BY i ORDER BY j) AS run FROM (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY i ORDER BY j) = v THEN 0 ELSE 1 END AS new FROM e)),
  runs AS (SELECT i, min(j) AS j0, max(j) AS j1, v FROM marked GROUP BY i, run, v)"""
#: The mask of category 3, 512 x 512 with white padding, counted level by level over the full grid.
QUAD_BITS = 9
QUAD = f"""{L}, px AS (SELECT x, y, {morton("x", "y", QUAD_BITS)} AS m, coalesce(l.v = 3, false) AS b FROM (SELECT unnest(range(0, 512)) AS x) CROSS JOIN (SELECT unnest(range(0, 512)) AS y) LEFT JOIN l ON l.i = x AND l.j = y),
  nodes AS (SELECT k, m >> (2 * k) AS node, bool_and(b) AS every, bool_or(b) AS some FROM px CROSS JOIN (SELECT unnest(range(0, 10)) AS k) GROUP BY ALL),
  leaves AS MATERIALIZED (SELECT n.node << (2 * n.k) AS code, (9 - n.k)::INTEGER AS level, CASE WHEN n.some THEN 'black' ELSE 'white' END AS color
    FROM nodes n LEFT JOIN nodes p ON p.k = n.k + 1 AND p.node = n.node >> 2 WHERE n.every = n.some AND (p.k IS NULL OR p.every <> p.some)),
  boxed AS MATERIALIZED (SELECT code, level, color, {" + ".join(f"(((code >> {2 * k}) & 1) << {k})" for k in range(QUAD_BITS))} AS x0, {" + ".join(f"(((code >> {2 * k + 1}) & 1) << {k})" for k in range(QUAD_BITS))} AS y0, (512 >> level)::BIGINT AS side FROM leaves),
  sides AS (SELECT b.code, b.level, b.color, d, b.x0 + dx * side AS nx, b.y0 + dy * side AS ny FROM boxed b CROSS JOIN (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)) AS t(d, dx, dy) WHERE b.x0 + dx * side BETWEEN 0 AND 511 AND b.y0 + dy * side BETWEEN 0 AND 511),
  met AS MATERIALIZED (SELECT s.code, s.level, s.color, s.d, o.code AS to_code, o.level AS to_level, o.color AS to_color
    FROM sides s JOIN nodes q ON false JOIN boxed o ON true UNION ALL
    SELECT s.code, s.level, s.color, s.d, o.code, o.level, o.color FROM sides s CROSS JOIN (SELECT unnest(range(0, 10)) AS lv) JOIN boxed o ON o.level = lv AND o.level <= s.level AND o.x0 = s.nx // (512 >> lv) * (512 >> lv) AND o.y0 = s.ny // (512 >> lv) * (512 >> lv))"""
QUAD = QUAD.replace("""SELECT s.code, s.level, s.color, s.d, o.code AS to_code, o.level AS to_level, o.color AS to_color
    FROM sides s JOIN nodes q ON false JOIN boxed o ON true UNION ALL
    SELECT s.code, s.level, s.color, s.d, o.code, o.level, o.color FROM""", "SELECT s.code, s.level, s.color, s.d, o.code AS to_code, o.level AS to_level, o.color AS to_color FROM")
MONTHS = """pts AS (SELECT row_number() OVER (ORDER BY m) - 1 AS k, x, y FROM (SELECT m, (row_number() OVER (ORDER BY m) - 1)::DOUBLE AS x, y FROM (
    SELECT date_trunc('month', o_orderdate) AS m, count(*)::DOUBLE AS y FROM orders GROUP BY 1) )),
  win AS (SELECT a.k AS start, b.k - a.k + 1 AS width FROM pts a JOIN pts b ON b.k >= a.k + 4),
  fit AS (SELECT start, width, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, CASE WHEN regr_syy(y, x) > 0 THEN corr(y, x) END AS r, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS ssr
    FROM win JOIN pts ON pts.k BETWEEN start AND start + width - 1 GROUP BY start, width)"""
#: Keeps rounded regressions clear of exact halves and of minus zero.
OFF = 1.3e-8
EVENTS = """span AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY 1)"""


def rectangles(r0: int, r1: int, c0: int, c1: int, lo: int, hi: int):
    """Worklist form of the bisection, for the multi_value oracle."""
    work, out = [(r0, r1, c0, c1, lo, hi)], []
    while work:
        a, b, c, d, v, w = work.pop()
        if w - v == 1 or (b - a) * (d - c) == 1:
            out.append((a, b, c, d, v))
        elif b - a > d - c:
            work += [(a, (a + b) // 2, c, d, v, (v + w) // 2), ((a + b) // 2, b, c, d, (v + w) // 2, w)]
        else:
            work += [(a, b, c, (c + d) // 2, v, (v + w) // 2), (a, b, (c + d) // 2, d, (v + w) // 2, w)]
    return out


_M = ", ".join(str(r) for r in rectangles(0, 100, 0, 100, 0, 25))
_M2 = ", ".join(str(r) for r in rectangles(0, 96, 0, 64, 0, 60))

ORACLES: dict[str, str] = {
    "unique_values": f"WITH {E}, {L} SELECT DISTINCT 'E' AS raster, v FROM e UNION ALL SELECT DISTINCT 'L', v FROM l",
    "category_histogram": f"WITH {E} SELECT v, count(*) AS cells FROM e GROUP BY v",
    "category_cells": f"WITH {L} SELECT i, j FROM l WHERE v = 3",
    "cells_in_rectangle": f"WITH {E} SELECT i, j, v FROM e WHERE i >= 10 AND i < 90 AND j >= 5 AND j < 41",
    "hash_pattern": f"WITH {H} SELECT i, j, v FROM h",
    "linear_index": f"WITH {H} SELECT i, j, i * 512 + j AS n FROM h",
    "blocked_index": f"WITH {H} SELECT i, j, n - n % 1024 + n % 1024 // 32 + n % 1024 % 32 * 32 AS n FROM (SELECT i, j, i * 512 + j AS n FROM h)",
    "full_blocked_index": f"WITH {H}, b AS (SELECT i, j, (i // 32 * 16 + j // 32) * 1024 + i % 32 * 32 + j % 32 AS n FROM h) SELECT i, j, n, i AS i2, j AS j2 FROM b",
    "morton_encode": f"WITH {H} SELECT i, j, {morton('i', 'j', 10)} AS n FROM h",
    "morton_decode": f"WITH {H} SELECT {morton('i', 'j', 10)} AS n, i, j FROM h",
    "morton_neighbors": f"WITH {H} SELECT {morton('i', 'j', 10)} AS n, {morton('(i + 1)', 'j', 10)} AS up_i, {morton('i', '(j + 1)', 10)} AS up_j, {morton('(i + j)', '(2 * j)', 12)} AS plus FROM h",
    "location_code_digits": f"WITH {H}, c AS (SELECT {morton('i', 'j', 9)} AS code FROM h) SELECT code, "
    + " || ".join(f"((code >> {2 * k}) & 3)::VARCHAR" for k in range(8, -1, -1))
    + " AS digits, code AS back FROM c",
    "quad_bbox": f"WITH {H} SELECT {morton('(i // s * s)', '(j // s * s)', 9)} AS code, level, i // s * s AS x0, j // s * s AS y0, i // s * s + s AS x1, j // s * s + s AS y1 FROM h CROSS JOIN (SELECT unnest([3, 6, 9]) AS level) CROSS JOIN LATERAL (SELECT (512 >> level)::BIGINT AS s) GROUP BY ALL",
    "schrack_neighbor": f"WITH {H} SELECT {morton('i', 'j', 9)} AS code, d, {morton('((i + dx + 512) % 512)', '((j + dy + 512) % 512)', 9)} AS neighbor FROM h CROSS JOIN (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)) AS t(d, dx, dy)",
    "resize_tile": f"WITH {E}, d AS (SELECT max(i) + 1 AS height FROM e), g AS (SELECT a.i, b.j FROM (SELECT unnest(range(0, (SELECT height + 10 FROM d))) AS i) a CROSS JOIN (SELECT unnest(range(0, 100)) AS j) b) SELECT g.i, g.j, e.v FROM g CROSS JOIN d JOIN e ON e.i = g.i % d.height AND e.j = g.j % 64",
    "resize_crop": f"WITH {E} SELECT i, j, v FROM e WHERE i < 100 AND j < 40",
    "flip_transpose": f"WITH {E} SELECT j AS i, (SELECT max(i) FROM e) - i AS j, v FROM e",
    "neighbor_edges": f"WITH {L}, {cells('l', W_L)} SELECT a.n AS s, b.n AS t FROM cells a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(di, dj), cells b WHERE b.i = a.i + di AND b.j = a.j + dj",
    "neighbor_degree": f"WITH {L}, {cells('l', W_L)} SELECT degree, count(*) AS cells FROM (SELECT a.n, count(*) AS degree FROM cells a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(di, dj), cells b WHERE b.i = a.i + di AND b.j = a.j + dj GROUP BY a.n) GROUP BY degree",
    "same_value_edges": f"WITH {E}, {cells('e', W_E)} SELECT s, t FROM edges",
    "right_edges_window": f"WITH {E}, {cells('e', W_E)} SELECT a.n AS s, b.n AS t FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j + 1 AND b.v = a.v",
    "tolerant_edges": f"WITH {E}, {cells('e', W_E)} SELECT a.n AS s, b.n AS t FROM cells a JOIN cells b ON ((b.i = a.i AND b.j = a.j + 1) OR (b.i = a.i + 1 AND b.j = a.j)) WHERE abs(a.v - b.v) <= 1".replace(
        "FROM cells a JOIN cells b ON ((b.i = a.i AND b.j = a.j + 1) OR (b.i = a.i + 1 AND b.j = a.j)) WHERE", "FROM cells a, (VALUES (0, 1), (1, 0)) AS o(di, dj), cells b WHERE b.i = a.i + di AND b.j = a.j + dj AND"
    ),
    "tile_seams": f"WITH {SEAMS} SELECT a, b, vertical, line, lo, hi FROM seams",
    "seam_cell_edges": f"WITH {SEAMS} SELECT CASE WHEN vertical THEN k * 64 + line - 1 ELSE (line - 1) * 64 + k END AS s, CASE WHEN vertical THEN k * 64 + line ELSE line * 64 + k END AS t FROM (SELECT *, unnest(range(lo, hi)) AS k FROM seams)",
    "seam_value_edges": f"WITH {E}, {cells('e', W_E)} SELECT s, t FROM edges JOIN cells a ON a.n = s JOIN cells b ON b.n = t WHERE a.i // 32 <> b.i // 32 OR a.j // 32 <> b.j // 32",
    "tile_adjacency": f"WITH {RECTS} SELECT a.bi AS ai, a.bj AS aj, b.bi, b.bj FROM rects a JOIN rects b ON (b.bi = a.bi AND b.bj = a.bj + 1) OR (b.bi = a.bi + 1 AND b.bj = a.bj)",
    "row_runs": f"WITH {RUNS} SELECT i, j0, j1, v FROM runs",
    "run_overlaps": f"WITH {RUNS} SELECT a.i, a.j0, b.j0 AS below FROM runs a JOIN runs b ON b.i = a.i + 1 AND b.v = a.v WHERE a.j0 <= b.j1 AND b.j0 <= a.j1",
    "seen_neighbors": f"WITH {E}, {cells('e', W_E)} SELECT DISTINCT t AS n FROM edges",
    "multi_value": f"SELECT i, j, v::INTEGER AS v FROM (SELECT c0, c1, v, unnest(range(r0, r1))::BIGINT AS i FROM (VALUES {_M}) AS t(r0, r1, c0, c1, v)) CROSS JOIN LATERAL (SELECT unnest(range(c0, c1))::BIGINT AS j)",
    "storage_orders": f"""WITH m AS (SELECT i, j, v::INTEGER AS v FROM (SELECT c0, c1, v, unnest(range(r0, r1))::BIGINT AS i FROM (VALUES {_M2}) AS t(r0, r1, c0, c1, v)) CROSS JOIN LATERAL (SELECT unnest(range(c0, c1))::BIGINT AS j))
      SELECT i, j, v, i * 64 + j AS linear, (i * 64 + j) // 1024 * 1024 + (i * 64 + j) % 1024 // 32 + (i * 64 + j) % 32 * 32 AS blocked, (i // 32 * 2 + j // 32) * 1024 + i % 32 * 32 + j % 32 AS full_blocked, {morton('i', 'j', 7)} AS morton FROM m""",
    "quad_children": f"SELECT c AS code, q::INTEGER AS quarter, c + q * 16 AS child FROM (SELECT 64 * {morton('i', 'j', 6)} AS c FROM (SELECT unnest(range(0, 64)) AS i) CROSS JOIN (SELECT unnest(range(0, 64)) AS j)) CROSS JOIN (SELECT unnest(range(0, 4)) AS q)",
    "pgm_lines": f"WITH {L} SELECT height - i AS place, string_agg(v::VARCHAR, ' ' ORDER BY j) AS line FROM l CROSS JOIN dim GROUP BY height, i UNION ALL SELECT 0, 'P2 50 ' || height::VARCHAR || ' 3' FROM dim",
    "run_text": "SELECT test, test || chr(9) || string_agg('1 ' || user_id::VARCHAR, ' ' ORDER BY event_id) AS line FROM (SELECT event_type || '@' || user_id::VARCHAR AS test, * FROM events) GROUP BY 1",
    "largest_clusters": f"{LL} SELECT v, cluster_id, count(*) AS size FROM lab GROUP BY ALL ORDER BY size DESC, cluster_id LIMIT 10",
    "running_events": "SELECT event_type, day, events, coalesce(sum(events) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS events FROM events GROUP BY 1, 2)",
    "cluster_labels": f"{EL} SELECT n, v, cluster_id FROM lab",
    "cluster_labels_tiled": f"{LL} SELECT n, v, cluster_id FROM lab",
    "cluster_labels_runs": f"{EL} SELECT n, v, cluster_id FROM lab",
    "cluster_coords": f"{LL} SELECT cluster_id // 50 AS rep_i, cluster_id % 50 AS rep_j, i, j FROM lab",
    "cluster_members": f"{LL} SELECT cluster_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS members FROM lab GROUP BY cluster_id",
    "cluster_at": f"{LL} SELECT n FROM lab WHERE cluster_id = (SELECT DISTINCT cluster_id FROM lab ORDER BY 1 LIMIT 1 OFFSET 100)",
    "cluster_ranks": f"{LL} SELECT row_number() OVER (ORDER BY cluster_id) - 1 AS k, cluster_id FROM (SELECT DISTINCT cluster_id FROM lab)",
    "cluster_count": f"{EL} SELECT v, count(DISTINCT cluster_id) AS clusters FROM lab GROUP BY ROLLUP (v)",
    "cluster_sizes": f"{LL} SELECT v, cluster_id, count(*) AS size FROM lab GROUP BY ALL",
    "size_distribution": f"""{EL}, s AS (SELECT v, cluster_id, count(*) AS size FROM lab GROUP BY ALL), m AS (SELECT v, max(size) AS hi FROM s GROUP BY v),
      d AS (SELECT v, unnest(range(1, hi + 1)) AS bin FROM m) SELECT d.v, d.bin, (SELECT count(*) FROM s WHERE s.v = d.v AND s.size = d.bin) AS clusters, (SELECT count(*) FROM s WHERE s.v = d.v AND s.size < d.bin) AS before FROM d""",
    "patch_metrics": f"""{LL}, area AS (SELECT v, cluster_id, count(*) AS area FROM lab GROUP BY ALL),
      inner_ AS (SELECT a.cluster_id, count(*) AS edges FROM edges JOIN lab a ON a.n = s GROUP BY 1),
      types AS (SELECT a.cluster_id, count(DISTINCT b.v) AS types FROM lab a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(di, dj), lab b WHERE b.i = a.i + di AND b.j = a.j + dj AND b.v <> a.v GROUP BY 1)
      SELECT v, cluster_id, area, 4 * area - 2 * coalesce(edges, 0) AS perimeter, round((4 * area - 2 * coalesce(edges, 0) + 2 * (area - 1)) / 4.0::DOUBLE, 9) AS mod_perimeter,
        round((4 * area - 2 * coalesce(edges, 0) + 2 * (area - 1) * coalesce(types, 0) / 14.0::DOUBLE) / 4.0::DOUBLE, 9) AS div_perimeter FROM area LEFT JOIN inner_ USING (cluster_id) LEFT JOIN types USING (cluster_id)""",
    "patch_edges": f"{LL} SELECT a.cluster_id, count(*) AS edges FROM edges JOIN lab a ON a.n = s GROUP BY 1",
    "border_types": f"{LL} SELECT a.cluster_id, count(DISTINCT b.v) AS types FROM lab a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(di, dj), lab b WHERE b.i = a.i + di AND b.j = a.j + dj AND b.v <> a.v GROUP BY 1",
    "category_graph": f"WITH {L}, {cells('l', W_L)} SELECT s, t FROM edges JOIN cells ON n = s WHERE v = 2 UNION ALL SELECT n, NULL FROM cells WHERE v = 2",
    "box_count": f"WITH {BOXES} SELECT v, eps, round(height::DOUBLE / nx, 9) AS boxsize, count(*) AS boxes, round(log10(height::DOUBLE / nx), 9) AS log_boxsize, round(log10(count(*)), 9) AS log_boxes FROM boxes CROSS JOIN dim GROUP BY v, eps, nx, height",
    "box_count_scaled": f"""WITH {L}, b AS (SELECT DISTINCT v, lv AS level, floor(i * lv / height::DOUBLE) AS bx, floor(j * lv / 50.0::DOUBLE) AS by FROM l CROSS JOIN dim CROSS JOIN (SELECT unnest([2, 4, 8, 16, 32])::BIGINT AS lv))
      SELECT v, level, round(1.0::DOUBLE / level, 9) AS division, count(*) AS boxes, round(ln(count(*)), 9) AS log_boxes, round(ln(level), 9) AS log_level, round(ln(count(*)) / ln(level), 9) AS ratio FROM b GROUP BY v, level""",
    "mass_exponent": f"WITH {BOXES} SELECT v, eps, q, round(sum(pow(mass::DOUBLE, q)), 6) AS value FROM boxes CROSS JOIN (SELECT unnest([-1.0, 0.0, 1.0, 2.0])::DOUBLE AS q) GROUP BY v, eps, q",
    "box_entropy": f"""WITH {BOXES}, t AS (SELECT v, eps, sum(mass)::DOUBLE AS total FROM boxes GROUP BY v, eps), f AS (SELECT b.v, b.eps, mass, total, height::DOUBLE * 50.0::DOUBLE / nx / ny AS cell FROM boxes b JOIN t ON t.v = b.v AND t.eps = b.eps CROSS JOIN dim)
      SELECT v, eps, round(sqrt(cell), 9) AS scale, round(sum(mass / cell * ln(mass / cell)), 6) AS entropy, round(-sum(mass / total * ln(mass / total)), 6) AS shannon FROM f GROUP BY v, eps, cell""",
    "fractal_dimension": f"WITH {BOXES}, c AS (SELECT v, eps, log10(height::DOUBLE / nx) AS lx, log10(count(*)) AS ly FROM boxes CROSS JOIN dim GROUP BY v, eps, nx, height) SELECT v, round(-regr_slope(ly, lx), 9) AS dimension, round(regr_r2(ly, lx), 9) AS r2, count(*) AS scales FROM c GROUP BY v",
    "window_regression": f"WITH {MONTHS} SELECT start, width, round(slope + {OFF}::DOUBLE, 6) AS slope, round(intercept + {OFF}::DOUBLE, 6) AS intercept, round(r + {OFF}::DOUBLE, 6) AS r, round(ssr + {OFF}::DOUBLE, 6) AS ssr, round(ssr / width + {OFF}::DOUBLE, 6) AS mssr FROM fit",
    "best_linear_window": f"WITH {MONTHS} SELECT start, width, round(slope + {OFF}::DOUBLE, 6) AS slope, round(r + {OFF}::DOUBLE, 6) AS r FROM fit WHERE r IS NOT NULL ORDER BY round(ssr / width, 9), round(r, 9) DESC, start, width DESC LIMIT 1",
    "quadtree_leaves": f"WITH {QUAD} SELECT code, level, color FROM leaves",
    "quadtree_neighbors": f"WITH {QUAD} SELECT code, level, d::INTEGER AS d, to_code, to_level, to_color FROM met",
    "quadtree_level_diff": f"""WITH {QUAD}, df AS (SELECT s.code, s.level, s.d, coalesce(m.to_level - s.level, 1) AS diff FROM sides s LEFT JOIN met m ON m.code = s.code AND m.level = s.level AND m.d = s.d)
      SELECT l.code, l.level, l.color, {", ".join(f"max(CASE WHEN d = {k} THEN diff END)::INTEGER AS {n}" for k, n in enumerate(("east", "north", "west", "south")))} FROM leaves l LEFT JOIN df ON df.code = l.code AND df.level = l.level GROUP BY ALL""",
    "quadtree_components": f"""WITH RECURSIVE {QUAD}, pr AS MATERIALIZED (SELECT code AS s, to_code AS t FROM met WHERE color = to_color UNION ALL SELECT to_code, code FROM met WHERE color = to_color),
      reach(n, l) USING KEY (n) AS (SELECT code, code FROM leaves UNION SELECT x.t, x.m FROM (SELECT pr.t, min(reach.l) AS m FROM reach JOIN pr ON pr.s = reach.n GROUP BY pr.t) x JOIN recurring.reach rr ON rr.n = x.t WHERE x.m < rr.l)
      SELECT code, level, color, l AS component FROM leaves JOIN reach ON n = code""",
    "quadtree_locate": f"WITH {QUAD} SELECT code, level, color FROM boxed WHERE 100 BETWEEN x0 AND x0 + side - 1 AND 25 BETWEEN y0 AND y0 + side - 1",
    "block_colors": f"WITH {E} SELECT i // 8 AS bx, j // 8 AS by, CASE WHEN bool_and(v = 1) THEN 'black' WHEN bool_or(v = 1) THEN 'gray' ELSE 'white' END AS color FROM e GROUP BY 1, 2",
    "series_stats": "SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS stdev FROM events GROUP BY 1",
    "series_histogram": f"WITH {EVENTS} SELECT event_type, bin, round(lo + bin * w, 9) AS lo, round(lo + (bin + 1) * w, 9) AS hi, count(*) AS count FROM (SELECT e.event_type, lo, (hi - lo) / 100 AS w, least(floor((value - lo) / ((hi - lo) / 100)), 99)::BIGINT AS bin FROM events e JOIN span s ON s.event_type = e.event_type WHERE value IS NOT NULL) GROUP BY event_type, bin, lo, w",
    "series_clip": "SELECT event_id, event_type, value FROM events WHERE value > 1 AND value < 50",
    "pairwise_t": "WITH m AS (SELECT event_type AS k, count(value) AS n, avg(value) AS m, var_samp(value) AS s FROM events GROUP BY 1) SELECT a.k AS a, b.k AS b, round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 9) AS t, a.n + b.n - 2 AS df FROM m a JOIN m b ON a.k <> b.k",
    "run_catalog": "WITH run AS (SELECT user_id, min(ts) AS started, arg_min(event_type, (ts, event_id)) AS build FROM events GROUP BY 1), build AS (SELECT event_type AS build, count(*) AS events FROM events GROUP BY 1) SELECT row_number() OVER (ORDER BY started, user_id) - 1 AS idx, user_id, build, events FROM run JOIN build USING (build)",
    "merge_keep_first": f"WITH {E}, {cells('e', W_E)} SELECT n, v FROM cells WHERE j < 40 UNION ALL SELECT n, v + 10 FROM cells WHERE j >= 40",
    "cell_stream_counts": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, (user_id % 4)::INTEGER AS v, count(*) AS cells FROM events GROUP BY 1, 2",
}
