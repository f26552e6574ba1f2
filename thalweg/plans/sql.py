"""Shared SQL of the oracles, in layers of common table expressions over the test tables.

Everything is written independently of the plans: closures are recursive queries here, pointer doubling there.
"""

CELLS = """
cells AS (
  SELECT 'b' || CAST(vec_id // 125 AS VARCHAR) AS basin, (vec_id % 125) * 64 + (i - 1) AS cell_id, vec_id % 125 AS r, i - 1 AS c, CAST(z AS DOUBLE) AS z
  FROM (SELECT vec_id, unnest(embedding) AS z, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS i FROM embeddings))"""

NEIGHBOURS = """
nb(dr, dc) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
around AS (SELECT basin, cell_id, r, c, z, dr, dc, cell_id + dr * 64 + dc AS n_id FROM cells, nb WHERE c + dc BETWEEN 0 AND 63)"""

FLOW = """
flow AS (
  SELECT basin, cell_id, n_id AS down_id FROM (
    SELECT a.basin, a.cell_id, a.n_id, row_number() OVER (PARTITION BY a.basin, a.cell_id
             ORDER BY (a.z - b.z) / sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) DESC, a.n_id) AS k
    FROM around a JOIN cells b ON b.basin = a.basin AND b.cell_id = a.n_id WHERE b.z < a.z) WHERE k = 1)"""

CLOSURE = """
clo(basin, cell_id, anc, d) AS (
  SELECT basin, cell_id, cell_id, 0 FROM cells
  UNION ALL SELECT p.basin, p.cell_id, f.down_id, p.d + 1 FROM clo p JOIN flow f ON f.basin = p.basin AND f.cell_id = p.anc),
area AS (SELECT basin, anc AS cell_id, count(*) AS area FROM clo GROUP BY 1, 2)"""

STREAMS = """
wet AS (SELECT basin, cell_id AS node_id FROM area WHERE area >= 3),
edges AS (SELECT f.basin, f.cell_id AS u, f.down_id AS v FROM flow f JOIN wet w ON w.basin = f.basin AND w.node_id = f.cell_id),
nodes AS (
  SELECT w.basin, w.node_id, w.node_id // 64 AS r, w.node_id % 64 AS c, coalesce(n_up, 0) = 0 AS is_head, coalesce(n_up, 0) >= 2 AS is_confluence, d.u IS NULL AS is_outlet
  FROM wet w LEFT JOIN (SELECT basin, v, count(*) AS n_up FROM edges GROUP BY 1, 2) x ON x.basin = w.basin AND x.v = w.node_id
  LEFT JOIN edges d ON d.basin = w.basin AND d.u = w.node_id)"""

WAYS = """
ways(basin, head, pos, node, via) AS (
  SELECT basin, node_id, 0, node_id, CAST(NULL AS BIGINT) FROM nodes WHERE is_head
  UNION ALL SELECT w.basin, w.head, w.pos + 1, e.v, w.node FROM ways w JOIN edges e ON e.basin = w.basin AND e.u = w.node),
roots AS (
  SELECT c.basin, c.cell_id AS node_id, c.anc AS outlet FROM clo c JOIN nodes n ON n.basin = c.basin AND n.node_id = c.cell_id
  JOIN nodes o ON o.basin = c.basin AND o.node_id = c.anc WHERE o.is_outlet)"""

PAIRS = """
pairs AS MATERIALIZED (
  SELECT DISTINCT x.basin, t.outlet, x.node AS confluence, x.head AS head_1, y.head AS head_2
  FROM ways x JOIN ways y ON y.basin = x.basin AND y.node = x.node AND x.head < y.head AND x.via <> y.via
  JOIN nodes n ON n.basin = x.basin AND n.node_id = x.node AND n.is_confluence
  JOIN roots t ON t.basin = x.basin AND t.node_id = x.node)"""

HEAD_CELLS = """
head_cells AS (SELECT c.basin, c.anc AS head, c.cell_id FROM clo c JOIN nodes n ON n.basin = c.basin AND n.node_id = c.anc AND n.is_head)"""

GATES = """
placed AS (SELECT p.*, head_1 // 64 AS r1, head_1 % 64 AS c1, head_2 // 64 AS r2, head_2 % 64 AS c2 FROM pairs p),
spans AS (SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS m, least(abs(r2 - r1), abs(c2 - c1)) AS k, abs(r2 - r1) > abs(c2 - c1) AS by_row FROM placed),
inside AS (
  SELECT basin, head_1, head_2,
         r1 + sign(r2 - r1) * (CASE WHEN by_row THEN i ELSE (2 * k * i + m) // (2 * m) END) AS r,
         c1 + sign(c2 - c1) * (CASE WHEN by_row THEN (2 * k * i + m) // (2 * m) ELSE i END) AS c
  FROM (SELECT *, unnest(range(1, m)) AS i FROM spans)),
crossing AS (SELECT DISTINCT i.basin, i.head_1, i.head_2 FROM inside i JOIN nodes n ON n.basin = i.basin AND n.r = i.r AND n.c = i.c)"""

COUPLING = """
contact AS (
  SELECT a.basin, a.head AS head_1, b.head AS head_2, count(*) AS n
  FROM head_cells a JOIN around s ON s.basin = a.basin AND s.cell_id = a.cell_id JOIN head_cells b ON b.basin = s.basin AND b.cell_id = s.n_id
  WHERE a.head < b.head GROUP BY 1, 2, 3),
sizes AS (SELECT basin, head, count(*) AS size FROM head_cells GROUP BY 1, 2),
coupling AS MATERIALIZED (
  SELECT p.basin, p.outlet, p.confluence, p.head_1, p.head_2,
         NOT far AND coalesce(n, 0) > 0 AS touching, CASE WHEN far THEN 0 ELSE coalesce(n, 0) END AS contact_px,
         CASE WHEN NOT far THEN s1.size END AS size1_px, CASE WHEN NOT far THEN s2.size END AS size2_px, far AS skipped_prefilter
  FROM (SELECT *, NOT sqrt(CAST((r1 - r2) * (r1 - r2) + (c1 - c2) * (c1 - c2) AS DOUBLE)) <= 2.0 * sqrt(3.0) AS far FROM placed) p
  ANTI JOIN crossing x ON x.basin = p.basin AND x.head_1 = p.head_1 AND x.head_2 = p.head_2
  LEFT JOIN contact t ON t.basin = p.basin AND t.head_1 = p.head_1 AND t.head_2 = p.head_2
  LEFT JOIN sizes s1 ON s1.basin = p.basin AND s1.head = p.head_1 LEFT JOIN sizes s2 ON s2.basin = p.basin AND s2.head = p.head_2)"""

LENGTHS = """
steps AS (SELECT basin, u, v, sqrt(CAST((u // 64 - v // 64) * (u // 64 - v // 64) + (u % 64 - v % 64) * (u % 64 - v % 64) AS DOUBLE)) AS d FROM edges),
downhill(basin, node_id, spot, d) AS (
  SELECT basin, node_id, node_id, CAST(0.0 AS DOUBLE) FROM nodes
  UNION ALL SELECT p.basin, p.node_id, s.v, p.d + s.d FROM downhill p JOIN steps s ON s.basin = p.basin AND s.u = p.spot),
updist AS MATERIALIZED (SELECT basin, node_id, max(d) AS up_dist FROM downhill GROUP BY 1, 2),
asymmetry AS MATERIALIZED (
  SELECT *, CASE WHEN L_1 + L_2 = 0 THEN 0.0 ELSE 2.0 * abs(L_1 - L_2) / (L_1 + L_2) END AS delta_L, 'meters' AS distance_unit FROM (
    SELECT p.basin, p.outlet, p.confluence, p.head_1, p.head_2, greatest(0.0, a.up_dist - c.up_dist) AS L_1, greatest(0.0, b.up_dist - c.up_dist) AS L_2
    FROM pairs p JOIN updist c ON c.basin || ':' || c.node_id = p.basin || ':' || p.confluence
    JOIN updist a ON a.basin || ':' || a.node_id = p.basin || ':' || p.head_1 JOIN updist b ON b.basin || ':' || b.node_id = p.basin || ':' || p.head_2))"""

#: Levels of the network (longest way from a head) that the unrolled Strahler query reaches.
LEVELS = 12


def _strahler() -> str:
    out = ["""
lvl AS (SELECT w.basin, w.node AS node_id, max(w.pos) AS level FROM ways w GROUP BY 1, 2),
s0 AS (SELECT basin, node_id, 1 AS strahler FROM lvl WHERE level = 0)"""]
    for k in range(1, LEVELS + 1):
        out.append(f"""
s{k} AS (
  SELECT * FROM s{k - 1} UNION ALL
  SELECT basin, node_id, max(strahler) + CASE WHEN count(*) FILTER (strahler = top) >= 2 THEN 1 ELSE 0 END FROM (
    SELECT l.basin, l.node_id, s.strahler, max(s.strahler) OVER (PARTITION BY l.basin, l.node_id) AS top
    FROM lvl l JOIN edges e ON e.basin = l.basin AND e.v = l.node_id JOIN s{k - 1} s ON s.basin = e.basin AND s.node_id = e.u WHERE l.level = {k})
  GROUP BY 1, 2)""")
    return ",".join(out) + f", strahler AS (SELECT * FROM s{LEVELS})"


STRAHLER = _strahler()

GEOMETRY = """
pts AS (
  SELECT p.basin, p.outlet, p.confluence, p.head_1, p.head_2, s.side, w.pos, e.pos AS last, w.node % 64 + 0.0 AS x, -(w.node // 64) + 0.0 AS y
  FROM pairs p CROSS JOIN (VALUES (1), (2)) s(side)
  JOIN ways e ON e.basin = p.basin AND e.head = CASE s.side WHEN 1 THEN p.head_1 ELSE p.head_2 END AND e.node = p.confluence
  JOIN ways w ON w.basin = p.basin AND w.head = e.head AND w.pos <= e.pos),
seg AS (
  SELECT *, coalesce(sum(edge) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS so_far, sum(edge) OVER (PARTITION BY basin, outlet, confluence, head_1, head_2, side) AS total FROM (
    SELECT *, lead(x) OVER g AS xn, lead(y) OVER g AS yn, coalesce(sqrt((lead(x) OVER g - x) * (lead(x) OVER g - x) + (lead(y) OVER g - y) * (lead(y) OVER g - y)), 0.0) AS edge
    FROM pts WINDOW g AS (PARTITION BY basin, outlet, confluence, head_1, head_2, side ORDER BY pos))
  WINDOW g AS (PARTITION BY basin, outlet, confluence, head_1, head_2, side ORDER BY pos)),
turn AS (
  SELECT basin, outlet, confluence, head_1, head_2, side, count(*) FILTER (so_far < 3.0 AND xn IS NOT NULL) + 1 AS n,
         sum((xn - x) * edge) FILTER (so_far < 3.0 AND xn IS NOT NULL) / sum(edge) FILTER (so_far < 3.0 AND xn IS NOT NULL) AS dx,
         sum((yn - y) * edge) FILTER (so_far < 3.0 AND xn IS NOT NULL) / sum(edge) FILTER (so_far < 3.0 AND xn IS NOT NULL) AS dy
  FROM seg GROUP BY ALL),
turned AS MATERIALIZED (
  SELECT *, CASE WHEN abs(dx) >= 1e-10 OR abs(dy) >= 1e-10 THEN degrees(atan2(dx, dy)) + CASE WHEN degrees(atan2(dx, dy)) < 0 THEN 360.0 ELSE 0.0 END END AS az,
         CASE WHEN n < 2 THEN 'single_edge' WHEN n < 4 THEN 'short_path' END AS flag FROM turn),
resampled AS MATERIALIZED (
  SELECT basin, outlet, confluence, head_1, head_2, side, k,
         x + ((k / 10.0) - so_far / total) / (edge / total) * (xn - x) AS px, y + ((k / 10.0) - so_far / total) / (edge / total) * (yn - y) AS py
  FROM seg CROSS JOIN range(10) t(k) WHERE xn IS NOT NULL AND so_far / total <= k / 10.0 AND k / 10.0 < (so_far + edge) / total),
prox AS MATERIALIZED (
  SELECT a.basin, a.outlet, a.confluence, a.head_1, a.head_2, avg(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py))) AS p_mean,
         max(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py))) AS p_max
  FROM resampled a JOIN resampled b USING (basin, outlet, confluence, head_1, head_2, k) WHERE a.side = 1 AND b.side = 2 GROUP BY ALL),
geometry AS MATERIALIZED (
  SELECT p.basin, p.outlet, p.confluence, p.head_1, p.head_2,
         CASE WHEN abs(t1.az - t2.az) > 180 THEN 360 - abs(t1.az - t2.az) ELSE abs(t1.az - t2.az) END AS orientation_diff_deg,
         sqrt(ex * ex + ey * ey) AS headhead_dist_m, sqrt(ex * ex + ey * ey) / nullif(L_1 + L_2, 0) AS headhead_dist_norm,
         degrees(acos(greatest(-1.0, least(1.0, (ax * gx + ay * gy) / (sqrt(ax * ax + ay * ay) * sqrt(gx * gx + gy * gy)))))) AS apex_angle_deg,
         CAST(abs(o1.strahler - o2.strahler) AS DOUBLE) AS strahler_order_diff,
         p_mean AS proximity_mean_m, p_max AS proximity_max_m, p_mean / nullif(p_max, 0) AS proximity_profile_norm,
         concat_ws(',', 'orient1:' || t1.flag, 'orient2:' || t2.flag) AS qc_flags
  FROM (SELECT *, (head_2 % 64 - head_1 % 64) + 0.0 AS ex, (head_2 // 64 - head_1 // 64) + 0.0 AS ey, (head_1 % 64 - confluence % 64) + 0.0 AS ax, (confluence // 64 - head_1 // 64) + 0.0 AS ay,
               (head_2 % 64 - confluence % 64) + 0.0 AS gx, (confluence // 64 - head_2 // 64) + 0.0 AS gy FROM pairs) p
  JOIN asymmetry USING (basin, outlet, confluence, head_1, head_2)
  JOIN turned t1 ON t1.basin = p.basin AND t1.confluence = p.confluence AND t1.head_1 = p.head_1 AND t1.head_2 = p.head_2 AND t1.side = 1
  JOIN turned t2 ON t2.basin = p.basin AND t2.confluence = p.confluence AND t2.head_1 = p.head_1 AND t2.head_2 = p.head_2 AND t2.side = 2
  JOIN prox q ON q.basin = p.basin AND q.confluence = p.confluence AND q.head_1 = p.head_1 AND q.head_2 = p.head_2
  JOIN ways v1 ON v1.basin = p.basin AND v1.head = p.head_1 AND v1.node = p.confluence JOIN strahler o1 ON o1.basin = p.basin AND o1.node_id = v1.via
  JOIN ways v2 ON v2.basin = p.basin AND v2.head = p.head_2 AND v2.node = p.confluence JOIN strahler o2 ON o2.basin = p.basin AND o2.node_id = v2.via)"""

LABELLED = """
labelled AS (
  SELECT c.basin, c.outlet, c.confluence, c.head_1, c.head_2, c.touching, c.contact_px, c.size1_px, c.size2_px, c.skipped_prefilter, CAST(c.touching AS INT) AS y,
         a.L_1, a.L_2, a.delta_L, g.orientation_diff_deg, g.headhead_dist_m, g.headhead_dist_norm, g.apex_angle_deg, g.strahler_order_diff,
         g.proximity_mean_m, g.proximity_max_m, g.proximity_profile_norm, g.qc_flags
  FROM coupling c LEFT JOIN asymmetry a USING (basin, outlet, confluence, head_1, head_2) LEFT JOIN geometry g USING (basin, outlet, confluence, head_1, head_2))"""

LAYERS = [CELLS, NEIGHBOURS, FLOW, CLOSURE, STREAMS, WAYS, PAIRS, HEAD_CELLS, GATES, COUPLING, LENGTHS]


def over(*layers: str, select: str) -> str:
    """A query over some layers, in their order."""
    return "WITH RECURSIVE " + ",".join(layers) + "\n" + select


TO_STREAMS = LAYERS[:5]
TO_PAIRS = LAYERS[:7]
ALL = [*LAYERS, STRAHLER, GEOMETRY, LABELLED]
