"""DuckDB SQL of the query catalogue, over the same tables."""

from __future__ import annotations

VIEWS = """
pt AS (SELECT vec_id AS id, label, 60 * embedding[1]::DOUBLE AS x, 60 * embedding[2]::DOUBLE AS y, 60 * embedding[3]::DOUBLE AS z FROM embeddings),
ob AS (SELECT * FROM pt WHERE label < 2),
od AS (SELECT p.id, min(sqrt((p.x-o.x)*(p.x-o.x)+(p.y-o.y)*(p.y-o.y)+(p.z-o.z)*(p.z-o.z))) AS odist FROM pt p, ob o WHERE p.label >= 2 GROUP BY p.id),
sp AS (SELECT p.id, p.label AS segment_id, p.x, p.y, p.z, least(od.odist, 3.0) AS radius FROM pt p JOIN od ON od.id = p.id),
sf AS (SELECT * FROM sp WHERE radius >= 0.8),
pr AS (SELECT a.id AS src, b.id AS dst, a.segment_id AS s1, b.segment_id AS s2, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.radius AS r1, b.radius AS r2,
  (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM sf a, sf b WHERE a.id <> b.id),
e AS (SELECT src, dst, s1, s2, ax, ay, az, bx, by_, bz, sqrt(d2) AS dist, least(r1, r2) AS safety, r1, r2 FROM pr WHERE d2 < (r1+r2-0.2)*(r1+r2-0.2)),
ask AS (SELECT id AS pid, x + 1.5 AS x, y - 0.5 AS y, z + 0.25 AS z FROM ob),
cand AS (SELECT pid, s.id, segment_id, s.radius, sqrt((a.x-s.x)*(a.x-s.x)+(a.y-s.y)*(a.y-s.y)+(a.z-s.z)*(a.z-s.z)) AS d, a.x-s.x AS dx, a.y-s.y AS dy, a.z-s.z AS dz FROM ask a, sf s),
boxed AS (SELECT pid, id, segment_id, d - radius AS dist FROM cand WHERE abs(dx) <= 13 AND abs(dy) <= 13 AND abs(dz) <= 13),
mean AS (SELECT segment_id, count(*)::BIGINT AS n_keys, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM sf GROUP BY segment_id),
cen AS (SELECT m.segment_id, n_keys, cx, cy, cz, sqrt(max((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))) AS bounding_radius FROM mean m JOIN sf USING (segment_id) GROUP BY ALL),
por AS (SELECT DISTINCT least(s1, s2) AS id1, greatest(s1, s2) AS id2 FROM e WHERE s1 <> s2 AND s1 > 0 AND s2 > 0),
dd AS (SELECT segment_id, x - cx AS x, y - cy AS y, z - cz AS z, radius FROM sf JOIN mean USING (segment_id)),
traj AS (SELECT (user_id % 3)::INTEGER AS robot, ts, event_id, value / 10 AS x, (event_id % 100) / 5.0 AS y, length(event_type) / 2.0 AS z FROM events)
"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


def _fit() -> str:
    """Five unrolled rounds of the yaw search."""
    parts, step = ["f0 AS (SELECT DISTINCT segment_id, pi() / 4 AS alpha FROM dd)"], "pi() / 8"
    size = lambda a: f"max(abs(x * cos({a}) + y * sin({a}) + radius)) * max(abs(-x * sin({a}) + y * cos({a}) + radius))"
    for k in range(5):
        s = f"({step} / {1 << k})"
        parts.append(f"f{k + 1} AS (SELECT segment_id, CASE WHEN {size(f'(alpha - {s})')} <= {size(f'(alpha + {s})')} THEN alpha - {s} ELSE alpha + {s} END AS alpha FROM dd JOIN f{k} USING (segment_id) GROUP BY segment_id, alpha)")
    parts.append("fit AS (SELECT segment_id, alpha, max(abs(x * cos(alpha) + y * sin(alpha) + radius)) + 0.5 AS a, max(abs(-x * sin(alpha) + y * cos(alpha) + radius)) + 0.5 AS b, max(abs(z + radius)) + 0.5 AS c FROM dd JOIN f5 USING (segment_id) GROUP BY segment_id, alpha)")
    return ", ".join(parts)


FIT = _fit()
SENT = FIT + """, ends AS (SELECT id1 AS s FROM por UNION SELECT id2 FROM por),
dense AS (SELECT row_number() OVER (ORDER BY c.segment_id) - 1 AS idx, c.*, alpha, a, b, c AS cc FROM cen c JOIN fit f USING (segment_id) WHERE c.segment_id IN (FROM ends) OR n_keys >= 30),
code AS (SELECT idx, segment_id, cx, cy, cz, floor(255 * least(greatest((alpha % pi() + pi()) % pi() / pi(), 0), 1))::INTEGER AS alpha, floor(255 * least(a / 50, 1))::INTEGER AS a, floor(255 * least(b / 50, 1))::INTEGER AS b, floor(255 * least(cc / 50, 1))::INTEGER AS c FROM dense)"""
MEMBER = FIT + """, mem AS (SELECT o.id, segment_id, greatest(abs((x-cx)*cos(alpha)+(y-cy)*sin(alpha))/a, abs(-(x-cx)*sin(alpha)+(y-cy)*cos(alpha))/b, abs(z-cz)/c) AS m FROM ob o, (SELECT * FROM cen JOIN fit USING (segment_id)) f),
prob AS (SELECT id, segment_id, m, least(1, (1 - m) / 0.2) AS p FROM mem WHERE m < 1)"""
STEPS = """steps AS (SELECT p.id1 AS src, p.id2 AS dst, sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)) AS w FROM por p JOIN mean a ON a.segment_id = p.id1 JOIN mean b ON b.segment_id = p.id2),
both_ AS (SELECT src, dst, w FROM steps UNION ALL SELECT dst, src, w FROM steps)"""
#: Bellman rounds as many as there can be segments (labels 2 to 9).
ROUNDS = ", ".join(["d0 AS (SELECT segment_id AS s, CASE WHEN segment_id = 2 THEN 0.0::DOUBLE END AS d FROM mean)"] + [f"d{k + 1} AS MATERIALIZED (SELECT a.s, least(a.d, min(b.d + w)) AS d FROM d{k} a LEFT JOIN both_ ON dst = a.s LEFT JOIN d{k} b ON b.s = src GROUP BY a.s, a.d)" for k in range(8)])
TRACK = """tp AS (SELECT robot * 1000000 + (n // 20) AS path_id, n % 20 AS seq, x, y, z, 0.5 + (event_id % 40) / 10.0 AS odist FROM (SELECT *, row_number() OVER (PARTITION BY robot ORDER BY ts, event_id) - 1 AS n FROM traj)),
st AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)), 0) AS step, lag(seq) OVER w IS NULL AS first FROM tp WINDOW w AS (PARTITION BY path_id ORDER BY seq))"""
HEAT = "CASE floor({h} * 6) WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} ELSE {5} END"


def _heat(h: str) -> str:
    f = f"({h} * 6 - floor({h} * 6))"
    pick = lambda *v: HEAT.format(*v, h=h)
    red, green, blue = pick(1, f"1 - {f}", 0, 0, f, 1), pick(f, 1, 1, f"1 - {f}", 0, 0), pick(0, 0, f, 1, 1, f"1 - {f}")
    return f"round(({red})::DOUBLE, 4) + 0.0 AS r, round(({green})::DOUBLE, 4) + 0.0 AS g, round(({blue})::DOUBLE, 4) + 0.0 AS b"


def _q(sql: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}{', ' + more if more else ''} {sql}"


def _reach(edges: str, nodes: str, label: str = "component") -> str:
    return _q(f"SELECT x AS id, min(y) AS {label} FROM reach GROUP BY x", f"ed AS MATERIALIZED (SELECT src, dst FROM {edges}), reach AS (SELECT id AS x, id AS y FROM {nodes} UNION SELECT r.x, ed.dst FROM reach r JOIN ed ON ed.src = r.y)", True)


BOX = "abs(ax-bx) <= 3 AND abs(ay-by_) <= 3 AND abs(az-bz) <= 3"
KEY = "floor({} / 0.2)::BIGINT + 32768"

#: Distance of a point s to an obstacle o.
_D = "sqrt((s.x-o.x)*(s.x-o.x)+(s.y-o.y)*(s.y-o.y)+(s.z-o.z)*(s.z-o.z))"
#: The voxels: cor of obstacles and of the free cells cel around safe spheres.
_KEYS = ", ".join(f"{KEY.format(c)} AS k{c}" for c in "xyz")
CELLS = f"""obk AS MATERIALIZED (SELECT DISTINCT {_KEYS} FROM ob),
cel AS MATERIALIZED (SELECT kx, ky, kz, min(segment_id) AS region FROM (SELECT segment_id, kx + i AS kx, ky + j AS ky, kz + k AS kz FROM (SELECT segment_id, {_KEYS} FROM sf), range(-3, 4) a(i), range(-3, 4) b(j), range(-3, 4) c(k)) n WHERE NOT EXISTS (SELECT 1 FROM obk o WHERE o.kx = n.kx AND o.ky = n.ky AND o.kz = n.kz) GROUP BY ALL),
cor AS MATERIALIZED (SELECT kx, ky, kz, true AS occupied FROM obk UNION ALL SELECT kx, ky, kz, false FROM cel),
face(o, dx, dy, dz) AS (VALUES (0,1,0,0),(1,-1,0,0),(2,0,1,0),(3,0,-1,0),(4,0,0,1),(5,0,0,-1))"""
#: Pairs of cells side by side.
SIDES = CELLS + ", side AS MATERIALIZED (SELECT a.region, a.kx, a.ky, a.kz, b.region AS n_region, b.kx AS nkx, b.ky AS nky, b.kz AS nkz FROM (SELECT region, kx, ky, kz, kx + dx AS mx, ky + dy AS my, kz + dz AS mz FROM cel, face) a JOIN cel b ON b.kx = mx AND b.ky = my AND b.kz = mz)"
BORDERS = "SELECT a.region, a.kx, a.ky, a.kz, count(b.nkx) < 6 AS is_border FROM {c} a LEFT JOIN {s} b ON a.region = b.region AND a.region = b.n_region AND a.kx = b.kx AND a.ky = b.ky AND a.kz = b.kz GROUP BY 1, 2, 3, 4"
NEAR = "near AS (SELECT c.kx - dx AS kx, c.ky - dy AS ky, c.kz - dz AS kz, c.kx AS fkx, c.ky AS fky, c.kz AS fkz, o FROM cor c, face WHERE NOT occupied AND NOT EXISTS (SELECT 1 FROM cor u WHERE u.kx = c.kx - dx AND u.ky = c.ky - dy AND u.kz = c.kz - dz)), fro AS (SELECT kx, ky, kz, fkx, fky, fkz FROM near QUALIFY row_number() OVER (PARTITION BY kx, ky, kz ORDER BY o) = 1), coarse AS (SELECT kx // 4 * 4 AS kx, ky // 4 * 4 AS ky, kz // 4 * 4 AS kz, count(*)::BIGINT AS known FROM cor GROUP BY ALL HAVING count(*) < 64), scan AS (SELECT f.* FROM fro f WHERE EXISTS (SELECT 1 FROM coarse c WHERE c.kx = f.kx // 4 * 4 AND c.ky = f.ky // 4 * 4 AND c.kz = f.kz // 4 * 4))"


def _rays(rays: str) -> str:
    """CTEs of the voxels that rays (ray, ox .. tz) pass in order, and hits (ray, step, kind, last_free and key of the first that is not free)."""
    cut = lambda c: f"SELECT ray, (p - o{c} / 0.2::DOUBLE) / (t{c} / 0.2::DOUBLE - o{c} / 0.2::DOUBLE) AS t FROM (SELECT *, unnest(range(ceil(least(o{c} / 0.2::DOUBLE, t{c} / 0.2::DOUBLE))::BIGINT, floor(greatest(o{c} / 0.2::DOUBLE, t{c} / 0.2::DOUBLE))::BIGINT + 1)) AS p FROM rays WHERE o{c} <> t{c})"
    key = ", ".join(f"(floor((o{c} + (t{c} - o{c}) * s) / 0.2::DOUBLE) + 32768)::BIGINT AS k{c}" for c in "xyz")
    return f"""{CELLS}, rays AS MATERIALIZED ({rays}),
cuts AS (SELECT DISTINCT ray, t FROM (SELECT ray, 0.0::DOUBLE AS t FROM rays UNION ALL SELECT ray, 1.0::DOUBLE FROM rays UNION ALL {cut('x')} UNION ALL {cut('y')} UNION ALL {cut('z')}) WHERE t >= 0 AND t <= 1),
mid AS (SELECT ray, row_number() OVER w - 1 AS step, (t + lead(t) OVER w) / 2 AS s FROM cuts WINDOW w AS (PARTITION BY ray ORDER BY t) QUALIFY s IS NOT NULL),
passed AS MATERIALIZED (SELECT ray, step, {key} FROM mid JOIN rays USING (ray)),
hits AS (SELECT ray, min(step) FILTER (bad) AS step, arg_min(kind, step) FILTER (bad) AS kind, coalesce(min(step) FILTER (bad) - 1, max(step)) AS last_free, arg_min(kx, step) FILTER (bad) AS kx, arg_min(ky, step) FILTER (bad) AS ky, arg_min(kz, step) FILTER (bad) AS kz
  FROM (SELECT p.*, coalesce(c.occupied, true) AS bad, CASE WHEN c.occupied THEN 'occupied' ELSE 'unknown' END AS kind FROM passed p LEFT JOIN cor c ON c.kx = p.kx AND c.ky = p.ky AND c.kz = p.kz) GROUP BY ray)"""


def _look(reach: float, n: int = 24) -> str:
    """CTE seen (id, dx, dy, dz, kind): the ends of n even directions from every safe sphere."""
    made = f"dir AS MATERIALIZED (SELECT i, sqrt(1 - z * z) * cos(i * (pi() * (3 - sqrt(5.0::DOUBLE)))) AS dx, sqrt(1 - z * z) * sin(i * (pi() * (3 - sqrt(5.0::DOUBLE)))) AS dy, z AS dz FROM (SELECT i, 1 - (2 * i + 1) / {n}::DOUBLE AS z FROM range({n}) r(i)))"
    rays = f"SELECT {{'id': id, 'i': i}} AS ray, x AS ox, y AS oy, z AS oz, x + dx * {reach}::DOUBLE AS tx, y + dy * {reach}::DOUBLE AS ty, z + dz * {reach}::DOUBLE AS tz FROM sf, dir"
    return f"{made}, {_rays(rays)}, seen AS MATERIALIZED (SELECT ray.id AS id, d.*, kind FROM hits JOIN dir d ON d.i = ray.i)"


FRAGS = "fr AS (SELECT event_id, (user_id % 3)::INTEGER AS robot, ts FROM events), fg AS (SELECT event_id, robot, ts, event_id % 4 AS fragment_index, greatest(floor((row_number() OVER (PARTITION BY robot ORDER BY ts, event_id) - 1) / 6.0) - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, 0)::BIGINT AS message_index FROM fr)"

ORACLE = {
    "sphere_graph_summary": _q(f"SELECT segment_id, n_nodes, coalesce(n_edges, 0)::BIGINT AS n_edges, {_r('avg_radius', 'cx', 'cy', 'cz')} FROM (SELECT segment_id, count(*)::BIGINT AS n_nodes, avg(radius) AS avg_radius, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM sf GROUP BY 1) LEFT JOIN (SELECT s1 AS segment_id, count(*) AS n_edges FROM e GROUP BY 1) USING (segment_id)"),
    "obstacle_distance": _q(f"SELECT id, {_r('odist')} FROM od"),
    "safe_nodes": _q(f"SELECT id, segment_id, {_r('radius')} FROM sf"),
    "unsafe_nodes": _q(f"SELECT id, segment_id, {_r('radius')} FROM sp WHERE radius < 0.8"),
    "unsafety_cost": _q("SELECT id, round(pow(1 - least((radius - 0.8) / 2.2, 1), 2), 4) + 0.0 AS unsafety FROM sp"),
    "sphere_edges": _q(f"SELECT src, dst, {_r('dist', 'safety')} FROM e"),
    "sphere_edges_boxed": _q(f"SELECT src, dst, {_r('dist', 'safety')} FROM e WHERE {BOX}"),
    "edge_integrity": _q("SELECT (SELECT count(*) FROM e WHERE dst NOT IN (SELECT id FROM sf))::BIGINT AS dangling, (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src))::BIGINT AS one_way, (SELECT count(*) FROM e)::BIGINT AS n_edges"),
    "node_degree": _q("SELECT id, count(src)::BIGINT AS degree FROM sf LEFT JOIN e ON e.src = sf.id GROUP BY id"),
    "bbx_nodes": _q(f"SELECT id, kx, ky, kz FROM (SELECT id, {KEY.format('x')} AS kx, {KEY.format('y')} AS ky, {KEY.format('z')} AS kz FROM sp) WHERE kx BETWEEN 32728 AND 32808 AND ky BETWEEN 32728 AND 32808 AND kz BETWEEN 32728 AND 32808"),
    "bbx_segments": _q(f"SELECT segment_id, {_r('bounding_radius')} FROM cen WHERE abs(cx) < 5 + bounding_radius AND abs(cy) < 5 + bounding_radius AND abs(cz) < 5 + bounding_radius"),
    "point_in_map": _q("SELECT DISTINCT pid FROM cand WHERE d * d < (radius - 0.2) * (radius - 0.2)"),
    "nearest_node": _q(f"SELECT pid, id, {_r('dist')} FROM boxed QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, id) = 1"),
    "nearest_node_per_segment": _q(f"SELECT pid, segment_id, id, {_r('dist')}, row_number() OVER (PARTITION BY pid ORDER BY dist, segment_id)::BIGINT AS rank FROM (SELECT * FROM boxed WHERE dist <= 10 QUALIFY row_number() OVER (PARTITION BY pid, segment_id ORDER BY dist, id) = 1)"),
    "nearest_connectable": _q("SELECT pid, id, round(gap, 4) + 0.0 AS gap FROM (SELECT pid, id, d - radius - 1.0 AS gap FROM cand WHERE d * d < (1.0 + radius - 0.2) * (1.0 + radius - 0.2)) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY gap, id) = 1"),
    "safest_connection": _q(f"SELECT s1 AS seg, s2 AS other, src AS own_key, dst AS other_key, {_r('safety')} FROM (SELECT * FROM e WHERE s1 <> s2 AND s1 > 0 AND s2 > 0 QUALIFY row_number() OVER (PARTITION BY s1, s2 ORDER BY safety DESC, least(src, dst), greatest(src, dst)) = 1)"),
    "portals": _q("SELECT id1, id2 FROM por"),
    "segment_centroid_radius": _q(f"SELECT segment_id, n_keys, {_r('cx', 'cy', 'cz', 'bounding_radius')} FROM cen"),
    "segment_block_fit": _q(f"SELECT segment_id, {_r('alpha', 'a', 'b', 'c')} FROM fit", FIT),
    "merge_candidates": _q("""SELECT id1, id2, round(radius, 4) + 0.0 AS radius, radius <= 10 OR gap + r1 < 10 OR gap + r2 < 10 AS may_merge FROM (
      SELECT m.id1, m.id2, sqrt(max((s.x-m.cx)*(s.x-m.cx)+(s.y-m.cy)*(s.y-m.cy)+(s.z-m.cz)*(s.z-m.cz))) AS radius, any_value(sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz))) AS gap, any_value(a.bounding_radius) AS r1, any_value(b.bounding_radius) AS r2
      FROM (SELECT id1, id2, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM por JOIN sf ON segment_id IN (id1, id2) GROUP BY 1, 2) m JOIN sf s ON s.segment_id IN (m.id1, m.id2) JOIN cen a ON a.segment_id = m.id1 JOIN cen b ON b.segment_id = m.id2 GROUP BY 1, 2)"""),
    "component_labels": _reach("e", "sf"),
    "segment_parts": _reach("e WHERE s1 = s2", "sf"),
    "neighbor_connectivity": _q("SELECT ego AS id, count(DISTINCT c)::BIGINT AS n_parts FROM (SELECT ego, x, min(y) AS c FROM reach GROUP BY ego, x) GROUP BY ego", "ed AS MATERIALIZED (SELECT src, dst FROM e), ego AS MATERIALIZED (SELECT p.src AS ego, p.dst AS x, q.dst AS y FROM ed p JOIN ed q ON q.src = p.src JOIN ed l ON l.src = p.dst AND l.dst = q.dst), reach AS (SELECT src AS ego, dst AS x, dst AS y FROM ed UNION SELECT r.ego, r.x, g.y FROM reach r JOIN ego g ON g.ego = r.ego AND g.x = r.y)", True),
    "redundant_nodes": _q("SELECT DISTINCT src AS id FROM e WHERE r2 >= r1 - 0.2 AND dist < greatest(0.2, r2 / 1.5) AND src IN (SELECT ego FROM (SELECT ego, x, min(y) AS c FROM reach GROUP BY ego, x) GROUP BY ego HAVING count(DISTINCT c) = 1)", "ed AS MATERIALIZED (SELECT src, dst FROM e), ego AS MATERIALIZED (SELECT p.src AS ego, p.dst AS x, q.dst AS y FROM ed p JOIN ed q ON q.src = p.src JOIN ed l ON l.src = p.dst AND l.dst = q.dst), reach AS (SELECT src AS ego, dst AS x, dst AS y FROM ed UNION SELECT r.ego, r.x, g.y FROM reach r JOIN ego g ON g.ego = r.ego AND g.x = r.y)", True),
    "segment_distance_from_home": _q("SELECT s AS segment_id, round(coalesce(d, 10000.0), 4) + 0.0 AS dist, d IS NOT NULL AS connected FROM d8", f"{STEPS}, {ROUNDS}"),
    "frontier_value_spread": _q("SELECT s AS segment_id, round(CASE WHEN d < 12 THEN 1 - (d / 12) * (d / 12) ELSE 0 END, 4) + 0.0 AS value FROM d8", f"{STEPS}, {ROUNDS}"),
    "path_metrics": _q("SELECT path_id::BIGINT AS path_id, count(*)::BIGINT AS n, round(sum(step), 4) + 0.0 AS length, round(sum(CASE WHEN first THEN 0 ELSE pow(1 - least((odist - 0.8) / 2.2, 1), 2) END), 4) + 0.0 AS total_unsafety, round(min(odist)::DOUBLE, 4) + 0.0 AS min_odist FROM st GROUP BY path_id", TRACK),
    "path_safety_linear": _q("SELECT path_id::BIGINT AS path_id, round(sum(CASE WHEN odist < 1.6 THEN 1 - greatest((odist - 0.8) / (1.6 - 0.8), 0) ELSE 0 END)::DOUBLE, 4) + 0.0 AS linear_cost FROM st GROUP BY path_id", TRACK),
    "path_traversible": _q("SELECT path_id::BIGINT AS path_id, bool_and(NOT (run > 3 AND run < total - 3) OR odist >= 0.6) AS traversable FROM (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS run, sum(step) OVER (PARTITION BY path_id) AS total FROM st) GROUP BY path_id", TRACK),
    "voxel_frontier": _q("SELECT * FROM fro", CELLS + ", " + NEAR),
    "frontier_scan": _q("SELECT * FROM scan", CELLS + ", " + NEAR),
    "obstacles_with_frontier": _q("SELECT round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM (SELECT x, y, z FROM ob UNION ALL SELECT (kx - 32768 + 0.5) * 0.2::DOUBLE, (ky - 32768 + 0.5) * 0.2::DOUBLE, (kz - 32768 + 0.5) * 0.2::DOUBLE FROM scan)", CELLS + ", " + NEAR),
    "voxel_coarse_unknown": _q("SELECT kx // 4 * 4 AS kx, ky // 4 * 4 AS ky, kz // 4 * 4 AS kz, count(*)::BIGINT AS known FROM cor GROUP BY ALL HAVING count(*) < 64", CELLS),
    "voxel_key_roundtrip": _q("SELECT id, kx, ky, kz, kx // 4 * 4 AS kx14, round((kx - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS cx, round((ky - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS cy, round((kz - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS cz, round((kx // 4 * 4 - 32768 + 2.0) * 0.2::DOUBLE, 4) + 0.0 AS cx14 FROM (SELECT id, " + ", ".join(f"{KEY.format(c)} AS k{c}" for c in "xyz") + " FROM pt)"),
    "point_safe": _q("SELECT g.id, NOT bool_or(coalesce(c.occupied, true) AND pow((g.kx - 32768 + 0.5) * 0.2::DOUBLE - g.x, 2) + pow((g.ky - 32768 + 0.5) * 0.2::DOUBLE - g.y, 2) + pow((g.kz - 32768 + 0.5) * 0.2::DOUBLE - g.z, 2) < 0.25) AS safe FROM g LEFT JOIN cor c ON c.kx = g.kx AND c.ky = g.ky AND c.kz = g.kz GROUP BY g.id", CELLS + ", g AS (SELECT id, x, y, z, floor((x - 0.25) / 0.2)::BIGINT + 32768 + i AS kx, floor((y - 0.25) / 0.2)::BIGINT + 32768 + j AS ky, floor((z - 0.25) / 0.2)::BIGINT + 32768 + k AS kz FROM sf, range(4) a(i), range(4) b(j), range(4) c(k))"),
    "dense_box_points": _q("SELECT g.kx::INTEGER AS kx, g.ky::INTEGER AS ky, g.kz::INTEGER AS kz, round((g.kx - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS x, round((g.ky - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS y, round((g.kz - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS z, c.kx IS NULL AS is_unknown FROM (SELECT i + 32768 AS kx, j + 32768 AS ky, k + 32768 AS kz FROM range(-12, 13) a(i), range(-12, 13) b(j), range(-12, 13) c(k)) g LEFT JOIN cor c ON c.kx = g.kx AND c.ky = g.ky AND c.kz = g.kz WHERE coalesce(occupied, true)", CELLS),
    "occupied_voxel_points": _q("SELECT round((kx - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS x, round((ky - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS y, round((kz - 32768 + 0.5) * 0.2::DOUBLE, 4) + 0.0 AS z FROM cor WHERE occupied", CELLS),
    "ray_first_hit": _q("SELECT ray.id AS id, ray.axis AS axis, step, kind, last_free, kx, ky, kz FROM hits", _rays("SELECT {'id': id, 'axis': 'x'} AS ray, x AS ox, y AS oy, z AS oz, x + 4 AS tx, y AS ty, z AS tz FROM sf UNION ALL SELECT {'id': id, 'axis': 'y'}, x, y, z, x, y + 4, z FROM sf")),
    "mutual_visibility": _q("SELECT ray.src AS src, ray.dst AS dst, step IS NULL AS visible FROM hits", _rays("SELECT {'src': src, 'dst': dst} AS ray, ax AS ox, ay AS oy, az AS oz, bx AS tx, by_ AS ty, bz AS tz FROM e WHERE src < dst")),
    "exploration_value": _q("SELECT id, nu AS n_unknown, no AS n_occupied, round(nu / n::DOUBLE, 4) + 0.0 AS unknown_share, round(ux, 4) + 0.0 AS ux, round(uy, 4) + 0.0 AS uy, round(uz, 4) + 0.0 AS uz, round(CASE WHEN ux * ux + uy * uy + uz * uz > 0 THEN sqrt((ux * ux + uy * uy) / (ux * ux + uy * uy + uz * uz)) ELSE 0 END, 4) + 0.0 AS horizontal_share FROM (SELECT id, count(*) FILTER (kind = 'unknown') AS nu, count(*) FILTER (kind = 'occupied') AS no, count(*) AS n, avg(dx) FILTER (kind = 'unknown') AS ux, avg(dy) FILTER (kind = 'unknown') AS uy, avg(dz) FILTER (kind = 'unknown') AS uz FROM seen GROUP BY id) WHERE nu > 0 AND no > 0", _look(2.0)),
    "exploration_percent": _q("SELECT id, round(100 * avg(CASE WHEN kind = 'unknown' THEN 1.0::DOUBLE ELSE 0 END), 4) + 0.0 AS percent FROM seen WHERE abs(asin(dz)) <= pi() / 8 GROUP BY id", _look(0.5)),
    "frontier_spheres": _q("SELECT id, avg(CASE WHEN kind = 'unknown' THEN 1.0::DOUBLE ELSE 0 END) >= 0.1 AS is_frontier FROM seen GROUP BY id", _look(0.5)),
    "fragment_pack": _q("SELECT (idx // 37)::INTEGER AS fragment_index, 'segment' AS kind, idx % 37 AS slot, idx, NULL::BIGINT AS id1, NULL::BIGINT AS id2, alpha, a, b, c FROM code UNION ALL SELECT CASE WHEN p < f THEN base ELSE base + 1 + (p - f) // 122 END::INTEGER, 'portal', CASE WHEN p < f THEN p ELSE (p - f) % 122 END::BIGINT, NULL, i1, i2, NULL, NULL, NULL, NULL FROM (SELECT x.idx AS i1, y.idx AS i2, row_number() OVER (ORDER BY x.idx, y.idx) - 1 AS p, (n - 1) // 37 AS base, (490 - 13 * ((n - 1) % 37 + 1)) // 4 AS f FROM por JOIN dense x ON x.segment_id = id1 JOIN dense y ON y.segment_id = id2, (SELECT count(*) AS n FROM dense))", SENT),
    "fragment_decode": _q("SELECT robot, idx, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy, round(cz, 4) + 0.0 AS cz, round(alpha * pi() / 255, 4) + 0.0 AS alpha, round(a * 50.0 / 255, 4) + 0.0 AS a, round(b * 50.0 / 255, 4) + 0.0 AS b, round(c * 50.0 / 255, 4) + 0.0 AS c, round(sqrt(pow(a * 50.0 / 255, 2) + pow(b * 50.0 / 255, 2) + pow(c * 50.0 / 255, 2)), 4) + 0.0 AS radius FROM code, (VALUES (0), (1)) r(robot)", SENT),
    "fragment_decode_portals": _q("SELECT p.idx AS id1, q.idx AS id2, round((p.cx + q.cx) / 2, 4) + 0.0 AS x, round((p.cy + q.cy) / 2, 4) + 0.0 AS y, round((p.cz + q.cz) / 2, 4) + 0.0 AS z FROM por JOIN dense dp ON dp.segment_id = id1 JOIN dense dq ON dq.segment_id = id2 JOIN code p ON p.idx = dp.idx JOIN code q ON q.idx = dq.idx", SENT),
    "message_counters": _q("SELECT robot, count(*)::BIGINT AS n_messages, sum(n)::BIGINT AS n_fragments, count(*) FILTER (n = 4 AND low = 0 AND high = 3) AS n_rebuilt FROM (SELECT robot, message_index, count(DISTINCT fragment_index) AS n, min(fragment_index) AS low, max(fragment_index) AS high FROM fg GROUP BY 1, 2) GROUP BY 1", FRAGS),
    "fragment_drip": _q("SELECT event_id, robot, round((row_number() OVER (PARTITION BY robot ORDER BY message_index, event_id) - 1) / 10.0::DOUBLE, 4) AS at_s FROM fg", FRAGS),
    "fragment_reassembly_latest": _q("SELECT robot, message_index, count(DISTINCT fragment_index)::BIGINT AS n_kept, count(DISTINCT fragment_index) = 4 AS complete FROM (SELECT *, max(message_index) OVER (PARTITION BY robot ORDER BY ts, event_id) AS newest FROM fg) WHERE message_index = newest GROUP BY 1, 2", FRAGS),
    "segment_membership_prob": _q(f"SELECT id, segment_id, {_r('m', 'p')} FROM prob", MEMBER),
    "exploredness": _q("SELECT o.id, round(least(0.9, coalesce(min(1 - best), 1)), 4) + 0.0 AS prob FROM ob o LEFT JOIN (SELECT id, segment_id % 2 AS map, max((1 - segment_id / 20.0) * p) AS best FROM prob GROUP BY 1, 2) b ON b.id = o.id GROUP BY o.id", MEMBER),
    "visitation_value": _q("SELECT p.event_id AS id, round(greatest(coalesce(max(CASE WHEN d <= 0.2 THEN 2 ELSE 1 - d / 0.4 END), 0), 0), 4) + 0.0 AS value FROM traj p LEFT JOIN (SELECT a.event_id, sqrt(pow(a.x + 0.05 - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM traj a JOIN traj b ON a.y = b.y AND a.z = b.z UNION ALL SELECT a.event_id, sqrt(pow(a.x + 0.05 - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) FROM traj a JOIN traj b ON (a.y <> b.y OR a.z <> b.z) AND abs(a.y - b.y) < 0.41 AND abs(a.z - b.z) < 0.41) q ON q.event_id = p.event_id AND d <= 0.4 GROUP BY p.event_id"),
    "trajectory_crossings": _q("SELECT least(a, b) AS id1, greatest(a, b) AS id2, count(*)::BIGINT AS n FROM (SELECT floor(y / 4)::INTEGER AS a, lag(floor(y / 4)::INTEGER) OVER (PARTITION BY robot ORDER BY ts, event_id) AS b FROM traj) WHERE a <> b GROUP BY 1, 2"),
    "frontier_dbscan": _q("SELECT p.id, coalesce(c.cluster, (SELECT min(c2.cluster) FROM near n JOIN lab c2 ON c2.id = n.dst WHERE n.src = p.id), -1) AS cluster FROM pt p LEFT JOIN lab c ON c.id = p.id", "near AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, 1 + b.id % 7 AS w FROM pt a, pt b WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 36), core AS MATERIALIZED (SELECT src AS id FROM near GROUP BY src HAVING sum(w) + 1 + src % 7 >= 40), reach AS (SELECT id AS x, id AS y FROM core UNION SELECT r.x, n.dst FROM reach r JOIN near n ON n.src = r.y WHERE n.dst IN (FROM core)), lab AS MATERIALIZED (SELECT x AS id, min(y) AS cluster FROM reach GROUP BY x)", True),
    "frontier_best_by_direction": _q("SELECT id, cluster, sector, round(score, 4) + 0.0 AS score FROM (SELECT id, label AS cluster, sqrt(x * x + y * y) AS score, floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 6.283185307179586 ELSE atan2(y, x) END) / 6.283185307179586 * 8)::BIGINT AS sector FROM pt) QUALIFY row_number() OVER (PARTITION BY cluster, sector ORDER BY score DESC, id) = 1"),
    "cylinder_samples": _q("SELECT (l - 2)::BIGINT AS layer, c AS circle, i, round(c * 0.5 * cos(i * 2 * pi() / 12), 4) + 0.0 AS x, round(c * 0.5 * sin(i * 2 * pi() / 12), 4) + 0.0 AS y, round((l - 2) * 0.4::DOUBLE, 4) + 0.0 AS z FROM range(5) a(l), range(1, 4) b(c), range(12) d(i)"),
    "heat_color": _q(f"SELECT i AS id, {_heat('(i / 100.0::DOUBLE)')} FROM range(100) r(i)"),
    "segment_color": _q(f"SELECT i AS id, {_heat('(i % 10 / 10.0::DOUBLE)')} FROM range(30) r(i)"),
    "key_union_diff": _q(f"SELECT src, dst, {BOX} AS kept FROM e"),
    "latest_odom_asof": _q("SELECT a.event_id, round(b.x, 4) + 0.0 AS x FROM (SELECT * FROM traj WHERE event_id % 5 = 0) a ASOF LEFT JOIN (SELECT robot, ts, max(x) AS x FROM traj WHERE event_id % 5 <> 0 GROUP BY 1, 2) b ON a.robot = b.robot AND a.ts >= b.ts"),
    "obstacle_bounds": _q("SELECT " + ", ".join(f"round(coalesce({f}({c}), 0), 4) + 0.0 AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM ob"),
    "marker_export": _q(f"SELECT 'spheres' AS ns, id, 'sphere' AS type, {_r('x', 'y', 'z')}, {_heat('(least(greatest((radius - 0.8) / 2.2, 0.0), 1.0) / 3)')}, round(radius * 2, 4) + 0.0 AS scale, 2.0::DOUBLE AS lifetime_s FROM sf"),
    "sphere_pairs_in_reach": _q("SELECT s.id, o.id AS obstacle, round(sqrt((s.x-o.x)*(s.x-o.x)+(s.y-o.y)*(s.y-o.y)+(s.z-o.z)*(s.z-o.z)), 4) + 0.0 AS dist FROM sp s, ob o WHERE (s.x-o.x)*(s.x-o.x)+(s.y-o.y)*(s.y-o.y)+(s.z-o.z)*(s.z-o.z) <= 25"),
    "region_adjacency": _q("SELECT region AS id1, n_region AS id2, count(*)::BIGINT AS n_faces FROM side WHERE region < n_region GROUP BY 1, 2", SIDES),
    "region_borders": _q(BORDERS.format(c="cel", s="side"), SIDES),
    "region_unexplored": _q("SELECT region, kx, ky, kz, o FROM cel c, face f WHERE NOT EXISTS (SELECT 1 FROM cor u WHERE u.kx = c.kx + dx AND u.ky = c.ky + dy AND u.kz = c.kz + dz)", CELLS),
    "region_joined_borders": _q(f"SELECT * FROM ({BORDERS.format(c='cj', s='sj')}) WHERE region IN (2, 4)", SIDES + ", cj AS MATERIALIZED (SELECT CASE region WHEN 3 THEN 2 WHEN 5 THEN 4 ELSE region END AS region, kx, ky, kz FROM cel), sj AS MATERIALIZED (SELECT CASE region WHEN 3 THEN 2 WHEN 5 THEN 4 ELSE region END AS region, kx, ky, kz, CASE n_region WHEN 3 THEN 2 WHEN 5 THEN 4 ELSE n_region END AS n_region, nkx FROM side)"),
    "region_new_connections": _q("SELECT DISTINCT region AS id1, n_region AS id2 FROM side WHERE region < n_region AND NOT EXISTS (SELECT 1 FROM por WHERE id1 = region AND id2 = n_region)", SIDES),
    "nearest_region": _q("SELECT o.id, coalesce(min(c.region), (SELECT arg_min(segment_id, [pow(cx - any_value(o.x), 2) + pow(cy - any_value(o.y), 2) + pow(cz - any_value(o.z), 2), segment_id]) FROM cen)) AS region FROM ob o LEFT JOIN cel c ON c.kx = floor(o.x / 0.2)::BIGINT + 32768 AND c.ky = floor(o.y / 0.2)::BIGINT + 32768 AND c.kz = floor(o.z / 0.2)::BIGINT + 32768 GROUP BY o.id", CELLS),
    "region_best_portal": _q("SELECT id1, id2, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, round(d, 4) + 0.0 AS odist FROM clear WHERE d >= 0.3 QUALIFY row_number() OVER (PARTITION BY id1, id2 ORDER BY round(d, 9) DESC, kx, ky, kz, nkx, nky, nkz) = 1", SIDES + ", mid2 AS (SELECT region AS id1, n_region AS id2, kx, ky, kz, nkx, nky, nkz, ((kx - 32768 + 0.5) * 0.2::DOUBLE + (nkx - 32768 + 0.5) * 0.2::DOUBLE) / 2 AS x, ((ky - 32768 + 0.5) * 0.2::DOUBLE + (nky - 32768 + 0.5) * 0.2::DOUBLE) / 2 AS y, ((kz - 32768 + 0.5) * 0.2::DOUBLE + (nkz - 32768 + 0.5) * 0.2::DOUBLE) / 2 AS z FROM side WHERE region < n_region), oc AS (SELECT (kx - 32768 + 0.5) * 0.2::DOUBLE AS x, (ky - 32768 + 0.5) * 0.2::DOUBLE AS y, (kz - 32768 + 0.5) * 0.2::DOUBLE AS z FROM obk), clear AS (SELECT id1, id2, kx, ky, kz, nkx, nky, nkz, s.x, s.y, s.z, least(3.0, min(" + _D + ")) AS d FROM mid2 s, oc o GROUP BY ALL)"),
    "segments_near_origin": _q(f"SELECT segment_id, {_r('bounding_radius')} FROM cen WHERE sqrt(cx*cx + cy*cy + cz*cz) - 5.0 - bounding_radius < 0"),
    "segments_box": _q("SELECT " + ", ".join(f"round({f}(c{c}) {o} max(bounding_radius), 4) + 0.0 AS {n}_{c}" for c in "xyz" for n, f, o in (("low", "min", "-"), ("high", "max", "+"))) + ", round(max(bounding_radius), 4) + 0.0 AS r FROM cen HAVING count(*) > 0"),
    "best_radius_in_box": _q("SELECT a.pid, round(coalesce(max(s.radius), 3.0), 4) + 0.0 AS radius FROM ask a LEFT JOIN sf s ON abs(a.x - s.x) <= 3 AND abs(a.y - s.y) <= 3 AND abs(a.z - s.z) <= 3 GROUP BY 1"),
    "nearest_under_limit": _q(f"SELECT id, {_r('nearest', 'farthest')} FROM (SELECT s.id, min({_D}) AS nearest, max({_D}) AS farthest FROM pt s, ob o WHERE s.label >= 2 AND {_D} < 2 GROUP BY 1)"),
    "cylinder_clear": _q("SELECT s.id, NOT EXISTS (SELECT 1 FROM ob o WHERE (s.x-o.x)*(s.x-o.x) + (s.y-o.y)*(s.y-o.y) < 4 AND abs(s.z - o.z) < 3) AS clear FROM pt s WHERE s.label >= 2"),
    "narrow_passages": _q(f"SELECT id, {_r('odist')} FROM od WHERE odist >= 0.8 AND odist < 1.6"),
    "path_crosses_box": _q("SELECT (robot * 1000000 + n // 20)::BIGINT AS path_id, bool_or(x > 2 AND x < 8 AND y > 4 AND y < 12 AND z > 1 AND z < 5) AS crosses FROM (SELECT *, row_number() OVER (PARTITION BY robot ORDER BY ts, event_id) - 1 AS n FROM traj) GROUP BY 1"),
    "segment_covariance": _q("SELECT segment_id, " + ", ".join(f"round(avg({c}), 4) + 0.0 AS c{c}" for c in "xyz") + ", " + ", ".join(f"round(covar_pop({a}, {b}), 4) + 0.0 AS v{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM sf GROUP BY 1"),
    "trajectory_connections": _q("SELECT DISTINCT least(a, b) AS id1, greatest(a, b) AS id2 FROM (SELECT region AS a, lag(region) OVER (ORDER BY id) AS b, sum(step) OVER (ORDER BY id DESC) AS back FROM (SELECT t.id, region, coalesce(sqrt(pow(t.x - lag(t.x) OVER w, 2) + pow(t.y - lag(t.y) OVER w, 2) + pow(t.z - lag(t.z) OVER w, 2)), 0) AS step FROM sf t LEFT JOIN cel c ON c.kx = floor(t.x / 0.2)::BIGINT + 32768 AND c.ky = floor(t.y / 0.2)::BIGINT + 32768 AND c.kz = floor(t.z / 0.2)::BIGINT + 32768 WINDOW w AS (ORDER BY t.id))) WHERE a <> b AND back <= 2000", CELLS),
    "growth_positions": _q("SELECT segment_id, id, round(dist, 4) + 0.0 AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY round(dist, 9) DESC, id) AS rank FROM (SELECT segment_id, id, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) AS dist FROM sf JOIN mean USING (segment_id))) WHERE rank <= 2"),
    "segment_radius_range": _q("SELECT segment_id, round(min(radius), 4) + 0.0 AS least_radius, round(max(radius), 4) + 0.0 AS greatest_radius FROM sf WHERE segment_id > 0 GROUP BY 1"),
    "segments_first_seen": _q("SELECT floor(y / 4)::INTEGER AS segment_id, min(event_id) AS seq FROM traj GROUP BY 1"),
    "wrong_keys": _q("SELECT sum(n)::BIGINT AS n_wrong, count(*) FILTER (n > 1) AS n_shared FROM (SELECT floor(x / 0.2), floor(y / 0.2), floor(z / 0.2), count(*) AS n FROM sf GROUP BY 1, 2, 3)"),
    "most_probable_block": _q("SELECT o.id, round(coalesce(max(p), 0), 4) + 0.0 AS p FROM ob o LEFT JOIN prob USING (id) GROUP BY 1", MEMBER),
    "blocked_below": _q(f"SELECT id, bool_or(oz > -20 AND oz < top) AS blocked FROM (SELECT s.id, top, i, arg_min(o.z, [{_D}, o.x, o.y, o.z]) AS oz FROM (SELECT pid AS id, x, y, a.z AS top, i, a.z - i * (2 * 1.0::DOUBLE * sin(pi() / 6)) AS z FROM ask a, range(0, 400) r(i) WHERE a.z > -20 AND i < ceil((a.z + 20) / (2 * 1.0::DOUBLE * sin(pi() / 6)))) s, ob o GROUP BY 1, 2, 3) GROUP BY id"),
    "latest_odometry": _q("SELECT robot, 'map' AS frame, max(ts) AS ts, round(arg_max(x, ts), 4) + 0.0 AS x, round(arg_max(y, ts), 4) + 0.0 AS y, round(arg_max(z, ts), 4) + 0.0 AS z FROM (SELECT robot, ts, max(x) AS x, max(y) AS y, max(z) AS z FROM traj GROUP BY 1, 2) GROUP BY 1"),
    "transformed_points": _q("SELECT CASE WHEN label = 0 THEN 'turned' ELSE 'map' END AS frame, id, round(CASE WHEN label = 0 THEN 1 - y ELSE x END, 4) + 0.0 AS x, round(CASE WHEN label = 0 THEN x + 2 ELSE y END, 4) + 0.0 AS y, round(CASE WHEN label = 0 THEN z + 3 ELSE z END, 4) + 0.0 AS z, NULL::VARCHAR AS message FROM ob"),
    "ellipsoid_members": _q("SELECT id, pow((x - 1) / 10, 2) + pow((y - 2) / 12, 2) + pow(z / 8, 2) <= 1 AS inside FROM sp"),
    "ball_points": _q("SELECT i, round(sqrt(1 - c * c) * cos(i * (pi() * (3 - sqrt(5.0::DOUBLE)))) * r, 4) + 0.0 AS x, round(sqrt(1 - c * c) * sin(i * (pi() * (3 - sqrt(5.0::DOUBLE)))) * r, 4) + 0.0 AS y, round(c * r, 4) + 0.0 AS z FROM (SELECT i, 1 - (2 * i + 1) / 50.0::DOUBLE AS c, cbrt(1 + fmod((i + 0.5) * 0.7548776662466927::DOUBLE, 1.0::DOUBLE) * 7) AS r FROM range(50) t(i))"),
    "camera_ends": _q("SELECT i, 10.0::DOUBLE AS x, round(4 * (fmod((i + 0.5) * 0.7548776662466927::DOUBLE, 1.0::DOUBLE) * 2 - 1), 4) + 0.0 AS y, round(3 * (fmod((i + 0.5) * 0.5698402909980532::DOUBLE, 1.0::DOUBLE) * 2 - 1), 4) + 0.0 AS z FROM range(50) t(i)"),
}
ORACLE["frontier_cluster_sizes"] = ORACLE["frontier_dbscan"].replace("SELECT p.id, coalesce(", "SELECT cluster, count(*)::BIGINT AS n_groups, sum(1 + id % 7)::BIGINT AS n_elements FROM (SELECT p.id, coalesce(", 1) + ") GROUP BY 1"
ORACLE["segment_removed"] = f"SELECT * FROM ({ORACLE['safest_connection']}) WHERE seg NOT IN (2, 5) AND other NOT IN (2, 5)"
ORACLE["segment_inside_block"] = _q("SELECT q.id1, q.id2, coalesce(bool_and(abs(dx * cos(alpha) + dy * sin(alpha)) <= a AND abs(-dx * sin(alpha) + dy * cos(alpha)) <= b AND abs(dz) <= c), true) AS inside FROM (SELECT id1, id2 FROM por UNION SELECT id2, id1 FROM por) q LEFT JOIN (SELECT p.id1, p.id2, f.alpha, f.a, f.b, f.c, (k.kx - 32768 + 0.5) * 0.2::DOUBLE - m.cx AS dx, (k.ky - 32768 + 0.5) * 0.2::DOUBLE - m.cy AS dy, (k.kz - 32768 + 0.5) * 0.2::DOUBLE - m.cz AS dz FROM (SELECT id1, id2 FROM por UNION SELECT id2, id1 FROM por) p JOIN fit f ON f.segment_id = id1 JOIN mean m ON m.segment_id = id1 JOIN cel k ON k.region = id2) x ON x.id1 = q.id1 AND x.id2 = q.id2 GROUP BY 1, 2", FIT + ", " + CELLS)
