"""Expansion by the one-by-one rule, rays through pruned leaves, and the service on streams."""

import datetime as dt
import heapq
import math
import random

import pandas as pd
import pytest

from lacuna.config import DEFAULT
from lacuna.functions import geometry as geo
from lacuna.operators import frontier, graph, messages, paths, regions, segments, voxels
from lacuna.operators.iterate import greedy
from lacuna.operators.spatial import nearest_site, pairs_within
from lacuna.operators.tick import as_spheres, expand, nearness_samples, pinned, ray_samples, tick
from lacuna.sources.maps import decoded, occupied_points, other_maps, read_points, replay
from lacuna.streaming import service
from lacuna.streaming.robots import Track, keep_newest, newest_version, read_newest, reassembly_stream, visited_batch

OFF = geo.KEY_OFFSET


def room(spark, nx=30, ny=20, nz=14):
    rows = [(1, x + OFF, y + OFF, z + OFF, 16, x in (0, nx - 1) or y in (0, ny - 1) or z in (0, nz - 1)) for x in range(nx) for y in range(ny) for z in range(nz)]
    return spark.createDataFrame(rows, "version long, kx int, ky int, kz int, depth int, occupied boolean")


def test_grid_joins_keep_columns_of_their_own_names(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "kept")], "id long, x double, y double, z double, gx string")
    assert pairs_within(a, a, 1.0, None, "left_semi").first()["gx"] == "kept"
    assert pairs_within(a, a, 1.0).select("a.gx", "b.gx").first()[:] == ("kept", "kept")


def test_nearest_site_against_all(spark):
    rng = random.Random(2)
    pts = [(i, *(rng.uniform(-200, 200) for _ in range(3))) for i in range(80)] + [(80, 0.0, 0.0, 0.0), (81, None, 0.0, 0.0)]
    sites = [tuple(rng.uniform(-30, 30) for _ in range(3)) for _ in range(60)] * 2
    df, st = spark.createDataFrame(pts, "id long, x double, y double, z double"), spark.createDataFrame(sites, "x double, y double, z double")
    got = {r.id: r.odist for r in nearest_site(df, st, "id", 2.0).collect()}
    assert set(got) - {81} == set(range(81))
    for i, *p in pts[:-1]:
        assert got[i] == pytest.approx(min(math.dist(p, s) for s in sites))


def test_greedy_rule(spark):
    rng = random.Random(1)
    links = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.08]
    kept = []
    for k in range(60):
        if not any((a, k) in links for a in kept):
            kept.append(k)
    got = greedy(spark.range(60).toDF("k"), spark.createDataFrame(links, "first long, then long"))
    assert sorted(r.k for r in got.collect()) == kept


def test_expansion_one_by_one(spark):
    """Against the rule taken sample by sample, without voxels: spacing of leaves, deny box, voxels, covering."""
    rng = random.Random(3)
    old = [(i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 3), rng.uniform(0.8, 3)) for i in range(12)]
    spheres = as_spheres(spark.createDataFrame(old, "id long, x double, y double, z double, radius double"))
    samples = [(n if n < 60 else (1 << 56) + n, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 3), rng.uniform(0.8, 3)) for n in range(200)]
    deny, near = ((0.0, 0.0, 0.0), (2.0, 2.0, 3.0)), ((0.0, 0.0, 0.0), (6.0, 9.0, 3.0))
    key = lambda p: tuple(math.floor(c / DEFAULT.resolution) for c in p)
    inside = lambda p, b: all(lo < c < hi for c, lo, hi in zip(p, *b, strict=True))
    tests = []
    for n, *p, r in samples:
        apart = 1.0 if inside(p, near) else 2.2
        if n < 60 or all(math.dist(p, q) >= apart for _, q, _ in tests):
            tests.append((n, p, r))
    have = [(p, r) for _, *p, r in old]
    new = []
    for _, p, r in tests:
        if inside(p, deny) or key(p) in {key(q) for q, _ in have} or any(r < s - 0.2 and math.dist(p, q) < max(0.2, s / 1.5) for q, s in have):
            continue
        have.append((p, r))
        new.append(tuple(p))
    out = expand(spheres, spark.createDataFrame(samples, "n long, x double, y double, z double, odist double"), None, near, deny)
    got = {(r.x, r.y, r.z) for r in out.collect()} - {tuple(p) for _, *p, _ in old}
    assert got == set(new) and len(new) > 20


def test_pinned_and_rays_through_pruned_leaves(spark):
    """A corridor along x that a wall ends at x = 4; its free space is pruned to leaves of depth 14."""
    free = [(1, OFF + 4 * i, OFF, OFF, 14, False) for i in range(5)]
    wall = [(1, OFF + 20, OFF + y, OFF + z, 16, True) for y in range(4) for z in range(4)]
    world = spark.createDataFrame(free + wall, "version long, kx int, ky int, kz int, depth int, occupied boolean")
    pair = lambda p, sx, sr: (p, sx, 0.3, 0.3, sr, 0.5, 0.3, 0.3, 2.0)
    pairs = spark.createDataFrame([pair(1, 3.2, 0.5), pair(2, 2.5, 0.5), pair(3, 3.2, 1.5), pair(4, 3.9, 0.5)], "p long, sx double, sy double, sz double, sr double, lx double, ly double, lz double, lr double")
    # The wall's voxel centre is 4.1; behind the small spheres are 0.4, 1.1 and less than none.
    assert sorted(r.p for r in pinned(pairs, world).collect()) == [1]
    rays = spark.createDataFrame([(1, 0.5, 0.3, 0.3, 6.0, 0.3, 0.3), (2, 0.5, 0.3, 0.3, 0.5, 0.3, 3.0), (3, 0.5, 0.3, 0.3, 3.0, 0.3, 0.3)], "ray long, ox double, oy double, oz double, tx double, ty double, tz double")
    got = {r.ray: (r.kind, r.kx and r.kx - OFF) for r in voxels.ray_hits(rays, world).collect()}
    assert got == {1: ("occupied", 20), 2: ("unknown", 2), 3: (None, None)}


def test_rays_from_the_position(spark):
    world = room(spark)
    walls = occupied_points(world)
    points = [(r.x, r.y, r.z) for r in walls.collect()]
    here = (1.5, 1.9, 1.3)
    got = ray_samples(here, walls, geo.fibonacci_directions(spark, 30), world, 35.0).collect()
    assert got
    for r in got:
        assert r.odist == pytest.approx(min(math.dist((r.x, r.y, r.z), p) for p in points)) and r.odist >= 0.8
    by = {}
    for r in sorted(got, key=lambda r: r.n):
        by.setdefault(r.n // 100_000, []).append(r)
    for own in by.values():
        t = [math.dist(here, (r.x, r.y, r.z)) for r in own]
        assert t[0] == pytest.approx(1.0)
        assert all(b == pytest.approx(a + max(1.0, r.odist - 0.2)) for a, b, r in zip(t, t[1:], own, strict=False))
    ball = geo.ball_points(spark, 10, 1.0)
    near = nearness_samples(as_spheres(spark.createDataFrame([(1, *here, 1.2)], "id long, x double, y double, z double, radius double")), walls, ball)
    assert all(math.dist(here, (r.x, r.y, r.z)) >= 1.0 and r.odist >= 0.8 for r in near.collect())


def test_touched_leaves(spark):
    world = spark.createDataFrame([(1, 32768, 32768, 32768, 14, True), (1, 33000, 32768, 32768, 16, False)], "version long, kx int, ky int, kz int, depth int, occupied boolean")
    keys = spark.createDataFrame([(32769, 32768, 32770), (40000, 40000, 40000), (33000, 32768, 32768)], "kx int, ky int, kz int")
    got = voxels.touched(world, keys, 16).collect()
    volume = sum(8 ** (16 - r.depth) for r in got if r.occupied)
    assert volume == 64 and (32769, 32768, 32770, 16) in {(r.kx, r.ky, r.kz, r.depth) for r in got if r.occupied}
    assert sum(1 for r in got if r.occupied) == 7 + 8 and {(r.kx, r.depth) for r in got if not r.occupied} == {(33000, 16), (40000, 16)}


def test_segments_removed_and_made_anew(spark):
    rows = [(i, 1 + i // 4, 1.5 * i, 0.0, 0.0, 1.0 + 0.1 * (i % 3)) for i in range(12)]
    nodes = as_spheres(spark.createDataFrame(rows, "id long, segment_id int, x double, y double, z double, radius double"))
    edges = graph.sphere_edges(nodes)
    free, left, portal = segments.remove(nodes, segments.connections(edges), segments.portals(edges), spark.sql("SELECT 2 segment_id"))
    assert {r.segment_id for r in free.collect()} == {0, 1, 3} and left.count() == 0 and portal.count() == 0
    made = segments.resegmented(free, edges, (8.0, 0.0, 0.0), 3.0)
    got = {r.id: r.segment_id for r in made.collect()}
    assert len(got) == 12 and all(got[i] > 3 for i in range(4, 8)) and {got[i] for i in range(4)} == {1}
    again = {r.id: r.segment_id for r in segments.resegmented(nodes, edges, (8.0, 0.0, 0.0), 3.0, reset=True).collect()}
    assert all(again[i] > 3 for i in range(4, 8))


def test_frontier_groups(spark):
    rng = random.Random(5)
    pts = [(i, *(rng.uniform(0, 20) for _ in range(3))) for i in range(150)]
    heads, count = [], {}
    for i, *p in pts:
        if all(math.dist(p, q) >= 4 for _, q in heads):
            heads.append((i, p))
    for _, *p in pts:
        first = next(h for h, q in heads if math.dist(p, q) < 4)
        count[first] = count.get(first, 0) + 1
    got = frontier.groups_of(spark.createDataFrame(pts, "id long, x double, y double, z double"), 4.0)
    assert {r.id: r.weight for r in got.collect()} == count
    assert {r["id"] for r in regions.chosen(got, ["weight"], 1, 7).collect()} <= set(count)


def test_paths_of_large_maps_equal_those_of_small_ones(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, 2 + i % 4, rng.uniform(0, 14), rng.uniform(0, 14), rng.uniform(0, 4), rng.uniform(0.8, 3)) for i in range(70)]
    safe = spark.createDataFrame(rows, "id long, segment_id int, x double, y double, z double, radius double")
    edges = graph.sphere_edges(safe)
    link = segments.connections(edges)
    stored = paths.stored_paths(safe, edges, link)
    asks = [(i, 0, *(rng.uniform(0, 14) for _ in range(6))) for i in range(12)] + [(50, 0, 500.0, 0.0, 0.0, 1.0, 1.0, 1.0), (51, 0, 3.0, 3.0, 1.0, 3.0, 3.0, 1.0)]
    requests = spark.createDataFrame(asks, "query_id long, goal_id int, sx double, sy double, sz double, gx double, gy double, gz double")
    run = lambda: {r.query_id: (r.success, r.message, r.path and (r.path[0], r.path[-1]), r.cost and round(r.cost, 6)) for r in paths.plan_paths(requests, safe, edges, link, stored, use_stored=False, exact=True).collect()}
    small = run()
    monkeypatch.setattr(paths, "MOST", 5)
    assert run() == small and small[50][0] is False and small[51][0]


def test_tables_of_many_rows_are_answered_by_the_same_search(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(i, 2 + i % 4, rng.uniform(0, 14), rng.uniform(0, 14), rng.uniform(0, 4), rng.uniform(0.8, 3)) for i in range(70)]
    safe = spark.createDataFrame(rows, "id long, segment_id int, x double, y double, z double, radius double")
    edges = graph.sphere_edges(safe)
    link = segments.connections(edges)
    stored = paths.stored_paths(safe, edges, link)
    asks = [(i, 0, *(rng.uniform(0, 14) for _ in range(6))) for i in range(12)] + [(50, 0, 500.0, 0.0, 0.0, 1.0, 1.0, 1.0), (51, 0, None, 3.0, 1.0, 3.0, 3.0, 1.0)]
    requests = spark.createDataFrame([*asks, asks[0]], "query_id long, goal_id int, sx double, sy double, sz double, gx double, gy double, gz double")
    nowhere = spark.range(250_000).selectExpr("id % 70 src", "1000 + id dst", "2 s1", "2 s2", "1D dist", "1D safety")  # to ids without a node
    run = lambda e, own: sorted(tuple(r) for r in paths.plan_paths(requests, safe, e, link, stored, use_stored=own, exact=not own).collect())
    small = {own: run(edges, own) for own in (True, False)}
    monkeypatch.setattr(paths, "_plan_by_rounds", None)
    for own in (True, False):
        assert run(edges.unionByName(nowhere), own) == small[own] and len(small[own]) == 15
        assert sum(r[2] for r in small[own]) >= 10


def test_bounds_of_a_goal_are_made_once_and_costs_are_those_of_a_search():
    rng = random.Random(31)
    spheres = [(i, rng.uniform(0, 20), rng.uniform(0, 20), 0.0, rng.uniform(0.8, 3.0)) for i in range(120)] + [(900, math.nan, 0.0, 0.0, 1.0)]
    both = [(a[0], b[0]) for a in spheres for b in spheres if a[0] != b[0] and math.dist(a[1:4], b[1:4]) < a[4] + b[4] - 0.8]
    g = paths.Graph(pd.DataFrame(spheres, columns=["id", "x", "y", "z", "radius"]), pd.DataFrame(both, columns=["src", "dst"]))
    assert g.bounds(7, DEFAULT) is g.bounds(7, DEFAULT) and g.bounds(8, DEFAULT)(8) == 0
    for start in (0, 60, 900):
        want, queue = {}, [(0.0, start)]
        while queue:
            cost, node = heapq.heappop(queue)
            if node not in want:
                want[node] = cost
                for n, w in g.out(node, DEFAULT):
                    heapq.heappush(queue, (cost + w, n))
        assert g.costs(start, DEFAULT) == want


def test_bounded_searches_find_the_cheapest_paths():
    rng = random.Random(28)
    spheres = [(i, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 5), rng.uniform(0.8, 3.5)) for i in range(300)]
    both = [(a[0], b[0]) for a in spheres for b in spheres if a[0] != b[0] and math.dist(a[1:4], b[1:4]) < a[4] + b[4] - 0.8]
    nodes, edges = pd.DataFrame(spheres, columns=["id", "x", "y", "z", "radius"]), pd.DataFrame([*both, (5, 4000)], columns=["src", "dst"])
    g, cheaper = paths.Graph(nodes, edges), 0
    for goal in range(0, 300, 20):
        bound = g.bounds(goal, DEFAULT)
        assert bound(goal) == 0
        for start in range(0, 300, 7):
            want = g.costs(start, DEFAULT).get(goal)
            assert g.connected(start, goal) == (want is not None)
            if want is not None and start != goal:
                assert bound(start) <= want + 1e-9
                assert math.isclose(g.cost(g.search(start, goal, DEFAULT, heuristic=bound), DEFAULT), want, rel_tol=1e-9)
                cheaper += bound(start) > 1.5 * math.dist(g.at[start], g.at[goal])
    assert cheaper > 100  # the bounds know the risks, of which the straight distance knows nothing
    assert paths.Graph(nodes, edges.iloc[1:]).bounds(0, DEFAULT) is None  # one edge leads one way


def test_messages_of_two_robots_do_not_mix(spark):
    segs = spark.createDataFrame([(i, 40, float(i), 0.0, 0.0, 2.0, 0.1, 1.0, 1.0, 1.0) for i in range(5)], "segment_id int, n_keys long, cx double, cy double, cz double, bounding_radius double, alpha double, a double, b double, c double")
    ports = spark.createDataFrame([(0, 1), (3, 4)], "id1 int, id2 int")
    packed = messages.pack(segs, ports)
    own, joined = messages.decode(messages.fragments(packed, 1, 7).unionByName(messages.fragments(packed, 2, 3)))
    assert sorted((r.robot, r.idx, r.cx) for r in own.collect()) == [(r, i, float(i)) for r in (1, 2) for i in range(5)]
    assert sorted((r.robot, r.id1, r.x) for r in joined.collect()) == [(1, 0, 0.5), (1, 3, 3.5), (2, 0, 0.5), (2, 3, 3.5)]


def test_visits(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(0, start + dt.timedelta(seconds=i), i, x, 0.0, 0.0, c) for i, (x, c) in enumerate([(0.0, 0.1), (0.1, 1.0), (0.2, 1.0), (0.8, 1.0), (3.0, 0.3), (0.8, 1.0)])]
    got = sorted(visited_batch(spark.createDataFrame(rows, "robot int, ts timestamp, event_id long, x double, y double, z double, odist double")).collect(), key=lambda r: r.node)
    assert [(r.x, round(r.dwell_s, 6), r.links) for r in got] == [(0.1, 1.0, []), (0.8, 1.0, []), (3.0, 0.0, [1])] or [r.links for r in got] == [[], [0], [1]]
    assert Track().around((0.0, 0.0, 0.0)) == []


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("VERSION .7\nFIELDS x y z\nDATA ascii\n1.5 -2 3\n-0.5 0 1e1\n")
    assert sorted(map(tuple, read_points(spark, str(tmp_path / "a.pcd"), "pcd").collect())) == [(-0.5, 0.0, 10.0), (1.5, -2.0, 3.0)]
    schema = "version long, kx int, ky int, kz int, depth int, occupied boolean"
    for n, versions in enumerate([[3], [2], [5, 4]]):
        spark.createDataFrame([(v, OFF, OFF, OFF, 16, v % 2 == 1) for v in versions], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    table = str(tmp_path / "table")
    for n, want in ((0, 3), (1, 3), (2, 5)):
        run = keep_newest(spark, replay(spark, str(tmp_path / f"in/{n}"), schema), table).option("checkpointLocation", str(tmp_path / f"c{n}")).start()
        run.processAllAvailable()
        run.stop()
        assert newest_version(spark, table) == want
    own = read_newest(spark, table, schema)
    assert own.count() == 1 and newest_version(spark, str(tmp_path / "none")) is None and read_newest(spark, str(tmp_path / "none"), schema).count() == 0
    near, points = decoded(own, (0.0, 0.0, 0.0))
    assert near.count() == 1 and points.count() == 1
    maps = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "robot int, m string")
    assert sorted(r.m for r in other_maps(maps, 1).collect()) == ["b", "c"]


def test_reassembly_stream(spark, tmp_path):
    rows = [(0, dt.datetime(2024, 1, 1, 0, 0, i), i, m, f, 3) for i, (m, f) in enumerate([(5, 0), (5, 1), (5, 1), (4, 2), (6, 0), (5, 2), (6, 2), (6, 1)])]
    schema = "robot int, ts timestamp, event_id long, message_index long, fragment_index int, num_total int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = reassembly_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert [tuple(r) for r in spark.table("whole").collect()] == [(0, 6, 3)]
    counted = service.message_counters(spark.createDataFrame(rows, schema)).first()
    assert (counted.n_messages, counted.n_fragments, counted.n_rebuilt) == (3, 7, 2)


def test_ticks_on_a_stream_equal_the_batch(spark, tmp_path):
    world = room(spark, 16, 14, 12)
    walls = occupied_points(world)
    schema = "ts timestamp, x double, y double, z double"
    directions = geo.fibonacci_directions(spark, 6)
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 1), 1.5, 1.3, 1.1), (dt.datetime(2024, 1, 1, 0, 0, 0), 9.0, 9.0, 9.0), (None, None, None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = service.MapStore(spark, f"file://{tmp_path}/map")
    waiting = service.map_tick(store, lambda: None, directions)
    waiting(spark.read.parquet(str(tmp_path / "in")), 0)
    assert store.newest() is None  # nothing before a snapshot is there
    take = service.map_tick(store, lambda: (world, walls), directions)
    run = service.tick_stream(replay(spark, str(tmp_path / "in"), schema), take, str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    at = (1.5, 1.3, 1.1)
    want = tick(service.first_sphere(spark, walls, at), walls, at, directions, world)
    pick = lambda s: sorted((r.x, r.y, r.z, r.radius, r.segment_id) for r in s.collect())
    assert store.newest() == 0 and pick(store.read(0).spheres) == pick(want.spheres)
    before = store.status(0)
    take(spark.read.parquet(str(tmp_path / "in")), 0)  # a replayed micro-batch changes nothing
    assert store.status(0) == before
    out = service.publish_stream(replay(spark, str(tmp_path / "in"), schema), store, {"spheres": lambda s: s.spheres.select("id", "x")}, f"file://{tmp_path}/pub", str(tmp_path / "c2")).start()
    out.processAllAvailable()
    out.stop()
    assert spark.read.parquet(f"file://{tmp_path}/pub/spheres/epoch=0").count() == store.read(0).spheres.count()


def test_search_with_other_goals_and_heuristics():
    import pandas as pd

    nodes = pd.DataFrame([(i, float(i), 0.0, 0.0, 3.0) for i in range(6)], columns=["id", "x", "y", "z", "radius"])
    edges = pd.DataFrame([(a, b) for i in range(5) for a, b in ((i, i + 1), (i + 1, i))], columns=["src", "dst"])
    g = paths.Graph(nodes, edges)
    assert g.search(0, 5, DEFAULT) == [0, 1, 2, 3, 4, 5] == g.search(0, 5, DEFAULT, heuristic=lambda n: 0.0)
    assert g.search(2, 5, DEFAULT, is_goal=lambda n: n in (0, 5)) == [2, 1, 0] and g.search(2, 2, DEFAULT) == [2, 2]
    assert g.search(0, 5, DEFAULT, is_goal=lambda n: False) is None
