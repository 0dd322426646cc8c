"""The free-space engine on hand worlds with known answers, invariants, and streams against their batch twins."""

import datetime as dt
import math
import random

import pandas as pd
import pytest

from lacuna.config import DEFAULT
from lacuna.functions import geometry as geo
from lacuna.operators import graph, messages, paths, segments
from lacuna.operators.spatial import nearest_site, thin
from lacuna.streaming.robots import Track, collect_fragments, visitation_value, visited_batch, visited_stream

CHAIN = [(1, 0.0, 0.0, 0.0, 1.0), (2, 1.5, 0.0, 0.0, 1.0), (3, 2.6, 0.0, 0.0, 0.85), (4, 3.5, 0.0, 0.0, 1.0), (5, 0.0, 0.0, 5.0, 0.9)]


@pytest.fixture
def chain(spark):
    return spark.createDataFrame([(i, 2, x, y, z, r) for i, x, y, z, r in CHAIN], "id long, segment_id int, x double, y double, z double, radius double")


def test_chain_edges_and_path(chain):
    edges = graph.sphere_edges(chain)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]
    g = paths.Graph(chain.toPandas(), edges.toPandas())
    way = g.search(1, 4, DEFAULT)
    length, risk, least = g.summary(way, DEFAULT)
    assert way == [1, 2, 3, 4] and round(length, 6) == 3.5 and round(risk, 6) == 2.607955 and least == 0.85
    assert round(g.cost(way, DEFAULT), 6) == 133.897727
    assert g.search(1, 5, DEFAULT) is None and g.search(1, 4, DEFAULT, exact=False) == way
    found = graph.integrity(chain, edges).first()
    assert (found.dangling, found.one_way, found.n_edges) == (0, 0, 6)


@pytest.mark.parametrize("n_seg,n_por,want", [(80, 100, [[37, 0], [37, 0], [6, 100]]), (80, 300, [[37, 0], [37, 0], [6, 103], [0, 122], [0, 75]]), (37, 122, [[37, 2], [0, 120]]), (0, 0, [])])
def test_packing(spark, n_seg, n_por, want):
    segs = spark.createDataFrame([(i, 50, 0.0, 0.0, 0.0, 0.1, 1.0, 1.0, 1.0) for i in range(1, n_seg + 1)], "segment_id int, n_keys long, cx double, cy double, cz double, alpha double, a double, b double, c double")
    pairs = [(i, j) for i in range(1, n_seg + 1) for j in range(i + 1, n_seg + 1)][:n_por]
    ports = spark.createDataFrame(pairs, "id1 int, id2 int")
    rows = messages.pack(segs, ports).groupBy("fragment_index").pivot("kind", ["segment", "portal"]).count().orderBy("fragment_index").collect()
    assert [[r.segment or 0, r.portal or 0] for r in rows] == want


def test_quantisation_and_membership(spark):
    row = spark.range(1).select(messages.quantise(geo.col(12.3), 50.0).alias("a"), messages.quantise(geo.col(math.pi / 4), math.pi).alias("b")).first()
    assert (row.a, row.b) == (62, 63)
    blocks = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0)], "segment_id int, cx double, cy double, cz double, alpha double, a double, b double, c double")
    points = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 1.9, 0.0, 0.0), (3, 2.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: (round(r.m, 6), round(r.p, 6)) for r in messages.membership(points, blocks).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.95, 0.25)}


def test_reassembly_rule():
    rows = pd.DataFrame([(5, 0), (5, 1), (5, 1), (4, 2), (6, 0), (5, 2), (6, 2), (6, 1)], columns=["message_index", "fragment_index"]).assign(num_total=3)
    assert collect_fragments(-1, set(), rows)[2] == [(6, 3)]


def test_visitation(spark):
    points = spark.createDataFrame([(i, d, 0.0, 0.0) for i, d in enumerate((0.1, 0.3, 0.5))], "id long, x double, y double, z double")
    visited = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    assert [round(r.value, 6) for r in visitation_value(points, visited).orderBy("id").collect()] == [2.0, 0.25, 0.0]
    track = Track()
    track.take(pd.DataFrame(columns=["ts", "x", "y", "z"]))
    assert (track.nodes, track.last) == ([], None)


def test_nearest_nodes_sort_no_pairs(spark):
    rng = random.Random(16)
    place = lambda: [round(rng.uniform(0, 9)) * 1.0 for _ in range(3)]  # many ties
    spheres = [(i, i % 3 or None, *place(), 1.0) for i in range(150)] + [(900, 1, None, 0.0, 0.0, 1.0)]
    points = [(i, *place()) for i in range(40)] + [(90, None, 0.0, 0.0), (91, 500.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0)]
    points[0] = (0, 0.0, 0.0, 0.0)  # twice, at one place
    own = spark.createDataFrame(spheres, "id long, segment_id int, x double, y double, z double, radius double")
    asks = spark.createDataFrame(points, "pid long, x double, y double, z double")
    want, each = {}, {}
    for pid, *p in points:
        for i, seg, *q, r in spheres[:150]:
            if None not in p and all(abs(a - b) <= 5 for a, b in zip(p, q, strict=True)):
                d = math.dist(p, q) - r
                want[pid] = min(want.get(pid, (d, i)), (d, i))
                if d <= 2:
                    each[pid, seg] = min(each.get((pid, seg), (d, i)), (d, i))
    first, ranked = graph.nearest_node(asks, own, 2.0), graph.nearest_per_segment(asks, own, 2.0)
    assert {r.pid: (r.dist, r.id) for r in first.collect()} == want and first.count() == len(want)
    assert {(r.pid, r.segment_id): (r.dist, r.id) for r in ranked.collect()} == each and ranked.count() == len(each)
    assert "Window" not in first._jdf.queryExecution().executedPlan().toString()


def test_visitation_of_many_near_positions(spark, tmp_path):
    rng = random.Random(6)
    nodes = [(rng.uniform(0, 3), rng.uniform(0, 1), 0.0) for _ in range(60)] + [(0.5, 0.5, 0.0)] * 40 + [(None, 0.0, 0.0), (float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0)]
    asks = [(i, rng.uniform(-1, 4), rng.uniform(-1, 2), rng.uniform(-0.4, 0.4)) for i in range(300)] + [(900, float("nan"), 0.0, 0.0), (901, float("inf"), 0.0, 0.0), (902, None, 0.0, 0.0)]
    spark.createDataFrame(nodes, "x double, y double, z double").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame(asks, "id long, x double, y double, z double").write.parquet(str(tmp_path / "asks"))
    got = visitation_value(spark.read.parquet(str(tmp_path / "asks")), spark.read.parquet(str(tmp_path / "nodes")))
    want = {i: 0.0 for i, *_ in asks}
    for i, *p in asks[:300]:
        d = min(math.dist(p, q) for q in nodes[:100])
        want[i] = 2.0 if d <= 0.2 else max(0.0, 1 - d / 0.4)
    assert {r.id: round(r.value, 9) for r in got.collect()} == {i: round(v, 9) for i, v in want.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # above the stored size, below that of the cells around every place
    try:
        got = visitation_value(spark.read.parquet(str(tmp_path / "asks")), spark.read.parquet(str(tmp_path / "nodes")))
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_thinning_is_the_greedy_one(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 3)) for i in range(200)]
    kept = []
    for i, *p in rows:
        if all(math.dist(p, q) >= 1.5 for _, q in kept):
            kept.append((i, p))
    got = thin(spark.createDataFrame(rows, "id long, x double, y double, z double"), 1.5).select("id").collect()
    assert sorted(r.id for r in got) == [i for i, _ in kept]


def test_nearest_site_beyond_the_first_reach(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 100.0, 0.0, 0.0)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(1.0, 0.0, 0.0)], "x double, y double, z double")
    assert {r.id: r.odist for r in nearest_site(a, b, "id", 2.0).collect()} == {1: 1.0, 2: 99.0}
    assert [r.odist for r in nearest_site(a, b.limit(0), "id", 2.0).collect()] == [None, None]


def test_segmentation_covers_all_nodes(spark, chain):
    nodes = segments.segmentation(chain.drop("segment_id").selectExpr("*", "0 AS segment_id"), graph.sphere_edges(chain))
    got = {r.id: r.segment_id for r in nodes.collect()}
    assert len({got[i] for i in (1, 2, 3, 4)}) == 1 and got[5] != got[1] and min(got.values()) > 0


def test_visited_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 2, start + dt.timedelta(seconds=i), i, (i // 8) * 0.3, 0.0, 0.0) for i in range(60)]
    schema = "robot int, ts timestamp, event_id long, x double, y double, z double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = visited_stream(source).writeStream.outputMode("update").format("memory").queryName("visited").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    want = sorted(map(tuple, visited_batch(spark.read.parquet(str(tmp_path / "in"))).collect()))
    assert sorted(map(tuple, spark.table("visited").collect())) == want
