"""The map update on a room with known walls."""

import pytest

from lacuna.config import DEFAULT
from lacuna.functions import geometry as geo
from lacuna.operators import graph
from lacuna.operators.tick import SPHERES, as_spheres, in_free_space, tick
from lacuna.sources.maps import occupied_points

N = (30, 20, 14)


@pytest.fixture(scope="module")
def room(spark):
    """A closed room of 6 x 4 x 2.8 m."""
    rows = [(x + 32768, y + 32768, z + 32768, 16, x in (0, N[0] - 1) or y in (0, N[1] - 1) or z in (0, N[2] - 1)) for x in range(N[0]) for y in range(N[1]) for z in range(N[2])]
    return spark.createDataFrame(rows, "kx int, ky int, kz int, depth int, occupied boolean")


def test_ticks_fill_a_room(spark, room):
    obstacles = occupied_points(room)
    start = as_spheres(spark.createDataFrame([(1.5, 1.9, 1.3, 1.0)], "x double, y double, z double, radius double"))
    directions = geo.fibonacci_directions(spark, 50)  # rays start at the vehicle, which flies on between the ticks
    state = tick(start, obstacles, (1.5, 1.9, 1.3), directions, room)
    state = tick(state.spheres, obstacles, (3.7, 1.9, 1.3), directions, room)
    assert state.spheres.dtypes == spark.createDataFrame([], SPHERES).dtypes
    own = state.spheres.collect()
    walls = [(r.x, r.y, r.z) for r in obstacles.collect()]
    assert len(own) > 4 and max(r.x for r in own) > 3
    assert len({r.key for r in own}) == len({r.id for r in own}) == len(own)
    for r in own:
        assert 0 < r.x < 6 and 0 < r.y < 4 and 0 < r.z < 2.8 and r.segment_id > 0 and r.is_safe
        assert r.radius == pytest.approx(min(3.0, min((r.x - a) ** 2 + (r.y - b) ** 2 + (r.z - c) ** 2 for a, b, c in walls) ** 0.5))
    found = graph.integrity(state.spheres, state.edges).first()
    assert (found.dangling, found.one_way) == (0, 0) and found.n_edges > 0
    assert {(r.seg, r.other) for r in state.connection.collect()} == {p for r in state.portals.collect() for p in ((r.id1, r.id2), (r.id2, r.id1))}


def test_tick_drops_what_is_unsafe_and_takes_empty_maps(spark):
    nodes = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0, 2.0), (2, 2, 1.5, 0.0, 0.0, 2.0), (3, 2, 500.0, 0.0, 0.0, 2.0)], "id long, segment_id int, x double, y double, z double, radius double")
    wall = spark.createDataFrame([(0.0, 0.5, 0.0)], "x double, y double, z double")
    none = geo.fibonacci_directions(spark, 1).where("false")
    state = tick(as_spheres(nodes), wall, (0.0, 0.0, 0.0), none)
    assert {r.id for r in state.spheres.collect()} == {2, 3}  # 1 is too near the wall; 3 is outside the work box
    empty = tick(as_spheres(nodes.where("false")), wall, (0.0, 0.0, 0.0), none)
    assert empty.spheres.count() == empty.edges.count() == empty.connection.count() == 0


def test_free_space_of_pruned_leaves(spark):
    voxels = spark.createDataFrame([(32768, 32768, 32768, 14, False), (32772, 32768, 32768, 16, True)], "kx int, ky int, kz int, depth int, occupied boolean")
    points = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, 0.79, 0.5, 0.7), (3, 0.85, 0.1, 0.1), (4, -0.1, 0.1, 0.1)], "id int, x double, y double, z double")
    assert {r.id for r in in_free_space(points, voxels).collect()} == {1, 2}
    assert in_free_space(points, voxels.where("false")).count() == 0 and in_free_space(points, None).count() == 4
    assert DEFAULT.edge_box is None


def test_staging_area_grows_one_segment(spark):
    from lacuna.operators.tick import staged

    nodes = as_spheres(spark.createDataFrame([(i, 0, i * 1.5, 0.0, 0.0, 1.0) for i in range(8)], "id long, segment_id int, x double, y double, z double, radius double"))
    edges = graph.sphere_edges(nodes)
    wall, outward = (6.5, 0.0, 0.0), (1.0, 0.0, 0.0)
    first = staged(nodes, edges, (0.0, 0.0, 0.0), wall, outward)
    assert {r.id: r.segment_id for r in first.collect()} == {i: int(i < 5) for i in range(8)}
    then = staged(first, edges, (9.0, 0.0, 0.0), wall, outward)
    got = {r.id: r.segment_id for r in then.collect()}
    assert all(got[i] == 1 for i in range(5)) and all(got[i] > 1 for i in range(5, 8))


def test_markers(spark):
    from lacuna.operators import markers

    spheres = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 0.0, 2.0)], "id long, x double, y double, z double, radius double")
    link = spark.createDataFrame([(1, 2, 1, 2, 1.0), (2, 1, 2, 1, 1.0)], "seg int, other int, own_key long, other_key long, safety double")
    line = markers.portal_markers(link, spheres).collect()
    assert len(line) == 1 and [p.x for p in line[0].points] == [0.0, 1.0]
    assert markers.point_markers(spheres, "debug", lifetime=0).first().lifetime_s is None
    asks = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 2, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0)], "query_id int, goal_id int, sx double, sy double, sz double, gx double, gy double, gz double")
    assert sorted(r.ns for r in markers.request_markers(asks).collect()) == ["path_goals", "path_goals", "path_starts"]
    arrow = markers.arrow_markers(spheres.selectExpr("id", "x", "y", "z", "0D dx", "0D dy", "1D dz"), 2.0).first()
    assert arrow.points[1].z == 2.0
    hot = markers.dwell_markers(spheres.selectExpr("id", "x", "y", "z", "id * 60D dwell"))
    assert hot.columns == markers.group_markers(spheres.selectExpr("id", "x", "y", "z", "9L weight", "id cluster")).columns
