"""Marker tables for viewers: (ns, id, type, points, r, g, b, a, scale, lifetime_s).

A row gives a marker, repeated rows too; null coordinates and colours stay null. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.geometry import from_key, heat_color, segment_color
from lacuna.operators.voxels import FACES

POINT = F.struct  # of x, y, z


def marker(df: DataFrame, ns: str, number: Column, kind: str, points: Column, color: list[Column], scale, lifetime: float = 2.0, alpha: float = 1.0) -> DataFrame:
    """Lifetimes of 0 or less mean for ever, a null."""
    life = F.lit(float(lifetime) if lifetime > 0 else None).cast("double")
    r, g, b = color
    return df.select(F.lit(ns).alias("ns"), number.cast("long").alias("id"), F.lit(kind).alias("type"), points.alias("points"), r.alias("r"), g.alias("g"), b.alias("b"), F.lit(alpha).alias("a"), (scale if isinstance(scale, Column) else F.lit(float(scale))).alias("scale"), life.alias("lifetime_s"))


def at(*c: str) -> Column:
    return F.struct(*(F.col(x).alias(n) for x, n in zip(c, "xyz", strict=True)))


def sphere_markers(spheres: DataFrame) -> DataFrame:
    """Spheres, from red where they are barely safe to green."""
    share = F.least(F.greatest((F.col("radius") - 0.8) / 2.2, F.lit(0.0)), F.lit(1.0)) / 3
    return marker(spheres, "spheres", F.col("id"), "sphere", F.array(at("x", "y", "z")), heat_color(share), F.col("radius") * 2)


def edge_markers(edges: DataFrame, spheres: DataFrame) -> DataFrame:
    """A line for each directed edge."""
    named = lambda n: spheres.select(F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    own = edges.join(named("src"), "src").join(named("dst"), "dst")
    points = F.array(at("src_x", "src_y", "src_z"), at("dst_x", "dst_y", "dst_z"))
    return marker(own, "edges", F.xxhash64("src", "dst"), "line", points, [F.lit(0.0), F.lit(0.0), F.lit(1.0)], 0.05)


def segment_markers(centroids: DataFrame) -> DataFrame:
    return marker(centroids, "segments", F.col("segment_id"), "cube", F.array(at("cx", "cy", "cz")), segment_color("segment_id"), 1.0)


def block_markers(blocks: DataFrame) -> DataFrame:
    """Oriented blocks; scale is the greatest half size."""
    return marker(blocks, "blocks", F.col("segment_id"), "block", F.array(at("cx", "cy", "cz"), at("a", "b", "c")), segment_color("segment_id"), F.greatest("a", "b", "c"))


def path_markers(paths: DataFrame) -> DataFrame:
    """Lines of paths(path_id, points, min_safedist), coloured by their least distance."""
    share = F.least(F.greatest(F.col("min_safedist") / 3, F.lit(0.0)), F.lit(1.0)) / 3
    return marker(paths, "paths", F.col("path_id"), "line", F.col("points"), heat_color(share), 0.1)


def portal_markers(connection: DataFrame, spheres: DataFrame) -> DataFrame:
    """A line for each pair of connected segments, between the two spheres of their safest connection."""
    named = lambda n: spheres.select(F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz"))
    own = connection.where("seg < other").join(named("own_key"), "own_key").join(named("other_key"), "other_key")
    points = F.array(at("own_key_x", "own_key_y", "own_key_z"), at("other_key_x", "other_key_y", "other_key_z"))
    share = F.least(F.greatest(F.col("safety") / 3, F.lit(0.0)), F.lit(1.0)) / 3
    return marker(own, "portals", F.xxhash64("seg", "other"), "line", points, heat_color(share), 0.1)


def point_markers(points: DataFrame, ns: str, color: tuple[float, float, float] = (1.0, 1.0, 1.0), scale: float = 0.2, lifetime: float = 2.0) -> DataFrame:
    """points(id, x, y, z) in one colour, for obstacles, samples and debugging."""
    return marker(points, ns, F.col("id"), "point", F.array(at("x", "y", "z")), [F.lit(c) for c in color], scale, lifetime)


def dwell_markers(visited: DataFrame, longest: float = 60.0) -> DataFrame:
    """Visited places(id, x, y, z, dwell in seconds), from red for passing to green for `longest` and more."""
    share = F.least(F.greatest(F.col("dwell") / longest, F.lit(0.0)), F.lit(1.0)) / 3
    return marker(visited, "visited", F.col("id"), "sphere", F.array(at("x", "y", "z")), heat_color(share), 0.3)


def request_markers(requests: DataFrame) -> DataFrame:
    """Cubes at the start (green) and goal (red) of path requests(query_id, goal_id, sx..gz)."""
    ends = [(requests.select("query_id", *(F.col(f"s{c}").alias(c) for c in "xyz")).distinct(), F.col("query_id"), "path_starts", (0.0, 1.0, 0.0)), (requests.select("query_id", "goal_id", *(F.col(f"g{c}").alias(c) for c in "xyz")), F.xxhash64("query_id", "goal_id"), "path_goals", (1.0, 0.0, 0.0))]
    start, goal = (marker(df, ns, n, "cube", F.array(at("x", "y", "z")), [F.lit(c) for c in rgb], 0.4) for df, n, ns, rgb in ends)
    return start.unionByName(goal)


def arrow_markers(points: DataFrame, length: float = 1.0) -> DataFrame:
    """points(id, x, y, z, dx, dy, dz) as arrows along their directions."""
    tip = F.struct(*((F.col(c) + F.col(f"d{c}") * length).alias(c) for c in "xyz"))
    return marker(points, "arrows", F.col("id"), "arrow", F.array(at("x", "y", "z"), tip), [F.lit(1.0), F.lit(1.0), F.lit(0.0)], 0.1)


def group_markers(groups: DataFrame) -> DataFrame:
    """Frontier groups(id, x, y, z, weight, cluster): a sphere each, coloured by cluster, wider with the root of its weight."""
    return marker(groups, "frontier_groups", F.col("id"), "sphere", F.array(at("x", "y", "z")), segment_color("cluster"), F.sqrt("weight") / 10)


def facet_markers(faces: DataFrame, resolution: float = 0.2, as_points: bool = False) -> DataFrame:
    """Unexplored faces(region, kx, ky, kz, o; o as in FACES): an arrow out of each, or its middle as a point."""
    key = F.xxhash64("kx", "ky", "kz", "o")
    out = lambda axis: F.element_at(F.array(*(F.lit(f[axis]) for f in FACES)), F.col("o") + 1)
    centre = [from_key(k, resolution) for k in ("kx", "ky", "kz")]
    face = F.struct(*((c + out(i) * (resolution / 2)).alias(n) for i, (c, n) in enumerate(zip(centre, "xyz", strict=True))))
    tip = F.struct(*((c + out(i) * (1.5 * resolution)).alias(n) for i, (c, n) in enumerate(zip(centre, "xyz", strict=True))))
    return marker(faces, "facets", key, "point" if as_points else "arrow", F.array(face) if as_points else F.array(face, tip), segment_color("region"), resolution / 2)


def border_markers(borders: DataFrame, resolution: float = 0.2, inside: bool = False) -> DataFrame:
    """A cube for each border cell of borders(region, kx, ky, kz, is_border), or for each inner one."""
    own = borders.where(~F.col("is_border") if inside else F.col("is_border"))
    point = F.array(F.struct(*(from_key(k, resolution).alias(n) for k, n in zip(("kx", "ky", "kz"), "xyz", strict=True))))
    return marker(own, "inside" if inside else "borders", F.xxhash64("region", "kx", "ky", "kz"), "cube", point, segment_color("region"), resolution)


def nav_graph_markers(centres: DataFrame, portals: DataFrame) -> DataFrame:
    """Regions' navigation centres(region, x, y, z), and lines between those of connected regions(id1, id2) by way of their portals(x, y, z)."""
    dots = marker(centres, "nav_nodes", F.col("region"), "sphere", F.array(at("x", "y", "z")), segment_color("region"), 0.4)
    named = lambda i: centres.select(F.col("region").alias(f"id{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz"))
    own = portals.join(named(1), "id1").join(named(2), "id2")
    lines = marker(own, "nav_edges", F.xxhash64("id1", "id2"), "line", F.array(at("x1", "y1", "z1"), at("x", "y", "z"), at("x2", "y2", "z2")), [F.lit(0.0), F.lit(1.0), F.lit(0.0)], 0.1)
    return dots.unionByName(lines)


def coverage_markers(segments: DataFrame) -> DataFrame:
    """Segments(segment_id, cx, cy, cz, coverage from 0 to 1): spheres from red (not covered) to green."""
    share = F.least(F.greatest("coverage", F.lit(0.0)), F.lit(1.0)) / 3
    return marker(segments, "coverage", F.col("segment_id"), "sphere", F.array(at("cx", "cy", "cz")), heat_color(share), 0.8)
