"""The sphere graph: edges, integrity, redundancy, connectivity and nearest nodes.

Rows with null coordinates or radii overlap nothing and are near nothing. Node ids are unique in a map; of repeated nodes the
edges repeat. Columns beside those named are kept where whole rows come out and not read elsewhere. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.config import DEFAULT, MapConfig
from lacuna.functions.geometry import AXES, connectable, packed_key, square_distance, to_key
from lacuna.operators.iterate import components, written
from lacuna.operators.spatial import pairs_within, top_by


def sphere_edges(safe: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """src, dst (both directions), s1, s2, dist, safety of the spheres that overlap enough; edge_box cuts long ones."""
    reach = 2 * config.radius_cap - config.reserve
    own = safe.select("id", "segment_id", *AXES, "radius")
    on = (F.col("a.id") != F.col("b.id")) & connectable(square_distance("a", "b"), "a.radius", "b.radius", config)
    if config.edge_box is not None:
        for c in AXES:
            on = on & (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= config.edge_box)
    return pairs_within(own, own, reach, on).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("a.segment_id").alias("s1"), F.col("b.segment_id").alias("s2"), F.sqrt("d2").alias("dist"), F.least("a.radius", "b.radius").alias("safety"))


def refresh(spheres: DataFrame, odist: DataFrame, config: MapConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """New radii and safety flags of the spheres, and their edges by the previous radii, as a map tick makes them."""
    edges = sphere_edges(spheres, config)
    fresh = spheres.drop("radius", "is_safe").join(odist, "id").withColumn("radius", F.least("odist", F.lit(config.radius_cap)))
    return fresh.withColumn("is_safe", F.col("odist") >= config.min_safe).drop("odist"), edges


def add_nodes(spheres: DataFrame, candidates: DataFrame) -> DataFrame:
    """At most one sphere a voxel: candidates go where none is, the largest (then least id) of several."""
    fresh = top_by(candidates.join(spheres.select("key"), "key", "left_anti"), ["key"], [F.desc("radius"), F.col("id")]).drop("rank")
    return spheres.unionByName(fresh.select(spheres.columns))


def purge(spheres: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without unsafe nodes and without stale ones that are no frontier; edges of what is gone go too."""
    gone = spheres.where(~F.col("is_safe") | (F.col("is_stale") & ~F.col("is_frontier"))).select("id")
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return spheres.join(gone, "id", "left_anti"), left


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of dangling and of one-way edges."""
    dangling = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("dangling"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    oneway = edges.select("src", "dst").join(back, ["src", "dst"], "left_anti").agg(F.count("*").alias("one_way"))
    return dangling.join(oneway).join(edges.agg(F.count("*").alias("n_edges")))  # three single rows


def wrong_keys(nodes: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """(n_wrong, n_shared): nodes whose key is not that of their place, and voxels with more than one node."""
    key = packed_key(*(to_key(c, config.resolution) for c in AXES)).cast("long")
    own = nodes.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("key") != key).alias("wrong"))
    return own.agg(F.coalesce(F.sum("wrong"), F.lit(0)).cast("long").alias("n_wrong"), F.count_if(F.col("n") > 1).alias("n_shared"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def points_in_map(points: DataFrame, spheres: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """Points that lie in a sphere less the reserve."""
    inner = F.col("b.radius") - config.reserve
    return pairs_within(points, spheres.select(*AXES, "radius"), config.radius_cap, square_distance("a", "b") < inner * inner, "left_semi")


def surface_candidates(points: DataFrame, spheres: DataFrame, reach: float, config: MapConfig = DEFAULT, also: Column | None = None) -> DataFrame:
    """(pid, id, segment_id, dist to the surface) of spheres whose centre is in the box of half side reach + 3 m and that meet `also`."""
    half = reach + config.radius_cap
    on = F.lit(True) if also is None else also
    for c in AXES:
        on = on & (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= half)
    own = spheres.select("id", "segment_id", *AXES, "radius")
    pairs = pairs_within(points, own, half * 3**0.5, on, width=half)
    return pairs.select(F.col("a.pid").alias("pid"), F.col("b.id").alias("id"), F.col("b.segment_id").alias("segment_id"), (F.sqrt("d2") - F.col("b.radius")).alias("dist"))


def nearest_node(points: DataFrame, spheres: DataFrame, reach: float, enforce: bool = False, config: MapConfig = DEFAULT) -> DataFrame:
    """Nearest sphere surface of each point, ties to the least id; without `enforce` the box alone bounds it, not the distance.

    The least distance comes first and its spheres by a second look: nothing sorts the pairs, of which there are many in a box.
    """
    near = surface_candidates(points, spheres, reach, config)
    near = near.where(F.col("dist") <= reach) if enforce else near
    low = written(near.groupBy("pid").agg(F.min("dist").alias("least")))
    asks = points.select("pid", *AXES).join(low.withColumnRenamed("pid", "of"), F.col("pid").eqNullSafe(F.col("of"))).drop("of")
    dist = F.sqrt(square_distance("a", "b")) - F.col("b.radius")
    best = surface_candidates(asks, spheres, reach, config, dist == F.col("a.least"))
    return best.groupBy("pid").agg(F.min(F.struct("id", "segment_id", "dist")).alias("b")).select("pid", "b.id", "b.segment_id", "b.dist")


def nearest_per_segment(points: DataFrame, spheres: DataFrame, reach: float, config: MapConfig = DEFAULT) -> DataFrame:
    """For each point and segment its nearest sphere within reach, ranked by (dist, segment); ties to the least id."""
    near = surface_candidates(points, spheres, reach, config).where(F.col("dist") <= reach)
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 62)))  # a map has no null key
    low = written(near.groupBy("pid", known("segment_id").alias("seg")).agg(F.min("dist").alias("least")).where("least is not null"))
    least = low.groupBy(F.col("pid").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("seg", "least"))).alias("least"))  # an entry a segment in reach
    asks = points.select("pid", *AXES).join(least, F.col("pid").eqNullSafe(F.col("of"))).drop("of")
    dist = F.sqrt(square_distance("a", "b")) - F.col("b.radius")
    best = surface_candidates(asks, spheres, reach, config, dist == F.try_element_at("a.least", known("b.segment_id")))
    best = best.groupBy("pid", "segment_id").agg(F.min(F.struct("id", "dist")).alias("b")).select("pid", "b.id", "segment_id", "b.dist")
    return top_by(best, ["pid"], ["dist", "segment_id"], 1 << 30)


def nearest_connectable(points: DataFrame, spheres: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """Of the spheres that a point with its own clearance connects to, the one with the least gap d - r - clearance."""
    own = spheres.select("id", *AXES, "radius")
    near = pairs_within(points, own, 2 * config.radius_cap, connectable(square_distance("a", "b"), "a.odist", "b.radius", config))
    near = near.select(F.col("a.pid").alias("pid"), F.col("b.id").alias("id"), (F.sqrt("d2") - F.col("b.radius") - F.col("a.odist")).alias("gap"))
    return top_by(near, ["pid"], ["gap", "id"]).drop("rank")


def segment_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components inside each segment: edges between segments do not count."""
    return components(nodes, edges.where("s1 = s2"))


def repair_splits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where a segment fell apart its largest part (then the one of the least node) keeps the id, the others become 0."""
    parts = nodes.join(segment_components(nodes, edges), "id")
    first = top_by(parts.groupBy("segment_id", "component").agg(F.count("*").alias("n")), ["segment_id"], [F.desc("n"), F.col("component")]).select("segment_id", "component", F.lit(True).alias("keeps"))
    return parts.join(first, ["segment_id", "component"], "left").withColumn("segment_id", F.when(F.col("keeps"), F.col("segment_id")).otherwise(0)).drop("component", "keeps")


def neighbour_connectivity(edges: DataFrame) -> DataFrame:
    """(id, n_parts) for nodes with neighbours: the parts into which its neighbours fall without it."""
    ego = edges.select(F.col("src").alias("ego"), F.col("dst").alias("n"))
    links = ego.alias("p").join(edges.alias("e"), F.col("p.n") == F.col("e.src")).join(ego.alias("q"), (F.col("q.ego") == F.col("p.ego")) & (F.col("q.n") == F.col("e.dst")))
    pair = lambda e, n: F.struct(e, n)
    links = links.select(pair(F.col("p.ego").alias("ego"), F.col("p.n").alias("n")).alias("src"), pair(F.col("q.ego").alias("ego"), F.col("q.n").alias("n")).alias("dst"))
    parts = components(ego.select(pair(F.col("ego"), F.col("n")).alias("id")), links)
    return parts.groupBy(F.col("id.ego").alias("id")).agg(F.countDistinct("component").alias("n_parts"))


def redundant(safe: DataFrame, edges: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """One pass of the redundancy rule: a neighbour of at least nearly the radius lies close, and the neighbours stay connected."""
    size = safe.select("id", "radius")
    near = edges.select("src", "dst", "dist").join(size.withColumnsRenamed({"id": "src", "radius": "r"}), "src").join(size.withColumnsRenamed({"id": "dst", "radius": "rn"}), "dst")
    covered = near.where((F.col("rn") >= F.col("r") - config.reserve) & (F.col("dist") < F.greatest(F.lit(0.2), F.col("rn") / 1.5))).select(F.col("src").alias("id")).distinct()
    return covered.join(neighbour_connectivity(edges).where("n_parts = 1").select("id"), "id")
