"""One map update: new clearances, purge, repair, expansion into free space, segments and their connections."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.config import DEFAULT, MapConfig
from lacuna.functions import geometry as geo
from lacuna.functions.geometry import AXES
from lacuna.operators import graph, segments
from lacuna.operators import voxels as voxel_ops
from lacuna.operators.iterate import greedy, written
from lacuna.operators.spatial import nearest_site, pairs_within

SPHERES = "id long, segment_id int, x double, y double, z double, radius double, is_safe boolean, is_stale boolean, is_frontier boolean, key long"
KEYS = ("kx", "ky", "kz")


@dataclass(frozen=True)
class MapState:
    """Tables of one version of the map."""

    spheres: DataFrame
    edges: DataFrame
    connection: DataFrame
    portals: DataFrame


def as_spheres(nodes: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """nodes(x, y, z, radius, and id and segment_id if known) in the columns of SPHERES; ids are voxel keys where unknown."""
    key = geo.packed_key(*(geo.to_key(c, config.resolution) for c in AXES)).cast("long")
    known = set(nodes.columns)
    return nodes.select(
        (F.col("id").cast("long") if "id" in known else key).alias("id"),
        (F.col("segment_id").cast("int") if "segment_id" in known else F.lit(0)).alias("segment_id"),
        *AXES,
        F.col("radius").cast("double").alias("radius"),
        (F.col("radius") >= config.min_safe).alias("is_safe"),
        F.lit(False).alias("is_stale"),
        F.lit(False).alias("is_frontier"),
        key.alias("key"),
    )


def in_free_space(points: DataFrame, voxels: DataFrame | None, config: MapConfig = DEFAULT) -> DataFrame:
    """Points in a voxel known to be free, pruned leaves included; without voxels all of them.

    A leaf of depth d is looked up by the point's key at that depth, one equi-join for each depth that occurs (16 at most).
    """
    if voxels is None:
        return points
    free = voxels.where("not occupied").select(*(F.col(k).alias(f"v{k}") for k in KEYS), F.col("depth").cast("int").alias("depth"))
    depths = [r["depth"] for r in free.select("depth").distinct().collect()]  # 16 values at most
    if not depths:
        return points.where("false")
    own = points.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in sorted(depths)))))
    for k, c in zip(KEYS, AXES, strict=True):
        fine = geo.to_key(c, config.resolution).cast("long")
        step = F.pow(F.lit(2.0), F.lit(16) - F.col("depth")).cast("long")
        own = own.withColumn(f"p{k}", (fine - F.pmod(fine, step)).cast("long"))
    on = [F.col(f"p{k}") == F.col(f"v{k}") for k in KEYS]
    joined = own.alias("p").join(free.alias("f"), (F.col("p.depth") == F.col("f.depth")) & on[0] & on[1] & on[2], "left_semi")
    return joined.select(*points.columns)


def ray_samples(position: tuple[float, float, float], obstacles: DataFrame, directions: DataFrame, voxels: DataFrame | None = None, reach: float = 10.0, config: MapConfig = DEFAULT) -> DataFrame:
    """(n, x, y, z, odist) where rays from the position stop by, n in order of ray and step.

    The first step is 1 m, each further one as long as the whole clearance allows, 1 m at least. A ray ends in a voxel that is
    not free, where the clearance is unsafe, or at `reach`. All rays go on together, a round for each step: the tips, one for
    each direction, are a bounded table that meets all obstacles in one pass, without a shuffle of them.
    """
    spark = obstacles.sparkSession
    rays = {r["i"]: (r["dx"], r["dy"], r["dz"]) for r in directions.collect()}  # a stated, fixed set of directions
    at, found, step = dict.fromkeys(rays, 1.0), [], 0
    while at:
        at = {i: t for i, t in at.items() if t <= reach}
        tips = spark.createDataFrame([(i, *(float(p + d * t) for p, d in zip(position, rays[i], strict=True))) for i, t in at.items()], "i long, x double, y double, z double")
        tips = in_free_space(tips, voxels, config)
        d2 = geo.square_distance("a", "b")
        clear = F.broadcast(tips.alias("a")).join(obstacles.select(*AXES).alias("b")).groupBy("a.i", "a.x", "a.y", "a.z").agg(F.sqrt(F.min(d2)).alias("odist"))
        rows = clear.where(F.col("odist") >= config.min_safe).collect() if at else []  # at most one a direction
        found += [(r["i"] * 100_000 + step, r["x"], r["y"], r["z"], r["odist"]) for r in rows]
        at = {r["i"]: at[r["i"]] + max(r["odist"] - config.reserve, 1.0) for r in rows}
        step += 1
    return spark.createDataFrame(found, "n long, x double, y double, z double, odist double")


def leaf_samples(voxels: DataFrame, obstacles: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """(n, x, y, z, odist) in the middle of every pruned free leaf with a safe clearance, after all rays.

    n is in order of a share of the key's hash, then of key: leaves side by side are seldom next to each other in it, so the
    one-by-one rule has short chains and few rounds.
    """
    half = F.pow(F.lit(2.0), F.lit(16) - F.col("depth")) / 2
    key = geo.packed_key(*KEYS).cast("long")
    n = F.lit(1 << 56) + F.pmod(F.xxhash64(key), F.lit(128)) * (1 << 48) + key
    own = voxels.where("not occupied and depth <> 16").select(n.alias("n"), *(((F.col(k) - geo.KEY_OFFSET + half) * config.resolution).alias(c) for k, c in zip(KEYS, AXES, strict=True)))
    return own.join(nearest_site(own, obstacles, "n", config.radius_cap, config.radius_cap), "n").where(F.col("odist") >= config.min_safe).select("n", *AXES, "odist")


def nearness_samples(spheres: DataFrame, obstacles: DataFrame, offsets: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """(n, x, y, z, odist): the offsets (i, x, y, z; ten points of a ball, say) around every sphere, scaled by its radius, that lie
    in no sphere's inner part and have a safe clearance, n in order of sphere and offset. Offsets are a stated, fixed set."""
    many = F.broadcast(offsets.select("i", *(F.col(c).alias(f"o{c}") for c in AXES)))
    own = spheres.select("id", "radius", *AXES).join(many)
    own = own.select((F.col("id") * 1000 + F.col("i")).alias("n"), *((F.col(c) + F.col(f"o{c}") * F.col("radius")).alias(c) for c in AXES))
    out = graph.points_in_map(own, spheres, config).select("n")
    left = own.join(out, "n", "left_anti")
    return left.join(nearest_site(left, obstacles, "n", config.radius_cap, config.radius_cap), "n").where(F.col("odist") >= config.min_safe).select("n", *AXES, "odist")


def pinned(pairs: DataFrame, voxels: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """Of pairs (p, sx, sy, sz, sr, lx, ly, lz, lr) those whose small sphere is pinned by the large one: at most half its radius,
    its centre within twice the large radius, and a ray from the large centre through it that is stopped (by an occupied or
    unknown voxel) less than the small radius behind the small sphere, and not before its end."""
    d2 = sum(((F.col(f"s{c}") - F.col(f"l{c}")) * (F.col(f"s{c}") - F.col(f"l{c}")) for c in AXES), F.lit(0.0))
    near = pairs.withColumn("gap", F.sqrt(d2)).where((2 * F.col("sr") <= F.col("lr")) & (F.col("gap") < 2 * F.col("lr")) & (F.col("gap") > 0))
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work a row
    near = written(near.repartition(parts))  # the rays' arrays are built of these columns, each of which would be computed again for every part
    reach = (F.col("gap") + 2 * F.col("sr") + 2 * config.resolution) / F.col("gap")
    rays = near.select(F.struct("p", "gap", "sr", *(f"l{c}" for c in AXES)).alias("ray"), *(F.col(f"l{c}").alias(f"o{c}") for c in AXES), *((F.col(f"l{c}") + (F.col(f"s{c}") - F.col(f"l{c}")) * reach).alias(f"t{c}") for c in AXES))
    hit = voxel_ops.ray_hits(rays, voxels).where("kind is not null")
    centre = [(geo.from_key(k, config.resolution) - F.col(f"ray.l{c}")) for k, c in zip(KEYS, AXES, strict=True)]
    rest = F.sqrt(sum((x * x for x in centre), F.lit(0.0))) - F.col("ray.gap") - F.col("ray.sr")
    return hit.where((rest > 0) & (rest < F.col("ray.sr"))).select("ray.p").distinct()


def covers(a_odist: str, b_radius: str, config: MapConfig = DEFAULT):
    """Whether a larger sphere (b) covers a sample (a): its radius exceeds the clearance, and the sample lies in its inner two thirds."""
    inner = F.greatest(F.lit(0.2), F.col(b_radius) / 1.5)
    return (F.col(a_odist) < F.col(b_radius) - config.reserve) & (geo.square_distance("a", "b") < inner * inner)


def uncovered(samples: DataFrame, spheres: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """Samples that no clearly larger sphere covers."""
    return pairs_within(samples, spheres.select(*AXES, "radius"), max(0.2, config.radius_cap / 1.5), covers("a.odist", "b.radius", config), "left_anti")


def _facing(pairs: DataFrame, key) -> DataFrame:
    """Pairs a (sample), b (sphere) in the columns that pinned() takes."""
    return pairs.select(key.alias("p"), *(F.col(f"a.{c}").alias(f"s{c}") for c in AXES), F.col("a.radius").alias("sr"), *(F.col(f"b.{c}").alias(f"l{c}") for c in AXES), F.col("b.radius").alias("lr"))


def expand(spheres: DataFrame, samples: DataFrame, voxels: DataFrame | None = None, near_box: tuple | None = None, deny: tuple | None = None, spacing: float = 1.0, far_spacing: float = 2.2, config: MapConfig = DEFAULT) -> DataFrame:
    """spheres and the samples(n, x, y, z, odist) that the one-by-one rule takes in order of n.

    Samples of leaves (n from 2^56) first keep `spacing` from all earlier ones inside near_box (low, high; None: everywhere),
    `far_spacing` outside. Then a sample is taken unless it lies strictly inside the deny box (low, high; None: none), its
    voxel has a sphere, or a sphere, old or taken before it, covers it or pins it (without voxels nothing is pinned). Radii are
    cut at the cap, as the next update would. Both orders are settled in rounds of joins.
    """
    own = samples.withColumn("radius", F.least("odist", F.lit(config.radius_cap))).withColumn("key", geo.packed_key(*(geo.to_key(c, config.resolution) for c in AXES)).cast("long"))
    own = written(own)
    apart = F.lit(spacing) if near_box is None else F.when(geo.inside_box(*near_box, tuple(F.col(f"b.{c}") for c in AXES)), spacing).otherwise(far_spacing)
    close = pairs_within(own, own, max(spacing, far_spacing if near_box is not None else 0.0), (F.col("a.n") < F.col("b.n")) & (F.col("b.n") >= 1 << 56) & (geo.square_distance("a", "b") < apart * apart))
    spaced = greedy(own.select(F.col("n").alias("k")), close.select(F.col("a.n").alias("first"), F.col("b.n").alias("then")))
    own = own.join(spaced.withColumnRenamed("k", "n"), "n")
    if deny is not None:
        own = own.where(~geo.inside_box(*deny))
    own = uncovered(own.join(spheres.select("key"), "key", "left_anti"), spheres, config)
    both, small = 2 * config.radius_cap, F.col("radius") <= config.radius_cap / 2  # no others can be pinned
    if voxels is not None:
        around = pairs_within(own.where(small), spheres.select(*AXES, "radius"), both, 2 * F.col("a.radius") <= F.col("b.radius"))
        own = own.join(pinned(_facing(around, F.col("a.n")), voxels, config).withColumnRenamed("p", "n"), "n", "left_anti")
    own = written(own)
    before = F.col("b.n") < F.col("a.n")  # b was there before a
    link = (F.col("b.n").alias("first"), F.col("a.n").alias("then"))
    inner = max(config.resolution * 3**0.5, 0.2, config.radius_cap / 1.5)
    stop = pairs_within(own, own, inner, before & ((F.col("a.key") == F.col("b.key")) | covers("a.odist", "b.radius", config))).select(*link)
    if voxels is not None:
        held = pinned(_facing(pairs_within(own.where(small), own, both, before & (2 * F.col("a.radius") <= F.col("b.radius"))), F.struct(*link)), voxels, config)
        stop = stop.unionByName(held.select("p.*"))
    kept = greedy(own.select(F.col("n").alias("k")), stop.distinct())
    taken = own.join(kept.withColumnRenamed("k", "n"), "n").select(*AXES, "radius")
    return graph.add_nodes(spheres, as_spheres(taken, config))


def staged(nodes: DataFrame, edges: DataFrame, position: tuple[float, float, float], wall: tuple[float, float, float], outward: tuple[float, float, float], config: MapConfig = DEFAULT) -> DataFrame:
    """Segments while the vehicle is still inside the staging area: only segment 1 grows, on this side of the wall, at any size.

    It starts from the node nearest to the position where there is none yet. Once the position is beyond the wall the usual
    segmentation goes on, over the nodes beyond it; segment 1 stays as it is and merges with nothing.
    """
    beyond = geo.beyond_wall(wall, outward)
    outside, inside = written(nodes.where(beyond)), written(nodes.where(~beyond))
    if sum((p - w) * o for p, w, o in zip(position, wall, outward, strict=True)) > 0:
        keep = inside.unionByName(outside.where("segment_id = 1"))
        rest = outside.where("segment_id <> 1")
        left = edges.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(rest.select(F.col("id").alias("dst")), "dst", "left_semi")
        # A first segment of no member keeps id 1 taken.
        return keep.unionByName(segments.segmentation(rest.withColumn("segment_id", F.when(F.col("segment_id") > 0, F.col("segment_id")).otherwise(0)), left, config, last=1).select(nodes.columns))
    if inside.where("segment_id = 1").isEmpty():
        off = sum(((F.col(c) - p) * (F.col(c) - p) for c, p in zip(AXES, position, strict=True)), F.lit(0.0))
        first = inside.agg(F.min(F.struct(off, F.col("id"))).alias("m")).select(F.col("m.id").alias("id"), F.lit(True).alias("first"))
        inside = inside.join(F.broadcast(first), "id", "left").withColumn("segment_id", F.when(F.col("first"), 1).otherwise(F.col("segment_id"))).select(nodes.columns)  # one row
    seed = nodes.sparkSession.createDataFrame([(1,)], "segment_id int")
    return segments.grow(inside, edges, seed, float("inf"), config).select(nodes.columns).unionByName(outside)


def tick(spheres: DataFrame, obstacles: DataFrame, position: tuple[float, float, float], directions: DataFrame, voxels: DataFrame | None = None, reach: float | None = None, config: MapConfig = DEFAULT, staging: tuple | None = None, deny: tuple | None = None) -> MapState:
    """The next version of the map around a position.

    Inside the work box: clearances anew, edges by the radii of before, unsafe spheres go, covered ones too, segments that fell
    apart keep their largest part, free space is filled by ray and leaf samples, and segments spread, start and merge.
    Spheres outside the box stay as they are. Rays go from the position to the border of the box (reach: None). staging is (wall,
    outward) of a staging area, deny (low, high) of a box without new spheres. Empty tables give an empty map. Each step is written once.
    """
    config = config if config.edge_box is not None else replace(config, edge_box=3.0)
    half = config.box_half(config.resolution)
    inside = F.lit(True)
    for c, p in zip(AXES, position, strict=True):
        inside = inside & (F.abs(F.col(c) - F.lit(float(p))) <= half)
    far, near = written(spheres.where(~inside)), written(spheres.where(inside))
    places = written(obstacles.select(*AXES))
    clear = nearest_site(near, places, "id", config.radius_cap, config.radius_cap)
    fresh, edges = graph.refresh(near, clear, config)
    fresh, edges = graph.purge(written(fresh.select(near.columns)), written(edges))
    fresh, edges = written(fresh), written(edges)
    stale = graph.redundant(fresh, edges, config).select("id", F.lit(True).alias("now"))
    fresh = fresh.join(stale, "id", "left").withColumn("is_stale", F.coalesce("now", "is_stale")).select(near.columns)
    fresh, edges = graph.purge(written(fresh), edges)
    fresh, edges = written(fresh), written(edges)
    apart = graph.repair_splits(fresh.where("segment_id > 0"), edges).select(near.columns)
    fresh = written(apart.unionByName(fresh.where("segment_id <= 0 or segment_id is null")))
    samples = ray_samples(position, places, directions, voxels, half if reach is None else reach, config)
    if voxels is not None:
        samples = samples.unionByName(leaf_samples(voxels, places, config))
    box = (tuple(p - half for p in position), tuple(p + half for p in position))
    everything = written(expand(fresh, written(samples), voxels, box, deny, config=config).unionByName(far))
    edges = written(graph.sphere_edges(everything.where("is_safe"), replace(config, edge_box=None)))
    done = segments.segmentation(everything, edges, config) if staging is None else written(staged(everything, edges, position, *staging, config))
    own = done.select(F.col("id").alias("src"), F.col("segment_id").alias("s1"))
    edges = edges.drop("s1", "s2").join(own, "src").join(own.withColumnsRenamed({"src": "dst", "s1": "s2"}), "dst")
    edges = written(edges.select("src", "dst", "s1", "s2", "dist", "safety"))
    return MapState(done.select(near.columns), edges, written(segments.connections(edges)), written(segments.portals(edges)))
