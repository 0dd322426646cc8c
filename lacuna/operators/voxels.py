"""Voxel operators: frontiers, point safety, rays and visibility. Unknown voxels have no row.

Voxels are unique by key and depth; null keys are none, a null state counts as occupied. Points and rays with null
coordinates give no row. Frontiers and point safety read leaves of the finest depth; rays look pruned leaves up too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.geometry import AXES, KEY_OFFSET, to_key
from lacuna.operators.iterate import written
from lacuna.operators.spatial import top_by

KEYS = ("kx", "ky", "kz")
#: Fixed order of the six face directions.
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def offsets(table: tuple, order: str = "o") -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias(order), *(F.lit(d).alias(f"d{c}") for d, c in zip(o, AXES, strict=True))) for i, o in enumerate(table))))


def frontier(voxels: DataFrame, emit: str = "free_neighbour") -> DataFrame:
    """Unknown voxels beside free ones. emit="free_neighbour": the first free neighbour of each, in the order of FACES; "unknown"."""
    free = voxels.where("not occupied").select(*KEYS)
    near = free.withColumn("f", offsets(FACES)).select(*((F.col(k) - F.col(f"f.d{c}")).cast("int").alias(k) for k, c in zip(KEYS, AXES, strict=True)), F.col("f.o").alias("o"), *(F.col(k).alias(f"f{k}") for k in KEYS))
    near = near.join(voxels.select(*KEYS), list(KEYS), "left_anti")
    if emit == "unknown":
        return near.select(*KEYS).distinct()
    return top_by(near, list(KEYS), ["o"]).select(*KEYS, *(f"f{k}" for k in KEYS))


def coarse_unknown(voxels: DataFrame, depth: int = 14) -> DataFrame:
    """Coarse voxels with some, but not all, of their finest children known."""
    step = 1 << (16 - depth)
    low = [(F.col(k) - F.pmod(F.col(k), F.lit(step))).alias(k) for k in KEYS]
    return voxels.select(*low, F.pow(F.lit(8.0), 16 - F.col("depth")).alias("n")).groupBy(*KEYS).agg(F.sum("n").cast("long").alias("known")).where(F.col("known") < step**3)


def point_safe(points: DataFrame, voxels: DataFrame, d: float, resolution: float = 0.2) -> DataFrame:
    """(id, safe): no occupied or unknown voxel centre within d, of the cube of keys that starts at p - d/2."""
    n = int(d / resolution) + 1
    grid = points.select("id", *AXES, *(to_key(F.col(c) - d / 2, resolution).cast("int").alias(f"b{k}") for k, c in zip(KEYS, AXES, strict=True)))
    along = lambda first: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda o: (first + o).cast("int")))
    for k in KEYS:
        grid = grid.withColumn(k, along(F.col(f"b{k}")))
    own = grid.join(voxels.select(*KEYS, "occupied"), list(KEYS), "left")
    centre = sum((((F.col(k) - KEY_OFFSET + 0.5) * resolution - F.col(c)) * ((F.col(k) - KEY_OFFSET + 0.5) * resolution - F.col(c)) for k, c in zip(KEYS, AXES, strict=True)), F.lit(0.0))
    bad = F.coalesce("occupied", F.lit(True)) & (centre < d * d)
    return own.groupBy("id").agg((~F.bool_or(bad)).alias("safe"))


def _planes(a: Column, b: Column) -> Column:
    """Shares of the way from a to b at which whole numbers lie."""
    low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
    return F.when((low <= high) & (a != b), F.transform(F.sequence(low, F.greatest(high, low)), lambda p: (p - a) / (b - a))).otherwise(F.array().cast("array<double>"))


def ray_cells(rays: DataFrame, resolution: float = 0.2) -> DataFrame:
    """rays(ray, ox, oy, oz, tx, ty, tz) to (ray, step, kx, ky, kz): every voxel that the segment passes, in order.

    The crossings of each axis' grid planes are listed as shares of the length and sorted; a cell is the one of the middle of
    two crossings. All in array functions, so long rays make long rows but no shuffle.
    """
    cuts = F.array(F.lit(0.0), F.lit(1.0))
    for c in AXES:
        cuts = F.concat(cuts, _planes(F.col(f"o{c}") / resolution, F.col(f"t{c}") / resolution))
    cuts = F.array_sort(F.array_distinct(F.filter(cuts, lambda t: (t >= 0) & (t <= 1))))
    own = rays.withColumn("cuts", cuts).withColumn("m", F.transform(F.sequence(F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(1))), lambda i: (F.get("cuts", i - 1) + F.coalesce(F.get("cuts", i), F.get("cuts", i - 1))) / 2))
    own = own.select("ray", *(f"o{c}" for c in AXES), *(f"t{c}" for c in AXES), F.posexplode("m").alias("step", "s"))
    key = lambda c: to_key(F.col(f"o{c}") + (F.col(f"t{c}") - F.col(f"o{c}")) * F.col("s")).cast("int")
    return own.select("ray", "step", *(key(c).alias(k) for k, c in zip(KEYS, AXES, strict=True)))


def looked_up(cells: DataFrame, voxels: DataFrame) -> DataFrame:
    """cells(kx, ky, kz, ...) with `occupied` of the leaf that holds each, pruned leaves included; null where nothing is known.

    One equi-join for each depth that occurs (16 at most); voxels without a depth are all of the finest.
    """
    if "depth" not in voxels.columns:
        return cells.join(voxels.select(*KEYS, "occupied"), list(KEYS), "left")
    depths = sorted(r["depth"] for r in voxels.select("depth").distinct().collect())
    out, found = cells, []
    for d in depths:
        step = 1 << (16 - d)
        own = voxels.where(F.col("depth") == d).select(*(F.col(k).alias(f"v{k}") for k in KEYS), F.col("occupied").alias(f"_at{d}"))
        out = out.join(own, [(F.col(k) - F.pmod(F.col(k), F.lit(step))) == F.col(f"v{k}") for k in KEYS], "left").drop(*(f"v{k}" for k in KEYS))
        found.append(f"_at{d}")
    return out.withColumn("occupied", F.coalesce(*found) if found else F.lit(None).cast("boolean")).drop(*found)


def ray_hits(rays: DataFrame, voxels: DataFrame) -> DataFrame:
    """(ray, step, kind, last_free, kx, ky, kz): the first voxel that is no free one, and its key.

    kind is occupied or unknown; null, with a null key, where the whole ray is free. A ray of no length has one voxel.
    """
    cells = looked_up(ray_cells(rays), voxels)
    blocked = F.coalesce("occupied", F.lit(True))
    first = F.min(F.when(blocked, F.struct("step", F.when(F.col("occupied"), "occupied").otherwise("unknown").alias("kind"), *KEYS))).alias("hit")
    out = cells.groupBy("ray").agg(first, F.max("step").alias("last"))
    return out.select("ray", F.col("hit.step").alias("step"), F.col("hit.kind").alias("kind"), F.coalesce(F.col("hit.step") - 1, F.col("last")).alias("last_free"), *(F.col(f"hit.{k}").alias(k) for k in KEYS))


def cast_rays(rays: DataFrame, voxels: DataFrame) -> DataFrame:
    """(ray, step, kind, last_free): the first voxel that is no free one (kind occupied or unknown; null: the ray is free)."""
    return ray_hits(rays, voxels).drop(*KEYS)


def mutually_visible(pairs: DataFrame, voxels: DataFrame) -> DataFrame:
    return cast_rays(pairs, voxels).select("ray", F.col("step").isNull().alias("visible"))


def look(points: DataFrame, voxels: DataFrame, directions: DataFrame, reach: float) -> DataFrame:
    """(id, i, dx, dy, dz, kind) of the rays from each point in a stated, fixed set of directions: how each ends (null: free)."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work a row
    rays = points.select("id", *AXES).repartition(parts).join(F.broadcast(directions))  # the directions are a parameter, some dozen rows
    rays = rays.select(F.struct("id", "i", "dx", "dy", "dz").alias("ray"), *(F.col(c).alias(f"o{c}") for c in AXES), *((F.col(c) + F.col(f"d{c}") * reach).alias(f"t{c}") for c in AXES))
    return cast_rays(written(rays), voxels).select("ray.*", "kind")  # each end is read many times by the cells' arrays


def exploration_value(points: DataFrame, voxels: DataFrame, directions: DataFrame, reach: float) -> DataFrame:
    """Frontier data of positions: id, n_unknown, n_occupied, unknown_share, mean direction (ux, uy, uz) of the rays that end in
    unknown space, and horizontal_share, the part of that mean that is level. Points without both kinds of end are left out."""
    seen = F.col("kind") == "unknown"
    ends = look(points, voxels, directions, reach).groupBy("id").agg(F.count_if(seen).alias("n_unknown"), F.count_if(F.col("kind") == "occupied").alias("n_occupied"), F.count("*").alias("n"), *(F.avg(F.when(seen, F.col(f"d{c}"))).alias(f"u{c}") for c in AXES))
    level, whole = F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy"), F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")
    return ends.where("n_unknown > 0 and n_occupied > 0").select("id", "n_unknown", "n_occupied", (F.col("n_unknown") / F.col("n")).alias("unknown_share"), "ux", "uy", "uz", F.when(whole > 0, F.sqrt(level / whole)).otherwise(0.0).alias("horizontal_share"))


def exploration_percent(points: DataFrame, voxels: DataFrame, directions: DataFrame, reach: float = 10.0, band: float = 0.39269908169872414) -> DataFrame:
    """(id, percent) of the rays within `band` radians of the level that end in unknown space; 0 where no direction is."""
    level = directions.where(F.abs(F.asin(F.greatest(F.least("dz", F.lit(1.0)), F.lit(-1.0)))) <= band)
    share = look(points, voxels, level, reach).groupBy("id").agg((100 * F.avg(F.when(F.col("kind") == "unknown", 1.0).otherwise(0.0))).alias("percent"))
    return points.select("id").join(share, "id", "left").select("id", F.coalesce("percent", F.lit(0.0)).alias("percent"))


def frontier_scan(voxels: DataFrame, depth: int = 14) -> DataFrame:
    """Frontier voxels of the coarse voxels that are partly known: (kx, ky, kz) unknown, with the first free neighbour (fkx, ...)."""
    step = 1 << (16 - depth)
    low = [(F.col(k) - F.pmod(F.col(k), F.lit(step))).cast("int").alias(f"c{k}") for k in KEYS]
    parts = coarse_unknown(voxels, depth).select(*(F.col(k).cast("int").alias(f"c{k}") for k in KEYS))
    return frontier(voxels).select("*", *low).join(parts, [f"c{k}" for k in KEYS], "left_semi").drop(*(f"c{k}" for k in KEYS))


def with_frontier(obstacles: DataFrame, voxels: DataFrame, resolution: float = 0.2) -> DataFrame:
    """The obstacle points and the centres of the scanned frontier voxels, as one bag (x, y, z)."""
    edge = frontier_scan(voxels).select(*(((F.col(k) - KEY_OFFSET + 0.5) * resolution).alias(c) for k, c in zip(KEYS, AXES, strict=True)))
    return obstacles.select(*AXES).unionByName(edge)


def flag_frontier(spheres: DataFrame, voxels: DataFrame, directions: DataFrame, reach: float, least: float = 0.1) -> DataFrame:
    """spheres with is_frontier set where at least the share `least` of the rays ends in unknown space; others lose it."""
    share = look(spheres, voxels, directions, reach).groupBy("id").agg(F.avg(F.when(F.col("kind") == "unknown", 1.0).otherwise(0.0)).alias("share"))
    return spheres.drop("is_frontier").join(share, "id", "left").withColumn("is_frontier", F.coalesce(F.col("share") >= least, F.lit(False))).drop("share")


def touched(voxels: DataFrame, keys: DataFrame, depth: int) -> DataFrame:
    """The voxels with a leaf of the depth at each of keys (kx, ky, kz): a coarser leaf there splits into its eighths down to it.

    A key whose place is not known gets a free leaf; finer leaves at the place stay as they are.
    """
    own = keys.select(*((F.col(k) - F.pmod(F.col(k), F.lit(1 << (16 - depth)))).cast("int").alias(k) for k in KEYS)).distinct()
    above = own.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    width = F.pow(F.lit(2.0), F.lit(16) - F.col("d")).cast("int")
    above = above.select(*(F.col(k).alias(f"t{k}") for k in KEYS), F.col("d").alias("depth"), *((F.col(k) - F.pmod(F.col(k), width)).cast("int").alias(k) for k in KEYS))
    hit = above.join(voxels.where(F.col("depth") < depth), [*KEYS, "depth"])
    gone = hit.select(*KEYS, "depth").distinct()
    whole = voxels.join(gone, [*KEYS, "depth"], "left_anti")
    # Of a split leaf all eighths of every depth on the way down that hold no touched place are leaves, and the places themselves.
    others = [c for c in voxels.columns if c not in (*KEYS, "depth")]
    inner = hit.select(*KEYS, "depth", *(f"t{k}" for k in KEYS), *others)
    parents = inner.withColumn("at", F.explode(F.sequence(F.col("depth"), F.lit(depth - 1))))
    size = F.pow(F.lit(2.0), F.lit(16) - F.col("at")).cast("int")
    parents = parents.select(*((F.col(f"t{k}") - F.pmod(F.col(f"t{k}"), size)).cast("int").alias(k) for k in KEYS), F.col("at").alias("depth"), *others).distinct()
    eighth = F.pow(F.lit(2.0), F.lit(15) - F.col("depth")).cast("int")
    children = parents.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(7))))
    children = children.select(*((F.col(k) + F.call_function("shiftright", F.col("o"), F.lit(i)).bitwiseAND(1) * eighth).cast("int").alias(k) for i, k in enumerate(KEYS)), (F.col("depth") + 1).alias("depth"), *others).distinct()
    leaves = children.join(parents.select(*KEYS, "depth"), [*KEYS, "depth"], "left_anti")
    done = whole.unionByName(leaves.select(voxels.columns))
    low = [(F.col(k) - F.pmod(F.col(k), F.lit(1 << (16 - depth)))).cast("int").alias(k) for k in KEYS]
    missing = own.join(done.where(F.col("depth") >= depth).select(*low).distinct(), list(KEYS), "left_anti")
    extra = {c: F.lit(None).cast(voxels.schema[c].dataType) for c in others if c != "occupied"}
    fresh = missing.withColumns({"depth": F.lit(depth), "occupied": F.lit(False)} | extra)
    return done.unionByName(fresh.select(voxels.columns))
