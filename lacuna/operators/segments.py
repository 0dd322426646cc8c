"""Segments: centroids, connections, portals, blocks, growing and merging.

A segment of 0 or null is none: it has no connections or portals. Null coordinates count in no mean. Ties go to the least
ids as each function says. Repeated nodes count each in sizes and means. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.config import DEFAULT, MapConfig
from lacuna.functions.geometry import AXES
from lacuna.operators.iterate import written
from lacuna.operators.spatial import top_by

CENTRE = ("cx", "cy", "cz")


def centroids(nodes: DataFrame) -> DataFrame:
    """segment_id, n_keys, centre and bounding radius (greatest distance of a member)."""
    mean = nodes.groupBy("segment_id").agg(F.count("*").alias("n_keys"), *(F.avg(c).alias(f"c{c}") for c in AXES))
    off = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in AXES), F.lit(0.0))
    far = nodes.join(mean.drop("n_keys"), "segment_id").groupBy("segment_id").agg(F.sqrt(F.max(off)).alias("bounding_radius"))
    return mean.join(far, "segment_id")


def connections(edges: DataFrame) -> DataFrame:
    """Safest crossing edge of each pair of neighbouring segments, both ways; ties go to the least keys."""
    cross = edges.where("s1 <> s2 and s1 > 0 and s2 > 0").select(F.col("s1").alias("seg"), F.col("s2").alias("other"), F.col("src").alias("own_key"), F.col("dst").alias("other_key"), "safety")
    return top_by(cross, ["seg", "other"], [F.desc("safety"), F.least("own_key", "other_key"), F.greatest("own_key", "other_key")]).drop("rank")


def portals(edges: DataFrame) -> DataFrame:
    return edges.where("s1 <> s2 and s1 > 0 and s2 > 0").select(F.least("s1", "s2").alias("id1"), F.greatest("s1", "s2").alias("id2")).distinct()


def block_fit(nodes: DataFrame, margin: float = 0.5, with_radius: bool = True) -> DataFrame:
    """Yaw and half sizes of each segment's block: five rounds halve a search step around the yaw of least a * b.

    The yaws that the rounds can reach are known beforehand, so all their sizes come from one aggregation, and the rounds
    choose among them. with_radius: radii count as parts of the members (False, with a margin of 0.8, for the variant without).
    """
    mean = nodes.groupBy("segment_id").agg(*(F.avg(c).alias(f"c{c}") for c in AXES))
    r = F.col("radius") if with_radius else F.lit(0.0)
    d = nodes.join(mean, "segment_id").select("segment_id", *((F.col(c) - F.col(f"c{c}")).alias(c) for c in AXES), r.alias("r"))
    sizes: dict[str, object] = {"c": F.max(F.abs(F.col("z") + F.col("r")))}

    def search(alpha: float, step: float, rounds: int, name: str):
        """The sizes at alpha and at all yaws that later rounds can reach go to `sizes`; gives the chosen (alpha, a, b)."""
        own = F.struct(F.lit(alpha).alias("alpha"), F.col(f"a{name}").alias("a"), F.col(f"b{name}").alias("b"))
        sizes[f"a{name}"] = F.max(F.abs(F.col("x") * F.cos(F.lit(alpha)) + F.col("y") * F.sin(F.lit(alpha)) + F.col("r")))
        sizes[f"b{name}"] = F.max(F.abs(-F.col("x") * F.sin(F.lit(alpha)) + F.col("y") * F.cos(F.lit(alpha)) + F.col("r")))
        if not rounds:
            return own
        low, high = search(alpha - step, step / 2, rounds - 1, name + "l"), search(alpha + step, step / 2, rounds - 1, name + "h")
        return F.when(F.col(f"a{name}l") * F.col(f"b{name}l") <= F.col(f"a{name}h") * F.col(f"b{name}h"), low).otherwise(high)

    chosen = search(math.pi / 4, math.pi / 8, 5, "_")
    own = d.groupBy("segment_id").agg(*(x.alias(name) for name, x in sizes.items()))
    own = own.select("segment_id", chosen.alias("fit"), "c")
    return own.select("segment_id", "fit.alpha", (F.col("fit.a") + margin).alias("a"), (F.col("fit.b") + margin).alias("b"), (F.col("c") + margin).alias("c"))


def merge_candidates(nodes: DataFrame, edges: DataFrame, config: MapConfig = DEFAULT, first_only: bool = False) -> DataFrame:
    """Neighbouring segments (id1 < id2) with the radius around their common centre and whether they may merge.

    first_only: only the first segment's members count in the radius, as in the compatible mode.
    """
    pairs = portals(edges)
    one = nodes.select("segment_id", *AXES)
    ends = pairs.select("id1", "id2", F.col("id1").alias("segment_id")).unionByName(pairs.select("id1", "id2", F.col("id2").alias("segment_id")))
    members = ends.join(one, "segment_id")
    mean = members.groupBy("id1", "id2").agg(*(F.avg(c).alias(f"c{c}") for c in AXES))
    off = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in AXES), F.lit(0.0))
    far = members.join(mean, ["id1", "id2"]).where(F.col("segment_id") == F.col("id1") if first_only else F.lit(True)).groupBy("id1", "id2").agg(F.sqrt(F.max(off)).alias("radius"))
    c = centroids(nodes)
    named = lambda i: c.select(F.col("segment_id").alias(f"id{i}"), F.col("cx").alias(f"x{i}"), F.col("cy").alias(f"y{i}"), F.col("cz").alias(f"z{i}"), F.col("bounding_radius").alias(f"r{i}"))
    gap = F.sqrt(sum(((F.col(f"{a}1") - F.col(f"{a}2")) * (F.col(f"{a}1") - F.col(f"{a}2")) for a in AXES), F.lit(0.0)))
    out = far.join(named(1), "id1").join(named(2), "id2").withColumn("gap", gap)
    inside = (F.col("gap") + F.col("r1") < config.merge_radius) | (F.col("gap") + F.col("r2") < config.merge_radius)
    return out.select("id1", "id2", "radius", ((F.col("radius") <= config.merge_radius) | inside).alias("may_merge"))


def relabel(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merge segment pairs (id1, id2), no segment in two of them: the larger is master, the first on ties."""
    size = nodes.groupBy("segment_id").agg(F.count("*").alias("n"))
    named = lambda i: size.select(F.col("segment_id").alias(f"id{i}"), F.col("n").alias(f"n{i}"))
    moves = pairs.join(named(1), "id1").join(named(2), "id2")
    moves = moves.select(F.when(F.col("n1") >= F.col("n2"), F.col("id2")).otherwise(F.col("id1")).alias("segment_id"), F.when(F.col("n1") >= F.col("n2"), F.col("id1")).otherwise(F.col("id2")).alias("to"))
    return nodes.join(moves, "segment_id", "left").withColumn("segment_id", F.coalesce("to", "segment_id")).drop("to")


def merge_all(nodes: DataFrame, edges: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """Merge until no pair may: each round takes the pairs that are first at both of their segments, so none meets another."""
    nodes = written(nodes)
    links = edges.select("src", "dst")
    while True:
        own = nodes.select(F.col("id").alias("src"), F.col("segment_id").alias("s1"))
        with_segments = links.join(own, "src").join(own.withColumnsRenamed({"src": "dst", "s1": "s2"}), "dst")
        may = written(merge_candidates(nodes, with_segments, config).where("may_merge").select("id1", "id2"))
        if may.isEmpty():
            return nodes
        both = may.select(F.col("id1").alias("s"), "id1", "id2").union(may.select(F.col("id2"), "id1", "id2"))
        first = both.groupBy("s").agg(F.min(F.struct("id1", "id2")).alias("p"))
        chosen = first.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.id1", "p.id2")
        nodes = written(relabel(nodes, chosen))


def grow(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, radius: float | None = None, config: MapConfig = DEFAULT) -> DataFrame:
    """Waves from the members of the segments in seeds(segment_id): unsegmented neighbours within the radius of the centre join.

    A node that several segments reach in a wave goes to the one with the nearest centre, then the least id. The centres are
    those of all members, new at every wave. Each wave is a few joins; it ends when nothing is added.
    """
    radius = config.grow_radius if radius is None else radius
    nodes = written(nodes)
    while True:
        mean = nodes.join(seeds, "segment_id").groupBy("segment_id").agg(*(F.avg(c).alias(f"c{c}") for c in AXES))
        border = edges.select("src", "dst").join(nodes.where("segment_id > 0").select(F.col("id").alias("src"), "segment_id"), "src")
        free = nodes.where("segment_id = 0").select(F.col("id").alias("dst"), *AXES)
        off = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in AXES), F.lit(0.0))
        reach = border.join(free, "dst").join(mean, "segment_id").withColumn("off", off).where(F.col("off") <= radius * radius)
        taken = written(top_by(reach, ["dst"], ["off", "segment_id"]).select(F.col("dst").alias("id"), F.col("segment_id").alias("to")))
        if taken.isEmpty():
            return nodes
        nodes = written(nodes.join(taken, "id", "left").withColumn("segment_id", F.coalesce("to", "segment_id")).drop("to"))


def segmentation(nodes: DataFrame, edges: DataFrame, config: MapConfig = DEFAULT, last: int = 0, merge: bool = True) -> DataFrame:
    """Spread the known segments, then seed and grow new ones from what is left, then merge.

    Seeds are the nodes without a segment that have the greatest radius among such neighbours (then the least id); they take
    new ids in order of id, above `last` and all ids in use.
    """
    known = nodes.where("segment_id > 0").select("segment_id").distinct()
    nodes = grow(nodes, edges, known, config=config)
    while True:
        free = nodes.where("segment_id = 0").select("id", "radius")
        if free.isEmpty():
            break
        rank = lambda n, r: F.struct((-F.col(r)).alias("r"), F.col(n).alias("n"))
        near = edges.select("src", "dst").join(free.withColumnsRenamed({"id": "src", "radius": "r1"}), "src").join(free.withColumnsRenamed({"id": "dst", "radius": "r2"}), "dst")
        lower = near.where(rank("dst", "r2") < rank("src", "r1")).select(F.col("src").alias("id")).distinct()
        seed = written(free.join(lower, "id", "left_anti").select("id"))
        last = max(last, nodes.agg(F.max("segment_id")).first()[0] or 0)
        from pyspark.sql import Window

        block = seed.withColumn("p", F.spark_partition_id())
        number = block.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("id")))
        base = block.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        fresh = number.join(F.broadcast(base), "p").select("id", (F.col("i") + F.col("before") + last).cast("int").alias("to"))  # a row a partition
        fresh = written(fresh)
        nodes = written(nodes.join(fresh, "id", "left").withColumn("segment_id", F.coalesce("to", "segment_id")).drop("to"))
        nodes = grow(nodes, edges, fresh.select(F.col("to").alias("segment_id")), config=config)
    return merge_all(nodes, edges, config) if merge else nodes


def radius_range(nodes: DataFrame) -> DataFrame:
    """Least and greatest radius of each segment's members."""
    return nodes.where("segment_id > 0").groupBy("segment_id").agg(F.min("radius").alias("least_radius"), F.max("radius").alias("greatest_radius"))


def first_seen(changes: DataFrame) -> DataFrame:
    """(segment_id, seq) of changes(segment_id, seq): every segment once, where it came first; order by seq for the list."""
    return changes.groupBy("segment_id").agg(F.min("seq").alias("seq"))


def remove(nodes: DataFrame, connection: DataFrame, portal: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, connections and portals without the segments of gone(segment_id): members become free, and what led there goes, on both sides.

    Ids that no segment has change nothing.
    """
    gone = gone.select("segment_id").distinct()
    named = lambda c: gone.withColumnRenamed("segment_id", c)
    free = nodes.join(gone.withColumn("gone", F.lit(True)), "segment_id", "left").withColumn("segment_id", F.when(F.col("gone"), 0).otherwise(F.col("segment_id"))).select(nodes.columns)
    left = connection.join(named("seg"), "seg", "left_anti").join(named("other"), "other", "left_anti").select(connection.columns)
    return free, left, portal.join(named("id1"), "id1", "left_anti").join(named("id2"), "id2", "left_anti").select(portal.columns)


def resegmented(nodes: DataFrame, edges: DataFrame, position: tuple[float, float, float], half: float, reset: bool = False, config: MapConfig = DEFAULT) -> DataFrame:
    """Full segmentation of the free nodes in a box of half side 2 `half` around the position, segments up to 10 m (merge_radius).

    reset: segments with a member in the box of half side `half` are dissolved first (the compatible mode, False, keeps them).
    Seeds are the free nodes of greatest radius among such neighbours; nodes outside stay free. Nothing is merged.
    """
    from dataclasses import replace

    near = lambda h: F.greatest(*(F.abs(F.col(c) - F.lit(float(p))) for c, p in zip(AXES, position, strict=True))) <= h
    if reset:
        gone = nodes.where(near(half) & (F.col("segment_id") > 0)).select("segment_id").distinct().withColumn("gone", F.lit(True))
        nodes = nodes.join(gone, "segment_id", "left").withColumn("segment_id", F.when(F.col("gone"), 0).otherwise(F.col("segment_id"))).select(nodes.columns)
    nodes = written(nodes)
    last = nodes.agg(F.max("segment_id")).first()[0] or 0
    work = written(nodes.where(near(2 * half) & (F.col("segment_id") <= 0)))
    inner = edges.join(work.select(F.col("id").alias("src")), "src", "left_semi").join(work.select(F.col("id").alias("dst")), "dst", "left_semi")
    done = segmentation(work, inner, replace(config, grow_radius=config.merge_radius), last, merge=False)
    return nodes.join(work.select("id"), "id", "left_anti").select(nodes.columns).unionByName(done.select(nodes.columns))
