"""Lightweight map messages: quantised segments and portals in fragments of bounded size, and back.

Segments are unique by id; null angles and sizes give null codes. A map without segments has no fragments. Other columns
are not read. Numbering a map's segments is one task's work: 2^16 at most by the index type.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.config import DEFAULT, MapConfig
from lacuna.operators.spatial import pairs_within

#: Fixed scales of the eight-bit codes: full angle and full half size.
FULL_ANGLE, FULL_SIZE = math.pi, 50.0


def quantise(value, full: float):
    return F.floor(255 * F.least(F.greatest(value / full, F.lit(0.0)), F.lit(1.0))).cast("int")


def dense_segments(segments: DataFrame, portals: DataFrame) -> DataFrame:
    """Segments that are sent, numbered in order of id: all but those with no connection and fewer than 30 members."""
    ends = portals.select(F.col("id1").alias("segment_id")).union(portals.select("id2")).distinct()
    kept = segments.join(ends.withColumn("linked", F.lit(True)), "segment_id", "left").where("linked or n_keys >= 30").drop("linked")
    return kept.withColumn("idx", F.row_number().over(Window.orderBy("segment_id")) - 1)  # segments of one robot's map: at most 2^16 by the index type


def pack(segments: DataFrame, portals: DataFrame, config: MapConfig = DEFAULT) -> DataFrame:
    """fragment_index, kind, slot, idx/id1/id2 and codes: the closed form of filling fragments one item after another."""
    room = config.fragment_bytes - config.header_bytes
    if room < max(config.segment_bytes, 15):
        raise ValueError("the fragment limit is smaller than the largest item")
    own = dense_segments(segments, portals)
    per = room // config.segment_bytes
    count = own.agg(F.count("*").alias("n"))
    segs = own.select(F.floor(F.col("idx") / per).cast("int").alias("fragment_index"), F.lit("segment").alias("kind"), (F.col("idx") % per).alias("slot"), "idx", F.lit(None).cast("int").alias("id1"), F.lit(None).cast("int").alias("id2"), "cx", "cy", "cz", quantise(F.pmod("alpha", F.lit(math.pi)), FULL_ANGLE).alias("alpha"), *(quantise(F.col(c), FULL_SIZE).alias(c) for c in "abc"))
    number = own.select("segment_id", "idx")
    linked = portals.join(number.select(F.col("segment_id").alias("id1"), F.col("idx").alias("i1")), "id1").join(number.select(F.col("segment_id").alias("id2"), F.col("idx").alias("i2")), "id2")
    linked = linked.withColumn("p", F.row_number().over(Window.orderBy("i1", "i2")) - 1).join(F.broadcast(count))  # one row
    last = F.when(F.col("n") > 0, (F.col("n") - 1) % per + 1).otherwise(0)
    first = F.floor((room - config.segment_bytes * last) / config.portal_bytes)
    base = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / per)).otherwise(0)
    whole = room // config.portal_bytes
    after = F.col("p") - first
    frag = F.when(F.col("p") < first, base).otherwise(base + 1 + F.floor(after / whole)).cast("int")
    slot = F.when(F.col("p") < first, F.col("p")).otherwise(after % whole).cast("int")
    nil = lambda t, n: F.lit(None).cast(t).alias(n)
    ports = linked.select(frag.alias("fragment_index"), F.lit("portal").alias("kind"), slot.alias("slot"), nil("int", "idx"), F.col("i1").alias("id1"), F.col("i2").alias("id2"), *(nil("double", c) for c in ("cx", "cy", "cz")), *(nil("int", c) for c in ("alpha", "a", "b", "c")))
    return segs.unionByName(ports)


def fragments(packed: DataFrame, robot: int, message_index: int) -> DataFrame:
    """One row a fragment, as it is sent."""
    seg = F.struct("slot", "cx", "cy", "cz", "alpha", "a", "b", "c", F.lit(255).alias("coverage"))
    port = F.struct("slot", "id1", "id2")
    rows = packed.groupBy("fragment_index").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "segment", seg))).alias("segs"), F.array_sort(F.collect_list(F.when(F.col("kind") == "portal", port))).alias("portals"))
    total = packed.agg((F.max("fragment_index") + 1).alias("num_total"))
    return rows.join(F.broadcast(total)).select(F.lit(robot).alias("robot"), F.lit(message_index).cast("long").alias("message_index"), "fragment_index", "num_total", "segs", "portals")


MESSAGE = ("robot", "message_index")


def decode(frags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """robot, message_index and segments (idx over the message's sorted fragments, centre, yaw, half sizes, bounding radius),
    and portals at middle points.

    Every message is numbered by itself. A portal whose number has no segment is an error in the message and is not decoded.
    Null lists have no items; a fragment that is there twice counts twice, as reassembly drops duplicates.
    """
    flat = frags.select(*MESSAGE, "fragment_index", F.posexplode("segs").alias("pos", "s"))
    idx = F.row_number().over(Window.partitionBy(*MESSAGE).orderBy("fragment_index", "pos")) - 1
    back = lambda c, full: (F.col(f"s.{c}") * full / 255).alias(c)
    segs = flat.select(*MESSAGE, idx.alias("idx"), "s.cx", "s.cy", "s.cz", back("alpha", FULL_ANGLE), *(back(c, FULL_SIZE) for c in "abc"))
    segs = segs.withColumn("radius", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c")))
    ports = frags.select(*MESSAGE, F.explode("portals").alias("p")).select(*MESSAGE, "p.id1", "p.id2")
    named = lambda i: segs.select(*MESSAGE, F.col("idx").alias(f"id{i}"), *(F.col(f"c{c}").alias(f"{c}{i}") for c in "xyz"))
    ports = ports.join(named(1), [*MESSAGE, "id1"]).join(named(2), [*MESSAGE, "id2"]).select(*MESSAGE, "id1", "id2", *(((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(c) for c in "xyz"))
    return segs, ports


def reassemble(frags: DataFrame) -> DataFrame:
    """(robot, message_index, n_kept, complete): of each robot's arrivals (in order of ts, event_id) those older than the newest
    message so far are late, later ones of one index are duplicates; a message is complete when all its indices came in time."""
    order = Window.partitionBy("robot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    timely = frags.withColumn("newest", F.max("message_index").over(order)).where("message_index = newest")
    kept = timely.groupBy("robot", "message_index", "num_total").agg(F.countDistinct("fragment_index").alias("n_kept"))
    return kept.select("robot", "message_index", "n_kept", (F.col("n_kept") == F.col("num_total")).alias("complete"))


def membership(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, segment_id, m, p) of points inside blocks (segment_id, cx, cy, cz, alpha, a, b, c): p falls over the outer fifth.

    Blocks are joined to the points' grid cells by classes of their radii, powers of two (a few dozen at most), so that a
    large block makes no wide grid for the small ones.
    """
    radius = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    sized = blocks.where(radius > 0).withColumn("class", F.ceil(F.log2(radius)).cast("int"))
    classes = [r["class"] for r in sized.select("class").distinct().collect()]
    own = sized.select("segment_id", "class", *(F.col(f"c{c}").alias(c) for c in "xyz"), "alpha", "a", "b", "c")
    out = None
    for k in sorted(classes):
        pairs = pairs_within(points.select("id", *"xyz"), own.where(F.col("class") == k), 2.0**k * (1 + 1e-9))
        d = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"]
        u = F.abs(d[0] * F.cos("b.alpha") + d[1] * F.sin("b.alpha")) / F.col("b.a")
        v = F.abs(-d[0] * F.sin("b.alpha") + d[1] * F.cos("b.alpha")) / F.col("b.b")
        m = F.greatest(u, v, F.abs(d[2]) / F.col("b.c"))
        one = pairs.select(F.col("a.id").alias("id"), F.col("b.segment_id").alias("segment_id"), m.alias("m")).where("m < 1")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = points.select("id", F.lit(None).cast(blocks.schema["segment_id"].dataType).alias("segment_id"), F.lit(None).cast("double").alias("m")).where("false")
    return out.withColumn("p", F.least(F.lit(1.0), (1 - F.col("m")) / 0.2))


def most_probable(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, p): the greatest probability that a point belongs to some block, 0 outside all."""
    best = membership(points, blocks).groupBy("id").agg(F.max("p").alias("p"))
    return points.select("id").join(best, "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))


def exploredness(points: DataFrame, maps: DataFrame) -> DataFrame:
    """points(id, prob, ...) against the blocks of other maps (map, frontier_value, ...): prob is cut to the least over the maps of
    one less the greatest (1 - frontier_value) p over their segments."""
    inside = membership(points.select("id", "x", "y", "z"), maps.withColumn("segment_id", F.struct("map", "segment_id", "frontier_value")))
    best = inside.groupBy("id", F.col("segment_id.map").alias("map")).agg(F.max((1 - F.col("segment_id.frontier_value")) * F.col("p")).alias("best"))
    least = best.groupBy("id").agg(F.min(1 - F.col("best")).alias("least"))
    return points.join(least, "id", "left").select("id", F.least("prob", F.coalesce("least", F.lit(1.0))).alias("prob"))
