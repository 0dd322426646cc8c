"""Frontier groups: weighted density clustering, the best of each direction, values spread over segments.

Groups with null coordinates are near nothing, not even themselves; null weights count 0 in sums. Ids are unique. Ties go to
the least ids. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.geometry import AXES, square_distance
from lacuna.operators.iterate import components, shortest, written
from lacuna.operators.spatial import nearest_site, pairs_within, thin, top_by
from lacuna.operators.voxels import exploration_value


def dbscan(groups: DataFrame, reach: float = 6.0, least: int = 500, least_weight: int = 0) -> DataFrame:
    """(id, cluster): groups(id, x, y, z, weight) of which the weights in reach, the own twice, make `least` are core.

    Clusters are components of core groups in reach of each other, named by their least id; a border group goes to the least
    cluster in reach; the rest is -1. Groups of at most least_weight are left out first.
    """
    own = groups.where(F.col("weight") > least_weight)
    near = pairs_within(own, own, reach).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("b.weight").alias("w"))
    total = near.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("w")).join(own.select("id", "weight"), "id")
    core = total.where(F.col("w") + F.col("weight") >= least).select("id")
    links = near.select("src", "dst").join(core.select(F.col("id").alias("dst")), "dst")
    inner = links.join(core.select(F.col("id").alias("src")), "src")
    named = components(core, inner).withColumnRenamed("component", "cluster")
    border = links.join(named.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("near"))
    return own.select("id").join(named, "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))


def best_by_direction(groups: DataFrame, sectors: int = 8) -> DataFrame:
    """Of the groups (id, cluster, score, direction in radians) the best of each cluster and sector, ties to the least id."""
    sector = F.floor(F.pmod(F.col("direction"), F.lit(6.283185307179586)) / 6.283185307179586 * sectors).cast("int")
    return top_by(groups.withColumn("sector", sector), ["cluster", "sector"], [F.desc("score"), F.col("id")]).drop("rank")


def home_distance(segments: DataFrame, portal_steps: DataFrame, home: int, unreached: float = 10000.0) -> DataFrame:
    """(segment_id, dist, connected) from home over portal_steps(src, dst, w)."""
    start = segments.where(F.col("segment_id") == home).select(F.col("segment_id").alias("id"), F.lit(0.0).alias("dist"))
    found = shortest(start, portal_steps)
    return segments.select("segment_id").join(found.withColumnRenamed("id", "segment_id"), "segment_id", "left").select("segment_id", F.coalesce("dist", F.lit(unreached)).alias("dist"), F.col("dist").isNotNull().alias("connected"))


def spread_value(segments: DataFrame, portal_steps: DataFrame, source: int, most: float) -> DataFrame:
    """(segment_id, value): 1 - (distance / most)^2 within `most` of the source segment, else 0."""
    start = segments.where(F.col("segment_id") == source).select(F.col("segment_id").alias("id"), F.lit(0.0).alias("dist"))
    found = shortest(start, portal_steps, most).withColumnRenamed("id", "segment_id")
    return segments.select("segment_id").join(found, "segment_id", "left").select("segment_id", F.coalesce(1 - (F.col("dist") / most) * (F.col("dist") / most), F.lit(0.0)).alias("value"))


def groups_of(points: DataFrame, reach: float = 4.0, order: str = "id") -> DataFrame:
    """(id, x, y, z, weight): greedy groups of points(id, x, y, z) in the order given. A point farther than `reach` from all
    groups so far founds one; weight is the number of points of which it is the first group in reach."""
    heads = thin(points, reach, order=order)
    near = pairs_within(points, heads, reach, (square_distance("a", "b") < reach * reach) | (F.col("a.id") == F.col("b.id")))
    own = near.groupBy(F.col("a.id").alias("p")).agg(F.min(F.struct(F.col(f"b.{order}").alias("order"), F.col("b.id").alias("id")))["id"].alias("id"))
    return heads.select("id", *AXES).join(own.groupBy("id").agg(F.count("*").alias("weight")), "id")


def cluster_sizes(groups: DataFrame) -> DataFrame:
    """(cluster, n_groups, n_elements) of groups(cluster, weight); noise (-1) counts as a cluster of its own."""
    return groups.groupBy("cluster").agg(F.count("*").alias("n_groups"), F.sum("weight").cast("long").alias("n_elements"))


def exploration_points(groups: DataFrame, offsets: DataFrame, obstacles: DataFrame, voxels: DataFrame, directions: DataFrame, reach: float = 10.0, clearance: float = 0.8) -> DataFrame:
    """(cluster, id, x, y, z, unknown_share, ux, uy, uz): where to look at each cluster of groups(id, cluster, x, y, z) from.

    Candidates are the offsets (a cylinder's samples, say) around every group that keep `clearance` from obstacles; those
    whose rays end both in unknown space and at obstacles count, and of each cluster and sector the one that sees most is kept.
    """
    many = offsets.select(F.monotonically_increasing_id().alias("i"), *(F.col(c).alias(f"o{c}") for c in AXES))
    places = groups.where("cluster >= 0").select("cluster", F.col("id").alias("group"), *AXES).join(F.broadcast(many))  # a stated, fixed set of offsets
    places = written(places.select((F.col("group") * 10_000 + F.col("i")).alias("id"), "cluster", *((F.col(c) + F.col(f"o{c}")).alias(c) for c in AXES)))
    clear = nearest_site(places, obstacles, "id", clearance, clearance).where(F.col("odist") >= clearance)
    seen = exploration_value(places.join(clear, "id"), voxels, directions, reach)
    both = places.join(seen, "id").withColumns({"score": F.col("unknown_share"), "direction": F.atan2("uy", "ux")})
    return best_by_direction(both).select("cluster", "id", *AXES, "unknown_share", "ux", "uy", "uz")
