"""Stateful operators on robots' streams, each with a batch twin over the same per-robot function."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed rules of visited positions: clearance to begin, reach of a dwell, least gap of a new node.
CLEARANCE, DWELL, GAP = 0.2, 0.2, 0.5
VISITED = "robot int, node int, x double, y double, z double, dwell_s double, odist double, links array<int>"


class Track:
    """Visited nodes [x, y, z, dwell seconds, clearance] of one robot and their links, found by cells of GAP."""

    def __init__(self, flat: list = (), links: list = (), last: float | None = None):
        self.nodes = [list(flat[i : i + 5]) for i in range(0, len(flat), 5)]
        self.links, self.last, self.cells = [list(x) for x in links], last, {}
        for i, n in enumerate(self.nodes):
            self.cells.setdefault(self.cell(n), []).append(i)

    @staticmethod
    def cell(p: list) -> tuple[int, int, int]:
        return tuple(math.floor(c / GAP) for c in p[:3])

    def around(self, p: tuple) -> list[tuple[float, int]]:
        """Nodes in the cells around p, which hold all within GAP, with their distances."""
        a, b, c = self.cell(p)
        near = (i for x in (a - 1, a, a + 1) for y in (b - 1, b, b + 1) for z in (c - 1, c, c + 1) for i in self.cells.get((x, y, z), ()))
        return sorted((math.dist(p, self.nodes[i][:3]), i) for i in near)

    def take(self, rows: pd.DataFrame, reserve: float = 0.2) -> None:
        """More positions in order of time. The time since the last position goes to the nodes within DWELL. A node is added if
        none is within GAP; the first needs a clearance over CLEARANCE. It is linked to all nodes around whose free spheres
        overlap its own by the reserve, else to the one before it. Without clearances (odist) all are taken as free."""
        clear = rows.odist if "odist" in rows else [math.inf] * len(rows)
        for ts, x, y, z, odist in zip(rows.ts, rows.x, rows.y, rows.z, clear, strict=True):
            t, p = pd.Timestamp(ts).timestamp(), (x, y, z)
            near = self.around(p)
            if self.last is not None:
                for d, i in near:
                    if d <= DWELL:
                        self.nodes[i][3] += t - self.last
            if (self.nodes or odist > CLEARANCE) and not (near and near[0][0] <= GAP):
                links = [i for d, i in near if math.isfinite(odist) and d < odist + self.nodes[i][4] - reserve]
                self.links.append(links or ([len(self.nodes) - 1] if self.nodes else []))
                self.cells.setdefault(self.cell(p), []).append(len(self.nodes))
                self.nodes.append([x, y, z, 0.0, odist])
            self.last = t

    def rows(self, robot: int) -> pd.DataFrame:
        own = [(robot, i, *n, k) for i, (n, k) in enumerate(zip(self.nodes, self.links, strict=True))]
        return pd.DataFrame(own, columns=[c.split()[0] for c in VISITED.split(", ")])


def visited_batch(positions: DataFrame) -> DataFrame:
    """Visited nodes of each robot's positions (robot, ts, event_id, x, y, z, and odist if known): a robot's track is one ordered
    group, as every step depends on the ones before; its rows have six numbers each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        track = Track()
        track.take(rows.sort_values(["ts", "event_id"]))
        return track.rows(int(rows.robot.iloc[0]))

    columns = ["robot", "ts", "event_id", "x", "y", "z"] + ["odist"] * ("odist" in positions.columns)
    return positions.select(*columns).groupBy("robot").applyInPandas(run, VISITED)


def visited_stream(positions: DataFrame) -> DataFrame:
    """The same on a stream; every trigger emits the robot's nodes so far. Late positions are taken as they come."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track = Track(*state.get) if state.exists else Track()
        track.take(pd.concat(list(batches)).sort_values(["ts", "event_id"]))
        state.update(([float(x) for n in track.nodes for x in n], track.links, track.last))
        yield track.rows(int(key[0]))

    return positions.groupBy("robot").applyInPandasWithState(run, VISITED, "nodes array<double>, links array<array<int>>, last double", "update", GroupStateTimeout.NoTimeout)


def visitation_value(points: DataFrame, visited: DataFrame, block: float = 0.2, decay: float = 0.4) -> DataFrame:
    """(id, value): 2 within `block` of a visited node, else the greatest 1 - d / decay, at least 0.

    Points in a small cell with a visited node are within `block` of it and meet no nodes one by one; only the others do, and
    repeated nodes count once.
    """
    from lacuna.operators.iterate import written
    from lacuna.operators.spatial import cell, pairs_within, shuffled

    axes = ("x", "y", "z")
    width, plain = 0.99 * block / 3**0.5, F.lit(block > 0)  # the diagonal is shorter than `block` by more than rounding can change
    for c in axes:
        plain = plain & (F.abs(c) < 1e6 * block)  # no null, no NaN, and a cell's number is exact
    at = [F.when(plain, cell(c, width)).alias(f"c{c}") for c in axes]
    finite = " and ".join(f"abs({c}) < double('inf')" for c in axes)
    sites = visited.select(*axes).where(finite).distinct()
    held = shuffled(sites.where(plain).select(*at, F.lit(True).alias("own")).distinct())
    state = written(points.select("id", *axes, *at).join(held, [f"c{c}" for c in axes], "left").select("id", *axes, "own"))
    near = pairs_within(sites, state.where("own is null").where(finite).select("id", *axes), max(block, decay)).select(F.col("b.id").alias("id"), F.sqrt("d2").alias("d"))
    best = state.where("own").select("id", F.lit(0.0).alias("d")).unionByName(near).groupBy("id").agg(F.min("d").alias("d"))
    value = F.when(F.col("d") <= block, 2.0).otherwise(1 - F.col("d") / decay)
    return state.select("id").join(shuffled(best), "id", "left").select("id", F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)).alias("value"))


COMPLETE = "robot int, message_index long, n_fragments int"


def collect_fragments(newest: int, seen: set, rows: pd.DataFrame) -> tuple[int, set, list]:
    """The newest message of a robot, its indices and the messages that became complete, after more arrivals in order."""
    done = []
    for message, index, total in zip(rows.message_index, rows.fragment_index, rows.num_total, strict=True):
        if message < newest:
            continue
        if message > newest:
            newest, seen = int(message), set()
        if index in seen:
            continue
        seen.add(int(index))
        if len(seen) == total:
            done.append((newest, int(total)))
    return newest, seen, done


def reassembly_stream(frags: DataFrame) -> DataFrame:
    """(robot, message_index, n_fragments) of messages as they become complete; late and double fragments are dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, seen = (state.get[0], set(state.get[1])) if state.exists else (-1, set())
        newest, seen, done = collect_fragments(newest, seen, pd.concat(list(batches)).sort_values(["ts", "event_id"]))
        state.update((newest, sorted(seen)))
        yield pd.DataFrame([(int(key[0]), m, n) for m, n in done], columns=["robot", "message_index", "n_fragments"])

    return frags.groupBy("robot").applyInPandasWithState(run, COMPLETE, "newest long, seen array<int>", "append", GroupStateTimeout.NoTimeout)


def drip(fragments: DataFrame, rate_hz: float = 10.0) -> DataFrame:
    """Fragments with the second at which each leaves: one a tick and robot, first in, first out."""
    n = F.row_number().over(Window.partitionBy("robot").orderBy("message_index", "fragment_index")) - 1
    return fragments.withColumn("at_s", n / rate_hz)


def newest_version(spark, path: str) -> int | None:
    """The version that the snapshot table at path holds, by the names of its folders; None before the first."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    own = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(own, default=None)


def keep_newest(spark, stream: DataFrame, path: str):
    """Snapshot sink: of each micro-batch the newest version is kept, if it is newer than the table's.

    Each version is a folder; a replayed micro-batch writes the same one again or nothing. read_newest() gives the last.
    """

    def take(batch: DataFrame, _epoch: int) -> None:
        newest, held = batch.agg(F.max("version")).first()[0], newest_version(spark, path)
        if newest is not None and (held is None or newest > held):
            batch.where(F.col("version") == newest).write.mode("overwrite").parquet(f"{path}/version={newest}")

    return stream.writeStream.foreachBatch(take)


def read_newest(spark, path: str, schema) -> DataFrame:
    """The snapshot of the newest version at path; empty before the first."""
    held = newest_version(spark, path)
    return spark.createDataFrame([], schema) if held is None else spark.read.schema(schema).parquet(f"{path}/version={held}")


def crossings(track: DataFrame) -> DataFrame:
    """Segment changes along tracks (robot, ts, event_id, segment_id): (id1, id2) with the number of crossings."""
    before = F.lag("segment_id").over(Window.partitionBy("robot").orderBy("ts", "event_id"))
    steps = track.withColumn("before", before).where("before is not null and before <> segment_id")
    return steps.groupBy(F.least("before", "segment_id").alias("id1"), F.greatest("before", "segment_id").alias("id2")).agg(F.count("*").alias("n"))


def free_crossings(track: DataFrame, cells: DataFrame, known: DataFrame | None = None, limit: float = math.inf, resolution: float = 0.2) -> DataFrame:
    """(id1, id2) of regions that some robot's track (robot, ts, event_id, x, y, z) went between, from one position straight to the
    next, both in free cells(region, kx, ky, kz) of the regions, in the last `limit` metres of its track; without pairs of `known`.

    Positions outside all cells part the track; a cell of several regions counts for the least. Null coordinates are outside.
    """
    from lacuna.functions.geometry import AXES, to_key

    keys = ("kx", "ky", "kz")
    own = cells.groupBy(*keys).agg(F.min("region").alias("region"))
    order = Window.partitionBy("robot").orderBy("ts", "event_id")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(order)) * (F.col(c) - F.lag(c).over(order)) for c in AXES), F.lit(0.0)))
    at = track.select("robot", "ts", "event_id", *AXES, *(to_key(c, resolution).cast("int").alias(k) for k, c in zip(keys, AXES, strict=True)))
    at = at.join(own, list(keys), "left").withColumns({"step": F.coalesce(step, F.lit(0.0)), "before": F.lag("region").over(order)})
    back = F.sum("step").over(Window.partitionBy("robot").orderBy(F.desc("ts"), F.desc("event_id")))
    crossed = at.withColumn("back", back).where((F.col("back") <= limit) & (F.col("before") != F.col("region")))
    found = crossed.select(F.least("before", "region").alias("id1"), F.greatest("before", "region").alias("id2")).distinct()
    return found if known is None else found.join(known.select("id1", "id2"), ["id1", "id2"], "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """left with the newest values of right at or before its time: both sides in one ordered window of the key."""
    kinds = {f.name: f.dataType for f in right.schema.fields}
    own = left.withColumns({f"r_{v}": F.lit(None).cast(kinds[v]) for v in values} | {"side": F.lit(1)})
    r = right.select(F.col(key), F.col(ts), *(F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields if f.name not in (key, ts)), *(F.col(v).alias(f"r_{v}") for v in values), F.lit(0).alias("side"))
    w = Window.partitionBy(key).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(r)
    return both.withColumns({f"r_{v}": F.last(f"r_{v}", ignorenulls=True).over(w) for v in values}).where("side = 1").drop("side")
