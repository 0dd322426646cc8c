"""The map service on streams: gated ticks over versioned tables, throttled sending, timed publishing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lacuna.config import DEFAULT, MapConfig
from lacuna.operators import messages, segments
from lacuna.operators.tick import SPHERES, MapState, tick

#: Fixed rates: how often each part of the service runs.
TRIGGERS = {"obstacles": "1 second", "map": "500 milliseconds", "visited": "500 milliseconds", "markers": "1 second", "received": "334 milliseconds", "drip": "100 milliseconds"}
PARTS = ("spheres", "edges", "connection", "portals")


class MapStore:
    """Versions of the map as folders; a version counts once its status file is there, so a task or driver lost in between leaves the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def status(self, version: int) -> dict | None:
        name = f"version={version}/status"
        if not self._fs.exists(self._at(name)):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])

    def newest(self) -> int | None:
        if not self._fs.exists(self._at("")):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        own = (int(n.removeprefix("version=")) for n in names if n.startswith("version="))
        return max((v for v in own if self.status(v) is not None), default=None)

    def read(self, version: int | None) -> MapState | None:
        return None if version is None else MapState(*(self.spark.read.parquet(f"{self.path}/version={version}/{p}") for p in PARTS))

    def write(self, version: int, state: MapState, status: dict) -> None:
        for p in PARTS:
            getattr(state, p).write.mode("overwrite").parquet(f"{self.path}/version={version}/{p}")
        self.spark.createDataFrame([(json.dumps(status),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/version={version}/status")

    def sent(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}/sent")


def map_tick(store: MapStore, snapshot: Callable[[], tuple[DataFrame, DataFrame] | None], directions: DataFrame, robot: int = 0, config: MapConfig = DEFAULT, fixed: bool = False) -> Callable[[DataFrame, int], None]:
    """The batch function of a tick: of a micro-batch of odometry (ts, x, y, z) the newest position updates the map.

    Nothing happens before there is odometry, a snapshot (voxels, obstacles; None: not received yet) and an obstacle in it, nor
    while `fixed` holds the map for navigation. Versions are named by epoch, so a replayed micro-batch is done once. A map of
    more than one segment is sent if the last sending lies over send_interval_s back, by the times of the odometry.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        last = batch.where("x is not null and y is not null and z is not null").agg(F.max(F.struct("ts", "x", "y", "z")).alias("p")).first()["p"]
        known = snapshot()
        if fixed or last is None or known is None or known[1].isEmpty() or store.status(epoch) is not None:
            return
        before = store.newest()
        old = store.read(before)
        spheres = store.spark.createDataFrame([], SPHERES) if old is None else old.spheres
        if old is None:
            spheres = first_sphere(store.spark, known[1], (last["x"], last["y"], last["z"]), config)
        state = tick(spheres, known[1], (last["x"], last["y"], last["z"]), directions, known[0], config=config)
        now, sent = last["ts"].timestamp(), (store.status(before) or {}).get("sent") if before is not None else None
        many = state.spheres.where("segment_id > 0").select("segment_id").distinct().limit(2).count() > 1
        if many and (sent is None or now - sent > config.send_interval_s):
            own = segments.centroids(state.spheres.where("segment_id > 0")).join(segments.block_fit(state.spheres.where("segment_id > 0")), "segment_id")
            messages.fragments(messages.pack(own, state.portals, config), robot, epoch).write.mode("overwrite").parquet(f"{store.path}/version={epoch}/sent")
            sent = now
        store.write(epoch, state, {"ts": now, "sent": sent})

    return take


def first_sphere(spark: SparkSession, obstacles: DataFrame, position: tuple[float, float, float], config: MapConfig = DEFAULT) -> DataFrame:
    """The map before its first tick: a sphere at the position, with its clearance."""
    from lacuna.operators.spatial import nearest_site
    from lacuna.operators.tick import as_spheres

    here = spark.createDataFrame([(0, *map(float, position))], "k int, x double, y double, z double")
    return as_spheres(here.join(nearest_site(here, obstacles, "k", config.radius_cap, config.radius_cap), "k").withColumnRenamed("odist", "radius").drop("k"), config)


def tick_stream(odometry: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Ticks on a stream of odometry, at the map's rate."""
    return odometry.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=TRIGGERS["map"])


def publish_stream(clock: DataFrame, store: MapStore, views: dict[str, Callable[[MapState], DataFrame]], path: str, checkpoint: str) -> DataStreamWriter:
    """At the markers' rate, every view of the newest map that has a subscriber, into a folder of its own; views are made on demand."""

    def take(_batch: DataFrame, epoch: int) -> None:
        state = store.read(store.newest())
        if state is not None:
            for name, view in views.items():
                view(state).write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")

    return clock.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=TRIGGERS["markers"])


def message_counters(frags: DataFrame) -> DataFrame:
    """(robot, n_messages, n_fragments, n_rebuilt) of arrivals: messages and fragments seen, and messages whose indices are 0 to
    n - 1, which a receiver rebuilds; doubles count once."""
    own = frags.groupBy("robot", "message_index").agg(F.countDistinct("fragment_index").alias("n"), F.max("num_total").alias("total"), F.min("fragment_index").alias("low"), F.max("fragment_index").alias("high"))
    whole = (F.col("n") == F.col("total")) & (F.col("low") == 0) & (F.col("high") == F.col("total") - 1)
    return own.groupBy("robot").agg(F.count("*").alias("n_messages"), F.sum("n").cast("long").alias("n_fragments"), F.count_if(whole).alias("n_rebuilt"))
