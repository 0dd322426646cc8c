"""Readers of the map's inputs, and deterministic views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.config import DEFAULT, MapConfig
from lacuna.functions.geometry import AXES, from_key, inside_key_box, to_key
from lacuna.operators.iterate import written
from lacuna.operators.spatial import nearest_site

ODOMETRY = "robot INT, ts TIMESTAMP, frame STRING, x DOUBLE, y DOUBLE, z DOUBLE"
VOXEL = "version BIGINT, kx INT, ky INT, kz INT, depth INT, occupied BOOLEAN"
TRANSFORM = "target STRING, source STRING, r ARRAY<DOUBLE>, t ARRAY<DOUBLE>"
REQUEST = "query_id BIGINT, goal_id INT, frame STRING, sx DOUBLE, sy DOUBLE, sz DOUBLE, gx DOUBLE, gy DOUBLE, gz DOUBLE, ignore_precomputed_paths BOOLEAN"


def read_points(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A point cloud (x, y, z) from Parquet, CSV or an ASCII PCD file, whose header lines are passed over."""
    if kind == "parquet":
        return spark.read.parquet(path).select(*AXES)
    if kind == "csv":
        return spark.read.schema("x DOUBLE, y DOUBLE, z DOUBLE").csv(path)
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*[-+0-9.]"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*(parts[i].cast("double").alias(c) for i, c in enumerate(AXES)))


def replay(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """A recording (a folder of Parquet files) as a stream, some files a trigger, in order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def other_maps(maps: DataFrame, robot: int) -> DataFrame:
    """Received maps without the own one; rows of unknown robots stay."""
    return maps.where(~F.col("robot").eqNullSafe(F.lit(robot)))


def decoded(voxels: DataFrame, position: tuple[float, float, float], config: MapConfig = DEFAULT, resolution: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(voxels, obstacle points) of the newest snapshot inside the work box, whose size follows the map's resolution."""
    resolution = config.resolution if resolution is None else resolution
    half = config.box_half(resolution)
    near = newest_snapshot(voxels).where(inside_key_box(position, half, resolution))
    return near, occupied_points(near, resolution=resolution)


def newest_snapshot(voxels: DataFrame) -> DataFrame:
    """The voxels of the newest version."""
    last = voxels.agg(F.max("version").alias("version"))
    return voxels.join(F.broadcast(last), "version")  # one row


def latest_odometry(odometry: DataFrame) -> DataFrame:
    return odometry.groupBy("robot").agg(F.max_by(F.struct("frame", *AXES), "ts").alias("p"), F.max("ts").alias("ts")).select("robot", "ts", "p.*")


def occupied_points(voxels: DataFrame, where=None, finest_only: bool = False, resolution: float = DEFAULT.resolution) -> DataFrame:
    """Centres of occupied leaves; a pruned leaf is one point. finest_only: only leaves of depth 16."""
    own = voxels.where("occupied" + (" AND depth = 16" if finest_only else ""))
    centre = lambda k: (F.col(k) - 32768 + F.pow(F.lit(2.0), 16 - F.col("depth")) / 2) * resolution
    out = own.select(centre("kx").alias("x"), centre("ky").alias("y"), centre("kz").alias("z"))
    return out if where is None else out.where(where)


def dense_box(voxels: DataFrame, low: tuple, high: tuple, resolution: float = DEFAULT.resolution) -> DataFrame:
    """Keys and centres of the voxels in an inclusive key box that are occupied or unknown (without a row)."""
    if any(a > b for a, b in zip(low, high, strict=True)):
        raise ValueError("the limits of the box are inverted")
    spark = voxels.sparkSession
    grid = spark.range(low[0], high[0] + 1).select(F.col("id").cast("int").alias("kx"))
    for k, a, b in (("ky", low[1], high[1]), ("kz", low[2], high[2])):
        grid = grid.withColumn(k, F.explode(F.sequence(F.lit(a), F.lit(b))))
    own = voxels.select("kx", "ky", "kz", "occupied")
    out = grid.join(own, ["kx", "ky", "kz"], "left").where(F.coalesce("occupied", F.lit(True)))
    return out.select("kx", "ky", "kz", *(from_key(k, resolution).alias(c) for k, c in zip(("kx", "ky", "kz"), AXES, strict=True)), F.col("occupied").isNull().alias("is_unknown"))


class Views:
    """Points, obstacles, spheres, edges, trajectories and fragments from the driver's tables; see the fixtures' definitions."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: MapConfig = DEFAULT):
        self.spark, self.dir, self.config = spark, sf_dir, config
        self._safe: DataFrame | None = None
        self._vox: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def pt(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "label", *((60 * F.get("embedding", F.lit(i)).cast("double")).alias(c) for i, c in enumerate(AXES)))

    @property
    def obstacle(self) -> DataFrame:
        return self.pt.where("label < 2")

    @property
    def sphere(self) -> DataFrame:
        own = self.pt.where("label >= 2")
        near = nearest_site(own, self.obstacle, "id", self.config.radius_cap, self.config.radius_cap)
        return own.join(near, "id").select("id", F.col("label").alias("segment_id"), *AXES, F.col("odist").alias("radius"))

    @property
    def safe(self) -> DataFrame:
        """Written once: a distance join lies behind it, and edges read it twice."""
        if self._safe is None:
            self._safe = written(self.sphere.where(F.col("radius") >= self.config.min_safe))
        return self._safe

    @property
    def traj(self) -> DataFrame:
        return self.read("events").select((F.col("user_id") % 3).cast("int").alias("robot"), "ts", "event_id", (F.col("value") / 10).alias("x"), ((F.col("event_id") % 100) / 5.0).alias("y"), (F.length("event_type") / 2.0).alias("z"))

    @property
    def frag(self) -> DataFrame:
        from pyspark.sql import Window

        robot = (F.col("user_id") % 3).cast("int")
        rn = F.row_number().over(Window.partitionBy("robot").orderBy("ts", "event_id")) - 1
        own = self.read("events").select("event_id", robot.alias("robot"), "ts").withColumn("rn", rn)
        late = F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
        return own.select("event_id", "robot", "ts", "rn", F.greatest(F.floor(F.col("rn") / 6.0) - late, F.lit(0)).cast("long").alias("message_index"), (F.col("event_id") % 4).cast("int").alias("fragment_index"), F.lit(4).alias("num_total"))

    def keys(self, df: DataFrame) -> DataFrame:
        return df.select("*", *(to_key(c).cast("int").alias(f"k{c}") for c in AXES))

    @property
    def cells(self) -> DataFrame:
        """(kx, ky, kz, region): the voxels at most three keys from a safe sphere's centre in every axis, not occupied; region is the least segment."""
        grid = self.keys(self.safe)
        for k in ("kx", "ky", "kz"):
            grid = grid.withColumn(k, F.explode(F.sequence(F.col(k) - 3, F.col(k) + 3)))
        near = grid.groupBy("kx", "ky", "kz").agg(F.min("segment_id").alias("region"))
        return near.join(self.keys(self.obstacle).select("kx", "ky", "kz"), ["kx", "ky", "kz"], "left_anti")

    @property
    def vox(self) -> DataFrame:
        """Obstacles' voxels are occupied, cells are free, all else is unknown."""
        if self._vox is None:
            taken = self.keys(self.obstacle).select("kx", "ky", "kz", F.lit(True).alias("occupied")).distinct()
            both = taken.unionByName(self.cells.select("kx", "ky", "kz", F.lit(False).alias("occupied")))
            self._vox = written(both.select(F.lit(1).cast("long").alias("version"), "kx", "ky", "kz", F.lit(16).alias("depth"), "occupied"))
        return self._vox

    @property
    def leaves(self) -> DataFrame:
        """vox, and around its spheres free leaves of depth 14 wherever nothing of vox lies."""
        grid = self.keys(self.safe)
        for k in ("kx", "ky", "kz"):
            grid = grid.withColumn(k, F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda o: (F.col(k) - F.pmod(F.col(k), F.lit(4)) + 4 * o).cast("int"))))  # noqa: B023
        low = [(F.col(k) - F.pmod(F.col(k), F.lit(4))).cast("int").alias(k) for k in ("kx", "ky", "kz")]
        free = grid.select("kx", "ky", "kz").distinct().join(self.vox.select(*low).distinct(), ["kx", "ky", "kz"], "left_anti")
        return self.vox.unionByName(free.select(F.lit(1).cast("long").alias("version"), "kx", "ky", "kz", F.lit(14).alias("depth"), F.lit(False).alias("occupied")))
