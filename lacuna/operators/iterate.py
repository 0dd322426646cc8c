"""Loops over tables: every round ends in files that all executors can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir. One of this machine is made only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not known.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="lacuna-map-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what written() wrote of the tables; nothing that still reads them may be left."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def greedy(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(k) of the nodes (k) that stay by the one-by-one rule: a node stays unless a link (first, then) leads to it from one that stays.

    Links must not form circles: they lead from earlier nodes to later ones. Decided in rounds: a node to which no undecided
    or staying one leads stays, what it leads to goes. A round is a few equi-joins, written; no group is gathered in a task.
    """
    links = written(links.select("first", "then"))
    state = written(nodes.select("k", F.lit(None).cast("boolean").alias("kept")))
    while True:
        free = state.where("kept is null").select("k")
        if free.isEmpty():
            forget(links)
            return state.where("kept").select("k")
        blocked = links.join(free.select(F.col("k").alias("first")), "first").select(F.col("then").alias("k")).distinct()
        keep = free.join(blocked, "k", "left_anti").withColumn("now", F.lit(True))
        out = links.join(keep.select(F.col("k").alias("first")), "first").select(F.col("then").alias("k")).distinct().withColumn("out", F.lit(True))
        after = written(state.join(keep, "k", "left").join(out, "k", "left").select("k", F.coalesce("kept", "now", F.when(F.col("out"), F.lit(False))).alias("kept")))
        forget(state)
        state = after


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(node, component): the least node that edges (src, dst, both directions) reach.

    Each round takes the least label of the neighbours and then the label of that label, so long chains halve.
    """
    held = state = written(nodes.select(F.col(node).alias("n"), F.col(node).alias("c")))
    links = written(edges.select("src", "dst").distinct())
    while True:
        near = links.join(state.select(F.col("n").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("n")).agg(F.min("c").alias("m"))
        low = state.join(near, "n", "left").select("n", "c", F.least("c", "m").alias("m"))
        jump = state.select(F.col("n").alias("m"), F.col("c").alias("cc"))
        after = written(low.join(jump, "m", "left").select("n", F.least("m", "cc").alias("c"), (F.least("m", "cc") < F.col("c")).alias("moved")))
        forget(held)
        held, state = after, after.select("n", "c")
        if after.where("moved").isEmpty():
            forget(links)
            return state.select(F.col("n").alias(node), F.col("c").alias("component"))


def shortest(start: DataFrame, edges: DataFrame, limit: float | None = None) -> DataFrame:
    """(id, dist) from start(id, dist) over edges(src, dst, w): relaxation of the nodes that improved, until none does."""
    held = best = written(start.groupBy("id").agg(F.min("dist").alias("dist")))
    edges = written(edges.groupBy("src", "dst").agg(F.min("w").alias("w")))
    front = best
    while True:
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("new"))
        if limit is not None:
            step = step.where(F.col("new") < limit)
        step = step.groupBy("id").agg(F.min("new").alias("new"))
        joined = written(best.join(step, "id", "full").select("id", F.least("dist", "new").alias("dist"), (F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))).alias("better")))
        forget(held)
        held, best, front = joined, joined.select("id", "dist"), joined.where("better").select("id", "dist")
        if front.isEmpty():
            forget(edges)
            return best


def cheapest_paths(asks: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, id, cost, path) of the cheapest path to every node that asks(q, id) reach over edges(src, dst, w); of equal costs the
    least path. Relaxation of what improved, in written rounds: no map and no request is gathered in a task."""
    held = best = written(asks.select("q", "id", F.lit(0.0).alias("cost"), F.array("id").alias("path")))
    edges = written(edges.groupBy("src", "dst").agg(F.min("w").alias("w")))
    front = best
    while True:
        step = front.join(edges, front["id"] == edges["src"]).select("q", F.col("dst").alias("id"), F.struct((F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path")).alias("new"))
        step = step.groupBy("q", "id").agg(F.min("new").alias("new"))
        old = F.when(F.col("cost").isNotNull(), F.struct("cost", "path"))
        joined = best.join(step, ["q", "id"], "full").withColumn("better", F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new.cost") < F.col("cost"))))
        joined = written(joined.withColumn("now", F.when(F.col("better"), F.col("new")).otherwise(old)).select("q", "id", "now.cost", "now.path", "better"))
        forget(held)
        held, best, front = joined, joined.drop("better"), joined.where("better").drop("better")
        if front.isEmpty():
            forget(edges)
            return best
