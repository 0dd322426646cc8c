"""Extendible hashing of rows into shards of bounded size.

A directory is indexed by the first bits of a row's hash; only a bucket over its byte limit splits, on one more bit, until
every shard fits. The splits of many levels are taken at once from a histogram of hash prefixes, whose size follows the
number of shards and not of rows; buckets that are still too large at its depth get a deeper histogram of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialise

#: Hash bits from the key, and further bits from key and row, which part rows of one key.
BITS = 60
STEP = 8
DENSE = 24


def hash_bits(text: Column) -> Column:
    """The first 60 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: Column | int, part: int) -> Column:
    """First (part 1) or second half of the first `depth` bits of (h1, h2)."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    if part == 1:
        return F.call_function("shiftright", F.col("h1"), F.greatest(F.lit(BITS) - d, F.lit(0)).cast("int"))
    return F.when(d > BITS, F.call_function("shiftright", F.col("h2"), (F.lit(2 * BITS) - F.greatest(d, F.lit(BITS))).cast("int"))).otherwise(F.lit(0).cast("long"))


def shard_rows(docs: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """One row per input row: the key, n_bytes, shard (depth and bits), depth, shard_bytes, shard_rows, oversized.

    A shard holds at most `limit` bytes; only a row that is larger by itself stands over it, alone and marked oversized.
    Rows with equal keys share a shard if they fit, and part by row hash if they don't, however many they are. A null key
    hashes as an empty text, a null size counts 0. An empty table gives no rows; other columns are not read.
    """
    size = F.octet_length("text") if size is None else size
    rows = docs.select(F.col(key).alias("k"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"))
    text = F.coalesce(F.col("k").cast("string"), F.lit(""))
    rows = rows.select("*", hash_bits(text).alias("h1"), hash_bits(F.concat_ws("#", text, F.monotonically_increasing_id().cast("string"))).alias("h2"))
    rows = materialise(rows, "shard-rows")
    small, large = rows.where(F.col("n_bytes") <= limit), rows.where(F.col("n_bytes") > limit)
    total = small.agg(F.sum("n_bytes")).first()[0] or 0
    low, depth = -1, min(DENSE, max(1, math.ceil(math.log2(max(total, 1) / limit)) + 3) if total > limit else 1)
    out = large.select("k", "n_bytes", F.concat(F.lit("row-"), F.col("h1"), F.lit("-"), F.col("h2")).alias("shard"), F.lit(2 * BITS).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows"), F.lit(True).alias("oversized"))
    while True:
        cells = small.groupBy(_prefix(depth, 1).alias("c1"), _prefix(depth, 2).alias("c2")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = materialise(cells, "shard-cells")
        full = cells.withColumns({"h1": F.call_function("shiftleft", F.col("c1"), F.lit(max(BITS - depth, 0))), "h2": F.call_function("shiftleft", F.col("c2"), F.lit(2 * BITS - max(depth, BITS)))})
        levels = full.select("c1", "c2", "h1", "h2", "b", "n", F.explode(F.sequence(F.lit(low + 1), F.lit(depth))).alias("d")).withColumns({"p1": _prefix(F.col("d"), 1), "p2": _prefix(F.col("d"), 2)})
        sums = levels.groupBy("d", "p1", "p2").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")).where(F.col("shard_bytes") <= limit)
        sums = materialise(sums, "shard-sums")
        first = F.min(F.struct("d", "p1", "p2", "shard_bytes", "shard_rows")).alias("own")
        least = sums.agg(F.min("d")).first()[0]  # no shard is shorter, and the prefixes of few bits would meet in few tasks
        directory = levels.where(F.col("d") >= F.lit(depth if least is None else least)).select("c1", "c2", "d", "p1", "p2").join(sums, ["d", "p1", "p2"]).groupBy("c1", "c2").agg(first)
        here = small.withColumns({"c1": _prefix(depth, 1), "c2": _prefix(depth, 2)})
        shard = F.concat_ws("-", F.col("own.d"), F.col("own.p1"), F.when(F.col("own.d") > BITS, F.col("own.p2")))
        out = out.unionByName(here.join(directory, ["c1", "c2"]).select("k", "n_bytes", shard.alias("shard"), F.col("own.d").alias("depth"), "own.shard_bytes", "own.shard_rows", F.lit(False).alias("oversized")))
        over = cells.where(F.col("b") > limit).select("c1", "c2")
        if over.isEmpty():
            return out.withColumnRenamed("k", key)
        if depth >= 2 * BITS:
            raise ValueError("rows beyond the limit share all their hash bits")
        small = materialise(here.join(over, ["c1", "c2"], "left_semi").drop("c1", "c2"), "shard-deeper")
        low, depth = depth, min(depth + STEP, 2 * BITS)
