"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and every vector is filed under its leaf; leaves with too many vectors are fitted
further, each on a sample of its own, so the tree grows with the corpus up to a fixed number of nodes. A query takes nodes from a priority queue by
their distance, so leaves come out in the order of promise; how many it visits is widened until a calibration against brute
force over all rows reaches the recall aimed at. Equal vectors are filed once, with the ids that an answer can hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._memory import returning
from ._store import discard, materialise
from .jaccard_join import _groups

#: Vectors that the tree is fitted on, branches of a node, sample vectors in a leaf.
SAMPLE, BRANCH, LEAF = 20_000, 8, 160
#: Vectors of a leaf beyond which it is fitted further; all samples of one such round; bytes of centres, which are broadcast.
FULL, ROUND, CENTRES = 4_000, 100_000, 64 << 20
#: Distinct queries whose neighbours calibrate the number of leaves.
TRIALS, RECALL = 256, 0.95
#: Vectors and queries of one leaf that are compared in one group.
BLOCK = 20_000


@dataclass
class Tree:
    """centre of every node; first and last + 1 child (0, 0: a leaf); leaf number or -1."""

    centre: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray) -> Tree:
        return cls(x.mean(axis=0)[None, :], np.zeros((1, 2), dtype=np.int64), np.zeros(1, dtype=np.int64)).grown({0: x})

    def grown(self, samples: dict[int, np.ndarray], seed: int = 3) -> Tree:
        """The tree with subtrees under the leaves of the samples, fitted on them; leaves are numbered anew."""
        rng = np.random.default_rng(seed)
        centre, children = list(self.centre), [tuple(c) for c in self.children.tolist()]
        node_of = np.flatnonzero(self.leaf >= 0)
        parts = [(int(node_of[leaf]), x) for leaf, x in sorted(samples.items())]
        while parts:
            node, points = parts.pop(0)
            if len(points) <= LEAF:
                continue
            middle = points[rng.choice(len(points), BRANCH, replace=False)]
            for _ in range(10):
                label = ((middle**2).sum(axis=1) - 2 * points @ middle.T).argmin(axis=1)
                middle = np.stack([points[label == k].mean(axis=0) if (label == k).any() else middle[k] for k in range(BRANCH)])
            label = ((middle**2).sum(axis=1) - 2 * points @ middle.T).argmin(axis=1)
            used = np.unique(label)
            if len(used) < 2:
                continue
            children[node] = (len(centre), len(centre) + len(used))
            for k in used:
                parts.append((len(centre), points[label == k]))
                centre.append(middle[k])
                children.append((0, 0))
        array = np.array(children)
        return Tree(np.array(centre), array, np.where(array[:, 1] == 0, np.cumsum(array[:, 1] == 0) - 1, -1))

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by the nearest child at every node."""
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.unique(at[self.leaf[at] < 0])
            if not len(inner):
                return self.leaf[at]
            for node in inner.tolist():
                own = np.flatnonzero(at == node)
                a, b = self.children[node]
                c = self.centre[a:b]
                at[own] = a + ((c**2).sum(axis=1) - 2 * x[own] @ c.T).argmin(axis=1)

    def visit(self, q: np.ndarray, most: int, held: np.ndarray, ids: int) -> list[int]:
        """`most` leaves, best bin first, and more until those visited hold `ids` filed ids; held: filed ids of each leaf."""
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < ids):
            _, node = heapq.heappop(queue)
            a, b = self.children[node]
            if b == 0:
                out.append(int(self.leaf[node]))
                seen += int(held[out[-1]])
                continue
            d = ((self.centre[a:b] - q) ** 2).sum(axis=1)
            for k in range(b - a):
                heapq.heappush(queue, (float(d[k]), int(a + k)))
        return out


def usable(vector: Column, size: int) -> Column:
    """Vectors of `size` finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _file(batches: Iterator[pa.RecordBatch], tree: Tree, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf = tree.file(_unit(_matrix(batch.column("v"), size))) if batch.num_rows else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], [*batch.schema.names, "leaf"])


def _visit(batches: Iterator[pa.RecordBatch], tree: Tree, size: int, most: int, held: np.ndarray, ids: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            leaves = [tree.visit(q, most, held, ids) for q in _unit(_matrix(batch.column("v"), size))]
            rows = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array([x for own in leaves for x in own], pa.int64())], [*batch.schema.names, "leaf"])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows, in double precision, whatever stands in the other rows; powers of two keep squares in range, exactly."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(q: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the rows of x that can be among the k best, with their scores."""
    rough = _unit(q) @ _unit(x).T
    edge = np.partition(rough, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -2.0)
    out = []
    for i in range(len(q)):
        own = np.flatnonzero(rough[i] >= edge[i] - 1e-9)
        out.append((own, cosine(np.broadcast_to(q[i], (len(own), q.shape[1])), x[own])))
    return out


def _brute(batches: Iterator[pa.RecordBatch], trials: np.ndarray, k: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = _best(trials, _matrix(batch.column("v"), size), k)
            leaf = batch.column("leaf").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(found)), [len(o) for o, _ in found])), pa.array(np.concatenate([s for _, s in found])), pa.array(np.concatenate([leaf[o] for o, _ in found]))], ["trial", "score", "leaf"])


def _compare(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """For each cell, its queries (kind 0) against its vectors (kind 1): k best ids by score, then id."""
    for group in _groups(batches):
        kind = group.column("kind").to_numpy()
        queries, rows = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
        if not len(queries) or not len(rows):
            continue
        x, ids = _matrix(rows.column("v"), size), rows.column("ids").to_pylist()
        w1, w2 = queries.column("w1").to_pylist(), queries.column("w2").to_pylist()
        a, b, c, d = [], [], [], []
        q = _matrix(queries.column("v"), size)
        for at in range(0, len(q), 256):
            for i, (own, score) in enumerate(_best(q[at : at + 256], x, k), at):
                hits = sorted((-s, y) for s, j in zip(score.tolist(), own.tolist(), strict=True) for y in ids[j])[:k]
                a += [w1[i]] * len(hits)
                b += [w2[i]] * len(hits)
                c += [y for _, y in hits]
                d += [-s for s, _ in hits]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["w1", "w2", "vec_id", "score"])


def planted(index: DataFrame, size: int):
    """(broadcast tree, index with leaves, filed ids of each leaf) over the distinct vectors; None if there are none."""
    spark = index.sparkSession
    sample = index.orderBy("w1", "w2").limit(SAMPLE).select("v").toArrow()
    if not len(sample):
        return None
    tree = Tree.fit(_unit(_matrix(sample.column("v"), size)))
    files = "w1 long, w2 int, v array<double>, ids array<long>, leaf long"
    while True:
        shared = spark.sparkContext.broadcast(tree)
        filed = materialise(index.mapInArrow(returning(lambda b, t=shared: _file(b, t.value, size)), files), "index")
        leaves = filed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"))
        count = {r["leaf"]: (r["n"], r["ids"]) for r in leaves.collect()}  # a row for each leaf, so at most the nodes of the tree
        held = np.array([count.get(k, (0, 0))[1] for k in range(int(tree.leaf.max()) + 1)])
        full = {leaf: n for leaf, (n, _) in count.items() if n > FULL}
        share = min(ROUND // max(len(full), 1), 10 * LEAF)
        if not full or share <= LEAF or tree.centre.nbytes >= CENTRES:
            return shared, filed, held
        shares = spark.createDataFrame([(leaf, share / n) for leaf, n in full.items()], "leaf long, share double")
        some = filed.join(F.broadcast(shares), "leaf").where(F.xxhash64("w1", "w2") / 2.0**64 + 0.5 <= F.col("share")).select("leaf", "v").toArrow()
        x, own = _unit(_matrix(some.column("v"), size)), some.column("leaf").to_numpy()
        more = tree.grown({leaf: x[own == leaf] for leaf in full})
        if len(more.centre) == len(tree.centre):  # what is left cannot be parted
            return shared, filed, held
        tree = more
        discard(filed)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", size: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each query row, by cosine, ties to the smaller id.

    Scores are of the original vectors, in double precision. Vectors that are null, zero, of another length than `size` (None:
    the most frequent length of usable rows, of equals the smaller) or with null or non-finite components take no part, nor do
    null ids. A row is no candidate for its own id; rows repeated with equal id and vector count once. Fewer candidates give
    fewer rows; an empty table gives none. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    if size is None:
        lengths = rows.where(usable(F.col("v"), F.size("v"))).groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n"))
        first = lengths.agg(F.max_by("s", F.struct("n", -F.col("s")))).first()[0]
        size = first or 1
    rows = rows.where(usable(F.col("v"), size)).withColumns({"w1": F.xxhash64("v"), "w2": F.hash("v")})
    rows = materialise(rows, "vectors")
    # An answer takes at most k ids, and its own is none of them, so k + 1 of equal vectors' ids are enough.
    rank = F.row_number().over(Window.partitionBy("w1", "w2", "v").orderBy("id"))
    once = rows.select("id", "v", "w1", "w2").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    index = once.groupBy("w1", "w2", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = materialise(index, "distinct")
    found = planted(index, size)
    out = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return spark.createDataFrame([], out)
    discard(index)
    tree, index, held = found
    asks = rows.where("asks").select("w1", "w2", "v").distinct()
    most = calibrate(index, asks, tree, k, recall, size, held)
    visits = materialise(asks.mapInArrow(returning(lambda b: _visit(b, tree.value, size, most, held, k + 1)), "w1 long, w2 int, v array<double>, leaf long"), "visits")
    # A leaf's vectors and queries are dealt into blocks, each pair of blocks a cell of bounded size.
    many = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    blocks = F.broadcast(many(index, "m").join(many(visits, "n"), "leaf"))  # at most a row for each leaf, whose number is bounded
    mine = lambda n: F.pmod(F.col("w1"), F.col(n))
    name = lambda i, j: F.xxhash64("leaf", i, j).alias("cell")
    left = visits.join(blocks, "leaf").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i")).select(name(F.col("i"), mine("n")), F.lit(0).alias("kind"), "w1", "w2", "v", F.array().cast("array<long>").alias("ids"))
    right = index.join(blocks, "leaf").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).select(name(mine("m"), F.col("j")), F.lit(1).alias("kind"), "w1", "w2", "v", "ids")
    cells = left.unionByName(right).repartition("cell").sortWithinPartitions("cell")
    hits = cells.mapInArrow(returning(lambda b: _compare(b, k + 1, size)), "w1 long, w2 int, vec_id long, score double")
    order = Window.partitionBy("w1", "w2").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    answers = rows.where("asks").select(F.col("id").alias("query_id"), "w1", "w2").distinct().join(hits, ["w1", "w2"]).where("query_id <> vec_id")
    own = Window.partitionBy("query_id", "w1", "w2").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(index: DataFrame, asks: DataFrame, tree, k: int, recall: float, size: int, held: np.ndarray) -> int:
    """Leaves to visit: widened from 1 until trial queries find the share `recall` of their true neighbours.

    The trials are the TRIALS distinct queries with the least hashes; their true neighbours come from all rows.
    """
    trials = asks.orderBy("w1", "w2").limit(TRIALS).select("v").toArrow()
    if not len(trials):
        return 1
    q = _matrix(trials.column("v"), size)
    shared = index.sparkSession.sparkContext.broadcast(q)
    found = index.select("v", "leaf").mapInArrow(returning(lambda b: _brute(b, shared.value, k + 1, size)), "trial long, score double, leaf long")
    best = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "leaf"))
    true: dict[int, list[int]] = {}
    for row in found.withColumn("r", best).where(F.col("r").between(2, k + 1)).collect():  # at most k rows a trial; the first is the query
        true.setdefault(row["trial"], []).append(row["leaf"])
    leaves = int((tree.value.leaf >= 0).sum())
    places = []
    for i, u in enumerate(_unit(q)):
        at = {leaf: n for n, leaf in enumerate(tree.value.visit(u, leaves, held, 0))}
        places += [at[leaf] for leaf in true.get(i, [])]
    most = 1
    while most < leaves and places and np.mean(np.array(places) < most) < recall:
        most += 1
    return most
