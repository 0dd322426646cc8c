"""N-gram Jaccard join on an R-tree of count vectors.

Tokens are the word shingles of a text. They are hashed into groups, and a text is the point of its group counts. Two sets
have no more in common than the sum of the smaller of each two counts, and a box of points no more than the sum against its
upper corner, so an R-tree of points finds all pairs that may reach the similarity; what it lets through is verified.

In so many dimensions one tree over a corpus prunes nothing near its root, so the points are first routed to the cells of
a forest, exactly: two sets with similarity s share one of their first n - ceil(s n) + 1 tokens in any fixed order, here
the order of rarity (by a sketch of fixed size). A cell is the texts with such a token in common; each gets its own tree.

Neither a large cell nor a large group of texts that bounds join is gathered in a task: it is dealt into blocks, which are
joined in a ring first; texts that are then not in the largest component of their group meet all blocks, pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import returning
from ._store import discard, materialise
from ._words import NOT_SPACE, mix, shingles, slices, words

U = np.uint64
#: Counters of the rarity sketch, and groups (dimensions) of a point.
SKETCH = 1 << 16
CHUNK = 1 << 10
GROUPS, FINEST = 64, 8192
#: Points in a leaf and boxes in a node of an R-tree; texts that one tree takes.
LEAF, FANOUT, TREE = 8, 8, 2048
#: Entries that a routing bucket should have, and how many a task holds at once of one that has more.
BUCKET, HELD = 1 << 20, 1 << 22
#: Texts of a cell, and shingles of a group of joined texts, beyond which it is dealt into blocks of that size.
CELL, GROUP = 2048, 1 << 18


def fine_point(s: np.ndarray) -> np.ndarray:
    """Group counts of a hash set, with two to four tokens a group: the more tokens, the more groups, up to FINEST."""
    bits = max(GROUPS.bit_length() - 1, min(FINEST.bit_length() - 1, len(s).bit_length() - 2))
    counts = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8) if counts.max() < 256 else counts.astype(np.uint32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same point with fewer groups, each the sum of neighbouring ones."""
    return point.reshape(groups, -1).sum(axis=1, dtype=np.int64)


def packed(point: np.ndarray) -> bytes:
    return bytes([point.dtype.itemsize]) + point.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8 if data[0] == 1 else "<u4", offset=1)


def common_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """Bound of the common tokens of two points by the sum of coordinate minima."""
    if len(a) != len(b):
        a, b = (folded(x, min(len(a), len(b))) for x in (a, b))
    return int(np.minimum(a, b).sum(dtype=np.int64))


def needed(a, b, percent: int):
    """Least common tokens of sets of a and b tokens that have the similarity: 100 c >= percent (a + b - c)."""
    return -((-percent * (a + b)) // (100 + percent))


class RTree:
    """A packed R-tree: points sorted by total and coordinates are cut into leaves, boxes of boxes follow up to one root."""

    def __init__(self, at: np.ndarray, size: np.ndarray):
        heavy = np.argsort(-at.var(axis=0), kind="stable")[:4]
        tiers = (4 * np.log2(np.maximum(size, 1))).astype(np.int64)
        self.order = np.lexsort((*(at[:, h] // 4 for h in heavy[::-1]), tiers))
        self.at, self.size = at[self.order], size[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # upper corners, least and greatest totals
        high, least, most, step = self.at, self.size, self.size, LEAF
        while len(high) > 1:
            cut = np.arange(0, len(high), step)
            high, least, most, step = np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), FANOUT
            self.levels.append((high, least, most))

    def candidates(self, q: np.ndarray, n: int, percent: int, skip: Callable[[int, int], bool]) -> Iterator[int]:
        """Numbers of points that may be similar to q (with total n); skip(first, last + 1) passes over a subtree's run of points."""
        width = [LEAF * FANOUT**k for k in range(len(self.levels))]
        stack = [(len(self.levels) - 1, 0)] if self.levels else []
        count = len(self.order)
        if not self.levels and count:
            yield from self._leaf(0, count, q, n, percent)
        while stack:
            level, i = stack.pop()
            first, last = i * width[level], min((i + 1) * width[level], count)
            if skip(first, last):
                continue
            if not level:
                yield from self._leaf(first, last, q, n, percent)
                continue
            high, least, most = (x[i * FANOUT : (i + 1) * FANOUT] for x in self.levels[level - 1])
            common = np.minimum(np.minimum(high, q).sum(axis=1), np.minimum(most, n))
            good = (common >= needed(n, least, percent)) & (100 * most >= percent * n) & (percent * least <= 100 * n)
            stack += [(level - 1, i * FANOUT + j) for j in np.flatnonzero(good).tolist()]

    def _leaf(self, first: int, last: int, q: np.ndarray, n: int, percent: int) -> Iterator[int]:
        common = np.minimum(self.at[first:last], q).sum(axis=1)
        yield from (self.order[first:last][common >= needed(n, self.size[first:last], percent)]).tolist()


def linked(at: np.ndarray, size: np.ndarray, percent: int, similar: Callable[[int, int], bool], root: np.ndarray | None = None, asks: np.ndarray | None = None, answers: np.ndarray | None = None) -> np.ndarray:
    """Root (smallest number) of each point's component; the tree proposes pairs by the bound in GROUPS dimensions, `similar` judges them.

    A subtree whose points are all in the query's component is passed over, so a group of m copies takes about m checks. root:
    components known already. asks, answers: flags of the points that are compared with each other; all with all if None.
    """
    n = len(size)
    root = np.arange(n) if root is None else root.copy()
    if n == 2 and asks is None:
        if root[0] != root[1] and np.minimum(at[0], at[1]).sum() >= needed(size[0], size[1], percent) and similar(0, 1):
            root[1] = 0
        return root
    own = np.arange(n) if answers is None else np.flatnonzero(answers)
    blocks = [own[a : a + TREE] for a in range(0, len(own), TREE)]
    trees = [RTree(at[b], size[b]) for b in blocks]
    for q in np.arange(1, n) if asks is None else np.flatnonzero(asks):
        for block, tree in zip(blocks, trees, strict=True):
            if asks is None and block[0] >= q:  # every pair is met from its later point
                break
            own = block[tree.order]

            def skip(first: int, last: int, own: np.ndarray = own, q: int = q) -> bool:
                run = own[first:last]
                return bool(((root[run] == root[q]) | ((run >= q) & (asks is None))).all())

            for i in tree.candidates(at[q], int(size[q]), percent, skip):
                j = int(block[i])
                if (j < q or asks is not None) and root[j] != root[q] and similar(j, q):
                    low, high = sorted((int(root[j]), int(root[q])))
                    root[root == high] = low
    return root


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, data, offsets in slices(texts):
        hashes, at = words(data, offsets, NOT_SPACE)
        yield a, b, list(shingles(hashes, at))


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, by sums of two mixes of its hashes."""
    d = [(mix(s).sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) for s in sets]
    return np.array([x for x, _ in d], dtype=U).view(np.int64), np.array([x for _, x in d], dtype=U).view(np.int64)


SURVEY = "id long, h long, n int, d1 long, d2 long, point binary, chunk int, counts binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of size, digest and point for each text, and at the end the task's rarity counters in chunks."""
    names = [x.split()[0] for x in SURVEY.split(", ")]
    counts = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        for a, b, sets in _sets(batch.column(1)):
            d1, d2 = _digests(sets)
            for s in sets:
                counts += np.bincount((s & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) if len(s) > 4096 else 0
            short = [s for s in sets if len(s) <= 4096]
            if short:
                counts += np.bincount((np.concatenate(short) & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            m = b - a
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), batch.column(2).slice(a, m), pa.array([len(s) for s in sets], pa.int32()), pa.array(d1), pa.array(d2), pa.array([packed(fine_point(s)) for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    k = SKETCH // CHUNK
    empty = lambda t: pa.nulls(k, t)
    yield pa.RecordBatch.from_arrays([empty(pa.int64()), empty(pa.int64()), empty(pa.int32()), empty(pa.int64()), empty(pa.int64()), empty(pa.binary()), pa.array(range(k), pa.int32()), pa.array([c.astype("<u8").tobytes() for c in counts.reshape(k, CHUNK)], pa.binary())], names)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(b, dtype="<u8")
            total[c] = total[c] + own if c in total else own
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])


def _route(batches: Iterator[pa.RecordBatch], rarity: np.ndarray, buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Packed (token, digest) entries of the texts' routing tokens, by bucket; equal entries of a task are merged."""
    for batch in batches:
        for _, _, sets in _sets(batch.column(1)):
            d1, d2 = _digests(sets)
            tokens, owner = [], []
            for i, s in enumerate(sets):
                n = len(s)
                if n:
                    first = n + (-percent * n // 100) + 1  # n - ceil(percent n / 100) + 1
                    tokens.append(s[np.argsort(rarity[(s & U(SKETCH - 1)).astype(np.int64)], kind="stable")[:first]])
                    owner.append(np.full(first, i))
            if not tokens:
                continue
            token, own = np.concatenate(tokens), np.concatenate(owner)
            once = np.zeros(len(sets), dtype=bool)  # not the later copies in this slice
            once[np.unique(np.column_stack([d1, d2]), axis=0, return_index=True)[1]] = True
            token, own = token[once[own]], own[once[own]]
            spread = mix(token ^ U(0x2545F4914F6CDD1D))
            bucket = ((spread >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            entry = np.empty(len(token), dtype=[("t", "<u4"), ("a", "<i8"), ("b", "<u4")])
            entry["t"], entry["a"], entry["b"] = spread & U(0xFFFFFFFF), d1[own], (d2[own].view(U) >> U(32)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            entry, bucket = entry[order], bucket[order]
            used, begin = np.unique(bucket, return_index=True)
            parts = np.split(entry, begin[1:])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "entries"])


ENTRY = [("t", "<u4"), ("a", "<i8"), ("b", "<u4")]


def _merged(packs: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first of each run, lengths, entries) of the packs' distinct entries, sorted by token; runs of at least `least`."""
    entry = np.frombuffer(b"".join(packs), dtype=ENTRY)
    entry = entry[np.lexsort((entry["b"], entry["a"], entry["t"]))]
    fresh = np.ones(len(entry), dtype=bool)
    fresh[1:] = (entry["t"][1:] != entry["t"][:-1]) | (entry["a"][1:] != entry["a"][:-1]) | (entry["b"][1:] != entry["b"][:-1])
    entry = entry[fresh]
    begin = np.flatnonzero(np.concatenate([[True], entry["t"][1:] != entry["t"][:-1]]))
    length = np.diff(np.concatenate([begin, [len(entry)]]))
    good = length >= least
    return begin[good], length[good], entry


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of at least two texts as (cell digest, text); cells with the same texts become one where they meet.

    Buckets come one after the other. One with more than HELD entries goes out in parts, in which cells are named by their
    bucket and token, so that they meet again, also those of a single text.
    """

    def out(cell: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(entry), 50_000):
            part = entry[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 50_000]), pa.array(part["a"].copy()), pa.array(part["b"].astype(np.int64))], ["cell", "d1", "b"])

    def part(bucket: int, packs: list[bytes], whole: bool) -> Iterator[pa.RecordBatch]:
        begin, length, entry = _merged(packs, 2 if whole else 1)
        if not len(begin):
            return
        if whole:
            texts = mix(entry["a"].view(U) ^ (entry["b"].astype(U) << U(7)))
            total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(texts, dtype=U)])
            digest = mix(total[begin + length] - total[begin] + length.astype(U))
            _, one = np.unique(digest, return_index=True)
            begin, length, digest = begin[one], length[one], digest[one]
        else:
            digest = mix(entry["t"][begin].astype(U) | (U(bucket) << U(32)))
        member = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        yield from out(np.repeat(digest, length).view(np.int64), entry[member])

    now, packs, held, parted = -1, [], 0, False
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != now:
                if packs:
                    yield from part(now, packs, not parted)
                now, packs, held, parted = k, [], 0, False
            packs.append(b)
            held += len(b) // 16
            if held >= HELD:
                yield from part(now, packs, False)
                packs, held, parted = [], 0, True
    if packs:
        yield from part(now, packs, not parted)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with an equal first column, from sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cut, cut[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _whole(group: pa.Table) -> tuple[pa.Table, dict]:
    """A cell's rows, one for each node, and what linked() is told of them beforehand."""
    node, role = group.column("node").to_numpy(), group.column("role").to_numpy()
    known, first, place = np.unique(node, return_index=True, return_inverse=True)
    if role[0] < 0:
        return group if len(known) == len(node) else group.take(pa.array(first)), {}
    asks, answers = np.zeros(len(known), dtype=bool), np.zeros(len(known), dtype=bool)
    asks[place[role == 0]] = answers[place[role == 1]] = True
    group = group.take(pa.array(first))
    _, low, back = np.unique(group.column("label").to_numpy(), return_index=True, return_inverse=True)
    return group, {"root": low[back], "asks": asks, "answers": answers}


EDGES = "a long, rep_a long, b long, rep_b long"


def _joined(groups: Iterator[pa.Table], decide: Callable[[pa.Table, dict], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each cell edges (node and rep) from the first node of each component that `decide` finds to its others."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    told = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], [x.split()[0] for x in EDGES.split(", ")])
    for group in groups:
        group, known = _whole(group)
        if len(group) < 2:
            continue
        root = decide(group, known)
        more = np.flatnonzero(root != known.get("root", np.arange(len(root))))
        if len(more):
            node, rep = group.column("node").to_numpy(), group.column("rep").to_pylist()
            for i, j in zip(more.tolist(), root[more].tolist(), strict=True):
                for x, y in zip(out, (node[i], rep[i], node[j], rep[j]), strict=True):
                    x.append(y)
        if len(out[0]) > 50_000:
            yield told()
            out = ([], [], [], [])
    yield told()


def _edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each cell the texts joined by the tree's bound."""

    def decide(group: pa.Table, known: dict) -> np.ndarray:
        fine = [unpacked(p) for p in group.column("point").to_pylist()]
        size = group.column("n").to_numpy().astype(np.int64)
        near = lambda i, j: common_at_most(fine[i], fine[j]) >= needed(size[i], size[j], percent)
        return linked(np.stack([folded(f, GROUPS) for f in fine]), size, percent, near, **known)

    return _joined(_groups(batches), decide)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each group of texts that bounds join, or two blocks of it, the verified links, as far as they join components."""

    def decide(group: pa.Table, known: dict) -> np.ndarray:
        sets = [s for _, _, part in _sets(group.column("t")) for s in part]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        fine = [fine_point(s) for s in sets]

        def similar(i: int, j: int) -> bool:
            a, b = sets[i], sets[j]
            if common_at_most(fine[i], fine[j]) < needed(len(a), len(b), percent):
                return False
            place = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common = int((b[place] == a).sum())
            return 100 * common >= percent * (len(a) + len(b) - common)

        return linked(np.stack([folded(f, GROUPS) for f in fine]), size, percent, similar, **known)

    return _joined(_groups(batches), decide)


def connected(members: DataFrame, limit: int, fetch: Callable[[DataFrame], DataFrame], judge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """EDGES that connect what `judge` links in each group g of members (g, node, w, ...), in tasks of about 2 `limit` weight at most.

    fetch makes what judge needs, cell first, of rows (cell, node, role, label, ...); judge sees them sorted by cell. A group beyond the
    limit is dealt into blocks by node. Neighbouring blocks of the ring meet first, which joins a group of near copies whole;
    what is then outside its group's largest component meets every block, so no pair of two components goes unseen.
    """
    none = F.lit(None).cast("long")

    def edges(rows: DataFrame) -> DataFrame:
        cells = fetch(rows).repartition("cell").sortWithinPartitions("cell")
        return cells.mapInArrow(returning(judge), EDGES)

    weights = members.groupBy("g").agg(F.sum("w").alias("w"))
    big = materialise(weights.where(F.col("w") > limit).select("g", F.ceil(F.col("w") / limit).alias("blocks")), "big")
    more = [F.col(c) for c in members.columns if c not in ("g", "node", "w")]
    plain = lambda df: df.select(F.col("g").alias("cell"), "node", F.lit(-1).alias("role"), none.alias("label"), *more)
    if big.isEmpty():
        return edges(plain(members))
    small = edges(plain(members.join(big, "g", "left_anti")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    large = materialise(members.join(big, "g").select("g", "node", "w", *more, "blocks", block.alias("block")), "blocks")
    meets = F.when(F.col("blocks") == 2, F.array(F.lit(0).cast("long"))).otherwise(F.array("block", F.pmod(F.col("block") - 1, F.col("blocks"))))
    ring = large.select(F.col("g").alias("group"), F.explode(meets).alias("turn"), "node", *more)
    first = materialise(edges(ring.select(F.xxhash64("group", "turn").alias("cell"), "node", F.lit(-1).alias("role"), none.alias("label"), *more)), "ring")
    labels = smallest_label(first.select("a", "b"))
    large = large.where("blocks > 3").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = large.groupBy("g", "label").agg(F.count("*").alias("n"))
    giants = sizes.groupBy("g").agg(F.max(F.struct("n", "label"))["label"].alias("giant"))
    large = materialise(large.join(giants, "g"), "labelled")
    rest = large.where("label <> giant")
    if rest.isEmpty():
        return small.union(first)
    asked = rest.groupBy("g").agg(F.ceil(F.sum("w") / limit).alias("asks"))
    name = lambda i, j: F.xxhash64("g", F.lit(1), i, j).alias("cell")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rest.join(asked, "g").select("*", upto("blocks").alias("j")).select(name(F.pmod(F.xxhash64("node", F.lit(2)), F.col("asks")), F.col("j")), "node", F.lit(0).alias("role"), "label", *more)
    right = large.join(asked, "g").select("*", upto("asks").alias("i")).select(name(F.col("i"), F.col("block")), "node", F.lit(1).alias("role"), "label", *more)
    return small.union(first).union(edges(left.union(right)))


def smallest_label(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node of its component.

    Alternates between linking larger neighbours and all neighbours to the smallest one, each round a shuffle of the edges,
    written to shared storage; about log(size) rounds. No component is gathered in a task.
    """
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours and
        own = low.where("m < a").select("a", F.col("m").alias("b"))  # the node itself go to the smallest
        star = materialise(large.union(own).where("a <> b").distinct(), "star")
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        near = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(near.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        changed = mark(after) != mark(edges)
        discard(edges)
        discard(star)
        edges = after
        if not changed:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())


class Joined:
    """The similarity join of the rows of docs, as tables: `survey` (id, h, n, d1, d2 of each row), `classes` of equal sets
    (d1, d2, rep and h of the row that stands for it, n, node) and `labels` (node, and low, low_node: the first id and class of its component)."""

    def __init__(self, docs: DataFrame, percent: int, id_col: str, text_col: str):
        spark = docs.sparkSession
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
        both = materialise(source.mapInArrow(returning(_survey), SURVEY), "survey")
        sketch = both.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(returning(_add_counts), "chunk int, counts binary")
        rarity = np.zeros((SKETCH // CHUNK, CHUNK), dtype=np.int64)
        for row in sketch.toLocalIterator():  # SKETCH numbers, whatever the corpus
            rarity[row["chunk"]] = np.frombuffer(row["counts"], dtype="<u8")
        total = int(rarity.sum())
        shared = spark.sparkContext.broadcast(rarity.ravel())
        self.survey = both.where("chunk is null").drop("chunk", "counts")
        # The row of the smallest id stands for a class; by id and hash of the text it is found again.
        own = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("own")
        classes = self.survey.where("n > 0").groupBy("d1", "d2").agg(own, F.first("n").alias("n"), F.first("point").alias("point"))
        classes = classes.select("d1", "d2", F.col("own.id").alias("rep"), F.col("own.h").alias("h"), "n", "point")
        # A node number is needed that is as short as an id, and equal ids can have several texts.
        self.classes = classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        buckets = max(12, total * (100 - percent) // 100 // BUCKET)
        routed = source.select("id", "t").mapInArrow(returning(lambda b: _route(b, shared.value, buckets, percent)), "bucket int, entries binary")
        cells = routed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(returning(_cells), "cell long, d1 long, b long")
        known = classes.select("d1", F.shiftrightunsigned("d2", 32).alias("b"), "node")
        cells = materialise(cells.join(known, ["d1", "b"]).select(F.col("cell").alias("g"), "node", F.lit(1).alias("w")), "cells")
        points = classes.select("node", F.lit(None).cast("long").alias("rep"), "n", "point")
        near = connected(cells, CELL, lambda rows: rows.join(points, "node").select("cell", "node", "role", "label", "rep", "n", "point"), lambda b: _edges(b, percent))
        groups = smallest_label(near.select("a", "b")).withColumnRenamed("label", "g")
        groups = materialise(groups.join(classes.select("node", "rep", "h", F.col("n").alias("w")), "node"), "groups")
        texts = materialise(self._texts(source, groups), "texts")
        links = connected(texts, GROUP, lambda rows: rows.select("cell", "node", "role", "label", "rep", "t"), lambda b: _verify(b, percent))
        # Nodes in order of their ids, so that the first node of a component has its smallest id: nothing meets by component.
        ranked = lambda rep, node: F.struct(F.col(rep).isNull().alias("none"), F.col(rep).alias("rep"), F.col(node).alias("node"))
        labels = smallest_label(links.select(ranked("rep_a", "a").alias("a"), ranked("rep_b", "b").alias("b")))
        self.labels = labels.select("node.node", F.col("label.rep").alias("low"), F.col("label.node").alias("low_node"))
        for done in (cells, groups, texts):
            discard(done)

    @staticmethod
    def _texts(source: DataFrame, groups: DataFrame) -> DataFrame:
        """g, node, w, rep and the text of each node: one row with its id and text hash, taken before anything is joined to it.

        All by one key, so that texts travel once; the sides are never broadcast, whatever the size, as they grow alike.
        """
        key = lambda row: F.xxhash64(row, "h").alias("k")
        asked = groups.select(key("rep")).distinct().hint("merge")
        found = source.select(key("id"), "h", "t").join(asked, "k", "left_semi").groupBy("k", "h").agg(F.min("t").alias("t"))
        same = F.col("g.h").bitwiseXOR(F.col("f.h")) == 0  # no join key of its own: the rows are dealt by k already
        both = groups.select(key("rep"), "*").alias("g").join(found.alias("f").hint("merge"), (F.col("g.k") == F.col("f.k")) & same)
        return both.select("g.g", "g.node", "g.w", "g.rep", "f.t")


def jaccard_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row: 5-word shingle sets that share `percent` % of their union are linked.

    Words are lower-cased (A-Z) runs without white space. A text of fewer than five words is one shingle; null, empty and
    blank texts have none and stand alone. Equal sets are one text in the join, so copies cost a digest each. Rows with equal
    ids and different texts are texts of their own; component_id is the smallest id that links reach. Long ids only. A null id
    is in no minimum, but its text links as any other: its component_id is the smallest id reached, null if there is none. An
    empty table gives no rows; other columns are not read, whatever their names.
    """
    done = Joined(docs, percent, id_col, text_col)
    ids = done.classes.join(done.labels, "node", "left").select("d1", "d2", F.when(F.col("low_node").isNull(), F.col("rep")).otherwise(F.col("low")).alias("component_id"))
    out = done.survey.join(ids, ["d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, in all their columns, of which one stays for each component of jaccard_components().

    That of the smallest id stays (a null id is larger than any), of equal ids that of the least text hash, and of rows equal
    in id and text any one. Rows without words are linked with nothing and all stay. Columns keep names, types and order.
    """
    done = Joined(docs, percent, id_col, text_col)
    firsts = done.classes.join(done.labels, "node", "left").where("low_node is null or low_node = node").select(F.col("rep").alias("id"), "h").alias("a")
    rows = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    kept = rows.where("worded").alias("s").join(firsts, (F.col("s.h") == F.col("a.h")) & F.col("s.id").eqNullSafe(F.col("a.id")), "left_semi").groupBy("id", "h").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(rows.where("not worded").select("row.*"))
