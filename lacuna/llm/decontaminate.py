"""Benchmark decontamination on a distributed positional inverted index.

The index is a stored table: each segment holds the postings (token -> ascending positions) of a run of whole documents, for
every token in them, so no list outgrows a segment however common its token is, and one index serves any number of test sets.
A query is a window of item words. Its terms are taken from the rarest in the whole corpus on, by counts from the index: the
rarest term's postings, less the term's offset, are candidate starts, and the offset-adjusted postings of each further term
are intersected with what is left. Only the test windows travel to the segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import returning
from ._store import discard, materialise
from ._words import ALNUM, slices, words

U = np.uint64
#: Bytes of item text that travel to the tasks at once; more items are searched in further passes over the documents.
BLOCK_BYTES = 8 << 20


@dataclass
class Windows:
    """Test windows as rows of term numbers (-1 beyond the end of a short item), the item of each, and the terms' hashes, sorted.

    item_ids are distinct. order: the places of each window's terms, from the rarest of the corpus on (set by ranked())."""

    terms: np.ndarray
    rows: np.ndarray
    item: np.ndarray
    item_ids: list
    order: np.ndarray | None = None

    def ranked(self, count: np.ndarray) -> Windows:
        often = np.where(self.rows >= 0, count[self.rows] if len(count) else 0, np.iinfo(np.int64).max)
        return Windows(self.terms, self.rows, self.item, self.item_ids, np.argsort(often, axis=1, kind="stable"))


def windows_of(items: list[tuple[object, str | None]], size: int) -> Windows:
    rows, owner, ids = [], [], {}
    for item_id, text in items:
        hashes, _ = words(np.frombuffer((text or "").encode(), dtype=np.uint8), np.array([0, len((text or "").encode())]), ALNUM)
        if not len(hashes):
            continue
        n = max(len(hashes) - size + 1, 1)
        own = np.zeros((n, size + 1), dtype=U)
        for j in range(min(size, len(hashes))):
            own[:, j] = hashes[j : j + n]
        own[:, size] = min(size, len(hashes))
        rows.append(own)
        owner += [ids.setdefault(item_id, len(ids))] * n
    if not rows:
        return Windows(np.zeros(0, U), np.zeros((0, size), np.int64), np.zeros(0, np.int64), [])
    table = np.concatenate(rows)
    used = np.arange(size)[None, :] < table[:, size:].astype(np.int64)
    terms = np.unique(table[:, :size][used])
    numbers = np.where(used, np.searchsorted(terms, table[:, :size]), -1)
    both, first = np.unique(np.column_stack([np.array(owner)[:, None], numbers]), axis=0, return_index=True)
    del both
    return Windows(terms, numbers[first], np.array(owner)[first], list(ids))


class PositionalIndex:
    """A segment's postings of the windows' terms; words are numbered through its documents, which start at `at`."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, positions: np.ndarray, at: np.ndarray, terms: np.ndarray):
        self.at = at
        begin = np.concatenate([[0], np.cumsum(counts)])
        place = np.minimum(np.searchsorted(tokens, terms), max(len(tokens) - 1, 0))
        known = tokens[place] == terms if len(tokens) else np.zeros(len(terms), dtype=bool)
        self.count = np.where(known, counts[place] if len(tokens) else 0, 0)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        first = begin[place[known]]
        own = self.count[known]
        self.positions = positions[np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())].astype(np.int64)
        #: term * span + position, ascending: one sorted array in which any posting is found by bisection.
        self.span = int(at[-1]) + 1
        self.key = np.repeat(np.flatnonzero(known), own) * self.span + self.positions

    def between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term's postings hold a position from low to high."""
        if not len(self.key):
            return np.zeros(len(term), dtype=bool)
        i = np.searchsorted(self.key, term * self.span + low)
        return (i < len(self.key)) & (self.key[np.minimum(i, len(self.key) - 1)] <= term * self.span + high)

    def _rarest(self, tests: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose terms occur, their terms by rarity, and for each posting of the rarest: window's number there and position."""
        alive = np.flatnonzero((np.where(tests.rows >= 0, self.count[tests.rows], 1) > 0).all(axis=1)) if len(self.positions) and len(tests.rows) else np.zeros(0, dtype=np.int64)
        terms = np.take_along_axis(tests.rows[alive], tests.order[alive], axis=1) if len(alive) else np.zeros((0, 1), dtype=np.int64)
        n = self.count[terms[:, 0]] if len(alive) else np.zeros(0, dtype=np.int64)
        window = np.repeat(np.arange(len(alive)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (np.repeat(self.start[terms[:, 0]], n) if len(alive) else 0)
        return alive, terms, window, self.positions[place.astype(np.int64)]

    def phrases(self, tests: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all occurrences of windows inside one document."""
        alive, terms, window, here = self._rarest(tests)
        if not len(here):
            return window, here
        order, length = tests.order[alive], (tests.rows[alive] >= 0).sum(axis=1)
        start, doc = here - order[window, 0], np.searchsorted(self.at, here, side="right")
        inside = (start >= self.at[doc - 1]) & (start + length[window] <= self.at[doc])
        window, start = window[inside], start[inside]
        for j in range(1, terms.shape[1]):
            more = terms[window, j] >= 0
            keep = ~more
            place = start[more] + order[window[more], j]
            keep[more] = self.between(terms[window[more], j], place, place)
            window, start = window[keep], start[keep]
        return alive[window], start

    def near(self, tests: Windows, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where every other term stands at most `within` words away in the same document."""
        alive, terms, window, here = self._rarest(tests)
        for j in range(1, terms.shape[1]):
            more = terms[window, j] >= 0
            keep = ~more
            doc = np.searchsorted(self.at, here[more], side="right")
            low, high = np.maximum(here[more] - within, self.at[doc - 1]), np.minimum(here[more] + within, self.at[doc] - 1)
            keep[more] = self.between(terms[window[more], j], low, high)
            window, here = window[keep], here[keep]
        return alive[window], here


POSTINGS = "at binary, tokens binary, counts binary, positions binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of documents a row of each (i from 0) and one of their postings (i: -1)."""
    segment = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(0)):
            hashes, at = words(data, offsets, ALNUM)
            order = np.argsort(hashes, kind="stable")
            tokens, counts = np.unique(hashes, return_counts=True)
            post = [at.astype("<i8"), tokens.astype("<u8"), counts.astype("<u4"), order.astype("<u4" if len(order) < 1 << 32 else "<u8")]
            m = b - a
            kept = [pa.concat_arrays([c.slice(a, m), pa.nulls(1, c.type)]) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m + 1, segment)), pa.array([*range(m), -1], pa.int32()), pa.array([*np.diff(at).tolist(), None], pa.int64()), *kept, *(pa.array([*[None] * m, x.tobytes()], pa.binary()) for x in post)],
                ["seg", "i", "n_words", *batch.schema.names[1:], *(x.split()[0] for x in POSTINGS.split(", "))],
            )
            segment += 1


def positional_index(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The stored index of docs: rows (seg, i, n_words, k0, k1, ... as in `keep`) of documents, and of segments with POSTINGS (i: -1)."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    source = docs.select(quoted(text_col).alias("t"), *(quoted(c).alias(f"k{j}") for j, c in enumerate(keep)))
    kinds = "".join(f"k{j} {docs.schema[c].dataType.simpleString()}, " for j, c in enumerate(keep))
    return materialise(source.mapInArrow(returning(_index), f"seg long, i int, n_words long, {kinds}{POSTINGS}"), "postings")


def _segments(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[tuple[int, PositionalIndex]]:
    for batch in batches:
        for seg, at, tokens, counts, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, tokens = np.frombuffer(counts, dtype="<u4").astype(np.int64), np.frombuffer(tokens, dtype="<u8")
            wide = len(positions) == 8 * int(counts.sum()) and len(positions) > 0
            yield seg, PositionalIndex(tokens, counts, np.frombuffer(positions, dtype="<u8" if wide else "<u4"), np.frombuffer(at, dtype="<i8"), terms)


def _count(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(terms), dtype=np.int64)
    for _, index in _segments(batches, terms):
        total += index.count
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])


MATCHES = "seg long, i int, items array<string>, spans array<struct<start:long,end:long>>, near array<string>"


def _search(batches: Iterator[pa.RecordBatch], tests: Windows, within: int | None) -> Iterator[pa.RecordBatch]:
    """A row for each document with a match."""
    for seg, index in _segments(batches, tests.terms):
        at = index.at
        window, start = index.phrases(tests)
        length = (tests.rows[window] >= 0).sum(axis=1)
        doc = np.searchsorted(at, start, side="right") - 1
        items: dict[int, list] = {}
        for d, i in np.unique(np.column_stack([doc, tests.item[window]]), axis=0).tolist():
            items.setdefault(d, []).append(str(tests.item_ids[i]))
        order = np.lexsort((start, doc))
        spans: dict[int, list] = {}
        for d, s, e in zip(doc[order].tolist(), (start - at[doc])[order].tolist(), (start - at[doc] + length)[order].tolist(), strict=True):
            own = spans.setdefault(d, [])
            if own and s <= own[-1]["end"]:
                own[-1]["end"] = max(own[-1]["end"], e)
            else:
                own.append({"start": s, "end": e})
        near: dict[int, list] = {}
        if within is not None:
            window, here = index.near(tests, within)
            for d, i in np.unique(np.column_stack([np.searchsorted(at, here, side="right") - 1, tests.item[window]]), axis=0).tolist():
                near.setdefault(d, []).append(str(tests.item_ids[i]))
        found = sorted({*items, *near})
        told = lambda by, found=found: [by.get(d, []) for d in found]
        for own in (*items.values(), *near.values()):
            own.sort()
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([seg] * len(found), found, told(items), told(spans), told(near)), kinds, strict=True)], ["seg", "i", "items", "spans", "near"])


def _blocks(items: DataFrame, item_id: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for row in items.select(item_id, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len((row[1] or "").encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(index: DataFrame, items: DataFrame, size: int, within: int | None = None, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The stored MATCHES of all blocks of items; spans of a document overlap nowhere and are ascending."""
    session = index.sparkSession.sparkContext
    postings = index.where("i < 0").select("seg", *(x.split()[0] for x in POSTINGS.split(", ")))
    found, parts = None, []
    for block in _blocks(items, item_id, text_col):
        tests = windows_of(block, size)
        if not len(tests.rows):
            continue
        terms = session.broadcast(tests.terms)
        counts = postings.mapInArrow(returning(lambda b, t=terms: _count(b, t.value)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        count = np.zeros(len(tests.terms), dtype=np.int64)
        for row in counts.toLocalIterator():  # at most the terms of a block
            count[row["term"]] = row["n"]
        shared = session.broadcast(tests.ranked(count))
        part = materialise(postings.mapInArrow(returning(lambda b, t=shared: _search(b, t.value, within)), MATCHES), "matches")
        parts.append(part)
        found = part if found is None else found.unionByName(part)
        terms.unpersist()
        shared.unpersist()
    if found is None:
        return index.sparkSession.createDataFrame([], MATCHES)
    if len(parts) == 1:
        return found
    both = found.groupBy("seg", "i").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "spans", "near")))
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda done: F.element_at(done, -1)
    meet = lambda done, s: F.size(done).cast("boolean") & (s["start"] <= F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1).cast("long")))
    longer = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    merged = F.aggregate("spans", start, lambda done, s: F.when(meet(done, s), longer(done, s)).otherwise(F.concat(done, F.array(s))))
    both = materialise(both.select("seg", "i", "items", merged.alias("spans"), "near"), "matches")
    for part in parts:
        discard(part)
    return both


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_id: str = "item_id", within: int | None = None) -> DataFrame:
    """The columns in `keep`, n_words, n_hit, items (distinct ids of items with occurring windows, sorted as strings), spans (of hit
    words), and near (ids of items with a window whose terms all stand within `within` words of its rarest; empty if None).

    A document row is one output row, also if it is repeated; null and empty texts have no words. An item without words has no
    window; one of fewer than `size` words is one window; equal windows of several items hit for each of them, and rows of one
    item id are one item. With no items nothing is hit, an empty table gives no rows. Columns beside `keep` and the text are not read.
    """
    index = positional_index(docs, keep, text_col)
    found = matches(index, items, size, within, item_id, text_col)  # few: its files' size tells the planner whether to broadcast it
    own = index.where("i >= 0").drop(*(x.split()[0] for x in POSTINGS.split(", ")))
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    hit = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit")
    return own.join(found, ["seg", "i"], "left").select(*(F.col(f"k{j}").alias(c) for j, c in enumerate(keep)), "n_words", hit, some("items", "array<string>"), some("spans", "array<struct<start:bigint,end:bigint>>"), some("near", "array<string>"))


def uncontaminated(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs without any window of an item, in all their columns, whatever these are named."""
    index = positional_index(docs, tuple(docs.columns), text_col)
    found = matches(index, items, size, None, item_id, text_col)
    return index.where("i >= 0").join(found, ["seg", "i"], "left_anti").select(*(F.col(f"k{j}").alias(c) for j, c in enumerate(docs.columns)))
