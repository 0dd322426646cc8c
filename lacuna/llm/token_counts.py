"""Token counts by byte-pair merging on a heap and a linked list.

The symbols of one pre-token stand in a doubly linked list; a heap holds the adjacent pairs that have a merge rank. The
lowest rank (leftmost first) is popped again and again; stale entries are skipped. The count is the number of initial
symbols less the number of merges: no identifier is ever built.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import returning

#: The pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a worker remembers; the memory is emptied when full, so it is bounded and changes no result.
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec.get("added_tokens", ()) if t.get("special")]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretoken = regex.compile(PATTERN)
        self.mixed_space = regex.compile(r"\s | \s")
        self.symbols = byte_symbols()
        self.pieces: dict[str, int] = {}

    def merged(self, pretoken: str) -> int:
        """Tokens of one pre-token."""
        symbols = [self.symbols[b] for b in pretoken.encode("utf-8")]
        n = len(symbols)
        if n < 2:
            return n
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.ranks.get
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            merges += 1
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return n - merges

    def piece(self, text: str) -> int:
        """Tokens of a text of whole pre-tokens, remembered if short."""
        known = self.pieces.get(text)
        if known is None:
            known = sum(map(self.merged, self.pretoken.findall(text)))
            if len(text) <= 64:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[text] = known
        return known

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A pre-token starts at every single space between two characters that are no white space, so such texts are cut there
        and equal pieces counted once; a text with other white space beside a space is split by the pattern alone.
        """
        if not text:
            return 0
        if text[0] == " " or text[-1] == " " or self.mixed_space.search(text):
            return sum(self.piece(p) * n for p, n in Counter(self.pretoken.findall(text)).items())
        first, *rest = text.split(" ")
        return self.piece(first) + sum(self.piece(" " + p) * n for p, n in Counter(rest).items())

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@functools.cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit of every text; one narrow pass without shuffle.

    Null and empty texts have no bytes and no tokens; repeated rows are counted each; other columns are not read. The
    vocabulary file is opened on the executors, once a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(returning(run), f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
