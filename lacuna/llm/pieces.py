"""N-best segmentation over the lattice of a sentencepiece vocabulary, and its exact decoding.

A forward Viterbi pass gives the best score of every prefix; they are exact heuristics of an A-star search that runs
backward from the end of the text, so complete segmentations leave its queue in order of their scores. No piece spans the
start of a word (a space mark after another character), so the lattice of a text is a chain of word lattices: each distinct
word is searched once (many words at a time, as arrays), and the same A-star order over the chain gives the n best of the whole text.
"""

from __future__ import annotations

import array
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import returning, uncollected

SPACE = "▁"
#: Stands for a space mark in the text itself, which only bytes can spell; no word is empty.
LITERAL = ""
#: Score of a character that only its bytes can spell, below the lowest piece.
UNKNOWN_STEP = 10.0
#: Words whose results a worker remembers beside those of the batch at hand, none longer than LONG after it.
REMEMBERED, LONG = 100_000, 48
#: Characters with a column in the table of piece beginnings, and words taken together through it.
CHARACTERS, TOGETHER = 256, 8192
#: Text bytes and rows of a batch; a longer text is a batch by itself.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 2048
SCORE, STEP, IDS = itemgetter(0), itemgetter(1), itemgetter(2)


class PieceLattice:
    def __init__(self, path: str, n: int):
        import sentencepiece

        self.n = n
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.scores.append(model.get_score(i))
            if model.is_byte(i):
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece] = i
                self.text.append(piece.replace(SPACE, " ").encode())
        #: Every beginning of a piece, with the piece it is (-1: none yet) and its score.
        self.starts = {p[:k]: (-1, 0.0) for p in self.ids for k in range(1, len(p))}
        self.starts |= {p: (i, self.scores[i]) for p, i in self.ids.items()}
        self.unknown = min(self.scores[i] for p, i in self.ids.items() if p.strip(SPACE)) - UNKNOWN_STEP
        self.known: dict[str, tuple[float, float, bytes]] = {}
        self.ranked: dict[str, tuple[list[float], list[bytes]]] = {}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # Cuts that no piece spans: before a space mark, around a line end that is in no piece, between a Latin letter and a stop.
        latin = "A-Za-zÀ-ÖØ-öø-ɏ"
        ends = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        stops = re.escape("".join(c for c in ".,;:!?" if not any(x[1] == c and re.match(f"[{latin}]", x[0]) for x in self.pairs))) or SPACE
        self.split = re.compile(rf"{SPACE}+(?:[{latin}]++(?=[{stops}])|[^{SPACE}{ends}]*+)|[{stops}][^{SPACE}{ends}]*+|[{latin}]++(?=[{stops}])|[^{SPACE}{ends}]++" + (f"|[{ends}]" if ends else ""))
        self.trie()

    def trie(self) -> None:
        """The beginnings of pieces made of the most frequent characters, as a table from (node, character) to node."""
        often = Counter(chain.from_iterable(self.ids)).most_common(CHARACTERS - 1)
        self.classes = np.zeros(0x110000, dtype=np.uint8)
        self.classes[[ord(c) for c, _ in often]] = range(1, len(often) + 1)
        plain = re.compile("[" + "".join(re.escape(c) for c, _ in often) + "]+")
        self.simple = plain.fullmatch
        nodes = sorted((p for p in self.starts if plain.fullmatch(p)), key=len)
        place = {"": 1} | {p: i for i, p in enumerate(nodes, 2)}
        self.next = np.zeros((len(nodes) + 2) * CHARACTERS, dtype=np.min_scalar_type(len(nodes) + 2))  # node 0: no piece begins so; node 1: nothing read
        self.piece_at = np.full(len(nodes) + 2, -1, dtype=np.int32)
        for p in nodes:
            self.next[place[p[:-1]] * CHARACTERS + int(self.classes[ord(p[-1])])] = place[p]
            self.piece_at[place[p]] = self.starts[p][0]
        self.score_of = np.array(self.scores)

    def forward(self, word: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """For every end the arcs (start, score, piece or -1) of the lattice, and the best score of every prefix."""
        size = len(word)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [float("-inf")] * size
        starts = self.starts.get
        for a in range(size):
            base, single = best[a], False
            for b in range(a + 1, size + 1):
                found = starts(word[a:b])
                if found is None:
                    break
                piece, score = found
                if piece >= 0:
                    ends[b].append((a, score, piece))
                    single |= b == a + 1
                    if base + score > best[b]:
                        best[b] = base + score
            if not single:
                ends[a + 1].append((a, self.unknown, -1))
                best[a + 1] = max(best[a + 1], base + self.unknown)
        return ends, best

    def word(self, word: str) -> tuple[float, float, bytes]:
        """The best score of a word, the step down to its second (infinite if there is none), and the best ids as int32 bytes.

        The second best shares an end with the best and leaves it by the next-best arc into some place on its way, so the step
        is the least difference between the two best ways into a place. Equal scores take the arc that starts first.
        """
        if word == LITERAL:
            return self.unknown, float("inf"), np.array([self.bytes[b] for b in SPACE.encode()], dtype=np.int32).tobytes()
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs), len(word)]  # no piece spans these
        parts = [self.one_best(word[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return sum(map(SCORE, parts)), min(map(STEP, parts)), b"".join(map(IDS, parts))

    def many(self, words: list[str]) -> dict[str, tuple[float, float, bytes]]:
        """word() of each word: those of frequent characters together, by the same steps in the same order, the others singly."""
        simple = sorted((w for w in words if len(w) <= LONG and self.simple(w)), key=len, reverse=True)
        found: dict[str, tuple[float, float, bytes]] = {}
        for at in range(0, len(simple), TOGETHER):
            found |= self.together(simple[at : at + TOGETHER])
        for w in words:
            if w not in found:
                found[w] = self.word(w)
        return found

    def together(self, words: list[str]) -> dict[str, tuple[float, float, bytes]]:
        """one_best() of words of frequent characters, longest first, all words at once at every pair of places."""
        size = np.array([len(w) for w in words])
        most, n = int(size[0]), len(words)
        text = self.classes[np.frombuffer("".join(w.ljust(most, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32)]
        text = np.ascontiguousarray(text.reshape(n, most).T)
        best, second = np.full((most + 1, n), -np.inf), np.full((most + 1, n), -np.inf)
        source, piece = np.zeros((most + 1, n), dtype=np.int32), np.full((most + 1, n), -1, dtype=np.int32)
        best[0] = 0

        def arc(a: int, b: int, i: np.ndarray, own: np.ndarray, score: np.ndarray) -> None:
            old = best[b, i]
            better = score > old
            second[b, i] = np.where(better, old, np.maximum(second[b, i], score))
            best[b, i] = np.maximum(old, score)
            up = i[better]
            source[b, up], piece[b, up] = a, own[better]

        for a in range(most):
            i = np.arange(np.searchsorted(-size, -a))  # the words with a place after a
            node, base, single = np.ones(len(i), dtype=np.int64), best[a], np.zeros(len(i), dtype=bool)
            for b in range(a + 1, most + 1):
                node = self.next[node * CHARACTERS + text[b - 1, i]].astype(np.int64)
                on = node > 0
                node, i = node[on], i[on]
                if not len(i):
                    break
                own = self.piece_at[node]
                whole = own >= 0
                j, own = i[whole], own[whole]
                if b == a + 1:
                    single[j] = True
                arc(a, b, j, own, base[j] + self.score_of[own])
            j = np.flatnonzero(~single)
            arc(a, a + 1, j, np.full(len(j), -1, dtype=np.int32), base[j] + self.unknown)
        at, row = size.copy(), np.arange(n)
        step, ids, count, spelt = np.full(n, np.inf), np.zeros((n, most), dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        while len(row):
            here = at[row]
            step[row] = np.minimum(step[row], best[here, row] - second[here, row])
            own = piece[here, row]
            spelt[row] |= own < 0
            count[row] += 1
            ids[row, most - count[row]] = own
            at[row] = source[here, row]
            row = row[at[row] > 0]
        raw, width = ids.tobytes(), 4 * most
        told = zip(words, best[size, np.arange(n)].tolist(), step.tolist(), count.tolist(), spelt.tolist(), strict=True)
        return {w: self.word(w) if by_bytes else (s, d, raw[(k + 1) * width - 4 * c : (k + 1) * width]) for k, (w, s, d, c, by_bytes) in enumerate(told)}

    def one_best(self, word: str) -> tuple[float, float, bytes]:
        size, low, starts = len(word), float("-inf"), self.starts.get
        best, second, back = [low] * (size + 1), [low] * (size + 1), [(0, -1)] * (size + 1)
        best[0] = 0.0
        for a in range(size):
            base, single = best[a], False
            for b in range(a + 1, size + 1):
                found = starts(word[a:b])
                if found is None:
                    break
                piece, score = found
                if piece >= 0:
                    score += base
                    if b == a + 1:
                        single = True
                    if score > best[b]:
                        best[b], second[b], back[b] = score, best[b], (a, piece)
                    elif score > second[b]:
                        second[b] = score
            if not single:
                score, b = base + self.unknown, a + 1
                if score > best[b]:
                    best[b], second[b], back[b] = score, best[b], (a, -1)
                elif score > second[b]:
                    second[b] = score
        ids, step, at = [], float("inf"), size
        while at:
            a, piece = back[at]
            if best[at] - second[at] < step:
                step = best[at] - second[at]
            ids.append(piece) if piece >= 0 else ids.extend([self.bytes[x] for x in reversed(word[a:at].encode())])
            at = a
        return best[size], step, np.array(ids[::-1], dtype=np.int32).tobytes()

    def best_of(self, word: str) -> tuple[list[float], list[bytes]]:
        """Scores and ids (as int32 bytes) of the word's up to n best segmentations, by A-star search; of equals known's comes first."""
        found = self.ranked.get(word)
        if found is None:
            first = self.known[word][2]
            ranked = [(self.unknown, first)] if word == LITERAL else [(s, np.array(ids, dtype=np.int32).tobytes()) for s, ids in self.search(word, self.n)]
            found = list(map(SCORE, ranked)), [first, *(ids for _, ids in ranked if ids != first)][: len(ranked)]
            if len(word) > LONG:
                return found
            if len(self.ranked) >= REMEMBERED // 10:
                self.ranked.clear()
            self.ranked[word] = found
        return found

    def search(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        size = len(word)
        ends, best = self.forward(word)
        push, pop, made, found = heapq.heappush, heapq.heappop, 0, []
        bound = float("-inf")  # of the n best whole segmentations that the queue holds; nothing below it can be among the n best
        whole: list[float] = []
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-best[size], 0, size, 0.0, None)]
        while queue and len(found) < n:
            _, _, at, done, tail = pop(queue)
            if not at:
                ids: list[int] = []
                while tail is not None:
                    a, b, piece, tail = tail
                    ids.extend([piece] if piece >= 0 else [self.bytes[x] for x in word[a:b].encode()])
                found.append((done, ids))
                continue
            for a, s, piece in ends[at]:
                if (score := done + s + best[a]) >= bound:
                    made += 1
                    push(queue, (-score, -made, a, done + s, (a, at, piece, tail)))  # the latest of equals first: no breadth over ties
                    if not a:
                        push(whole, score)
                        if len(whole) > n:
                            pop(whole)
                        if len(whole) == n:
                            bound = whole[0]
        return found

    def words(self, text: str) -> list[str]:
        """Words of the text, with the space mark that encoding puts first; a literal mark is a word of its own, LITERAL."""
        if not text:
            return []
        first, *rest = text.split(SPACE)
        out = self.split.findall(SPACE + first.replace(" ", SPACE))
        for part in rest:
            out.append(LITERAL)
            out += self.split.findall(part.replace(" ", SPACE))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, list[float]]]:
        """Of each text the ids of the best segmentation, as int32 bytes, and the scores of up to n best ones."""
        return [(lists[0], scores) for lists, scores in self.encode_best(texts)]

    def encode_best(self, texts: list[str]) -> list[tuple[list[bytes], list[float]]]:
        """Of each text the ids of its up to n best segmentations, best first, as int32 bytes, and their scores."""
        same: dict[str, str] = {}  # equal words are one string, so that the others' memory serves the next text
        lists = [list(map(same.setdefault, words, words)) for words in map(self.words, texts)]
        fresh = same.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        fresh -= self.known.keys()
        self.known |= self.many(list(fresh))
        out = [self.rank(words) for words in lists]
        for w in fresh:
            if len(w) > LONG:
                del self.known[w]
        return out

    def rank(self, words: list[str]) -> tuple[list[bytes], list[float]]:
        if not words:
            return [b""], [0.0]
        n, own = self.n, list(map(self.known.__getitem__, words))
        values, steps, parts = zip(*own, strict=True)
        total, steps = sum(values), list(steps)
        # A text's n best take a rank from each word's list; only the words with the n - 1 smallest first steps can leave rank 1.
        found: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]  # loss, and the words that leave rank 1 with their ids
        for _ in range(min(n - 1, len(steps))):
            least = min(steps)
            if least == float("inf"):
                break
            i = steps.index(least)
            steps[i] = float("inf")
            scores, ids = self.best_of(words[i])
            found = heapq.nsmallest(n, [(x + scores[0] - y, left + ((i, k),) if r else left) for x, left in found for r, (y, k) in enumerate(zip(scores, ids, strict=True))], key=SCORE)
        best = b"".join(parts)
        if len(found) == 1:
            return [best], [total]
        begin = list(accumulate(map(len, parts), initial=0))
        lists = []
        for _, left in found:
            made, at = [], 0
            for i, k in sorted(left):
                made += best[at : begin[i]], k
                at = begin[i + 1]
            lists.append(b"".join([*made, best[at:]]))
        return lists, [total - x for x, _ in found]

    def decode(self, ids: bytes) -> str:
        """The text of the pieces, without the space mark that encoding puts first."""
        text = b"".join(map(self.text.__getitem__, array.array("i", ids))).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of at most BATCH_ROWS rows and, but for single rows, BATCH_BYTES bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, own in enumerate(size):
        if i > begin and (held + own > BATCH_BYTES or i - begin == BATCH_ROWS):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += own
    if begin < len(size):
        yield batch.slice(begin)


def encode_pieces(docs: DataFrame, path: str, n_best: int = 4, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and piece_ids (best segmentation), n_pieces, nbest_ids and nbest_scores (best first) and decoded of whole texts.

    A null text gives null ids and scores, 0 pieces and a null decoding; an empty one empty lists. Input columns named like
    an output and not in `keep` are not read. One narrow pass without shuffle; every row is taken by itself.
    """
    kinds = [(f"k{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]
    at = keep.index(text_col) if text_col in keep else len(keep)  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = PieceLattice(path, n_best)  # given up with the task: nothing stays in a worker that is used again
        for big in batches:
            for batch in portions(big, at):
                every, ranks, ends, scores, decoded = [], [0], [0], [], []
                texts = batch.column(at).to_pylist()
                done = iter(tool.encode_best([t for t in texts if t is not None]))
                for text in texts:
                    lists, found = next(done) if text is not None else ([b""], None)
                    if text:
                        every += lists
                        for one in lists:
                            ends.append(ends[-1] + len(one) // 4)
                    ranks.append(len(every))
                    scores.append(found if text else found and [])
                    decoded.append(None if text is None else tool.decode(lists[0]))
                nbest = pa.ListArray.from_arrays(pa.array([None if t is None else r for t, r in zip(texts, ranks, strict=False)] + ranks[-1:], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(every), dtype=np.int32))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], nbest, pa.array(scores, pa.list_(pa.float64())), pa.array(decoded, pa.string())], [*(k for k, _ in kinds), "nbest_ids", "nbest_scores", "decoded"])

    source = docs.select(*(F.col(c).alias(k) for c, (k, _) in zip(keep, kinds, strict=True)), *([F.col(text_col).alias("t")] if at == len(keep) else []))
    out = source.mapInArrow(returning(uncollected(run)), ", ".join(f"{k} {t}" for k, t in kinds) + ", nbest_ids array<array<int>>, nbest_scores array<double>, decoded string")
    first = F.when(F.col("nbest_ids").isNotNull(), F.coalesce(F.get("nbest_ids", F.lit(0)), F.array().cast("array<int>")))  # the best list travels once
    out = out.withColumn("piece_ids", first)
    return out.select(*(F.col(k).alias(c) for c, (k, _) in zip(keep, kinds, strict=True)), "piece_ids", F.when(F.col("piece_ids").isNull(), 0).otherwise(F.size("piece_ids")).alias("n_pieces"), "nbest_ids", "nbest_scores", "decoded")
