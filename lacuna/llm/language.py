"""Language identification with a bidirectional gated recurrent network over the bytes of a text.

Texts are cut into spans of SPAN bytes, which the network reads from both sides. It gives every byte position a distribution
over the languages; a document's probabilities are the mean over its letter positions. Training is backpropagation through
time in numpy, on a bounded sample of labelled rows; predictions read whole texts and nothing but the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._memory import returning
from ._store import materialise
from ._words import slices

SPAN = 64
HIDDEN = 8
#: Training sample: rows of each language, with their whole texts.
ROWS = 400
#: Spans that are read at once.
WIDE = 4096
STEPS, BATCH, RATE = 500, 256, 0.02
UNDETERMINED = "und"
#: Byte positions that count in pooling: ASCII letters and all bytes of other characters.
LETTER = np.zeros(256, dtype=np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    """Parameters by name; suffixes f and b are the two directions. inputs: (256, 3H) rows of a byte's gates; state: (3H, H)."""

    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["inputs" + d] = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
            p["state" + d] = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32)
            p["bias" + d] = np.zeros((3 * HIDDEN, 1), dtype=np.float32)
            p["out" + d] = rng.normal(0, 0.3, (len(languages), HIDDEN)).astype(np.float32)
        p["out"] = np.zeros((len(languages), 1), dtype=np.float32)
        return cls(languages, p)

    def step(self, d: str, h: np.ndarray, byte: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The next state (H, spans) from h and the spans' bytes."""
        p, n = self.p, HIDDEN
        x = p["inputs" + d][byte].T
        a = p["state" + d] @ h
        a += p["bias" + d]
        zr = _sigmoid(x[: 2 * n] + a[: 2 * n])
        z, r = zr[:n], zr[n:]
        c = np.tanh(r * a[2 * n :] + x[2 * n :])
        if keep is not None:
            keep.append((byte, h, z, r, a[2 * n :], c))
        return h + z * (c - h)

    def step_back(self, d: str, dh: np.ndarray, kept: tuple, grad: dict[str, np.ndarray]) -> np.ndarray:
        byte, h, z, r, ac, c = kept
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        dr = dc * ac * r * (1 - r)
        np.add.at(grad["inputs" + d], byte, np.concatenate([dz, dr, dc]).T)
        da = np.concatenate([dz, dr, dc * r])
        grad["state" + d] += da @ h.T
        grad["bias" + d] += da.sum(axis=1, keepdims=True)
        return dh * (1 - z) + self.p["state" + d].T @ da

    def probabilities(self, data: np.ndarray, inside: np.ndarray, kept: dict | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, language distribution of each span there), from the last position to the first.

        data: (SPAN, spans) bytes; inside: (SPAN, spans), 0 beyond a text's end, where no state is carried back.
        """
        spans, p = data.shape[1], self.p
        h = np.zeros((HIDDEN, spans), dtype=np.float32)
        part = np.empty((SPAN, len(self.languages), spans), dtype=np.float32)
        states: dict[str, list] = {"f": [], "b": []}
        for t in range(SPAN):
            h = self.step("f", h, data[t], None if kept is None else kept["f"])
            states["f"].append(h if kept is not None else None)
            np.matmul(p["outf"], h, out=part[t])
        h = np.zeros((HIDDEN, spans), dtype=np.float32)
        for t in range(SPAN - 1, -1, -1):
            h = self.step("b", h, data[t], None if kept is None else kept["b"])
            h *= inside[t]
            states["b"].append(h if kept is not None else None)
            y = part[t]
            y += p["outb"] @ h
            y += p["out"]
            y -= y.max(axis=0)
            np.exp(y, out=y)
            y /= y.sum(axis=0)
            yield t, y
        if kept is not None:
            kept["states"] = states

    def train(self, spans: list[bytes], label: np.ndarray, seed: int = 11) -> None:
        """Adam over cross-entropy at every letter position; some spans are shortened, as the ends of texts are."""
        rng = np.random.default_rng(seed)
        data = np.zeros((len(spans), SPAN), dtype=np.uint8)
        for i, s in enumerate(spans):
            data[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
        size = np.array([len(s) for s in spans])
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        by = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        for step in range(1, STEPS + 1):
            pick = np.concatenate([rng.choice(own, BATCH // len(by) + 1) for own in by])
            n = np.where(rng.random(len(pick)) < 0.25, np.minimum(size[pick], rng.integers(6, SPAN + 1, len(pick))), size[pick])
            own = data[pick].T
            inside = (np.arange(SPAN)[:, None] < n).astype(np.float32)
            weight = inside * LETTER[own]
            weight /= max(float(weight.sum()), 1)
            kept: dict = {"f": [], "b": []}
            dy = np.zeros((SPAN, len(self.languages), len(pick)), dtype=np.float32)
            for t, y in self.probabilities(own, inside, kept):
                dy[t] = y
                dy[t, label[pick], np.arange(len(pick))] -= 1
                dy[t] *= weight[t]
            grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            f, b = kept["states"]["f"], kept["states"]["b"][::-1]
            dh = np.zeros((HIDDEN, len(pick)), dtype=np.float32)
            for t in range(SPAN - 1, -1, -1):
                grad["outf"] += dy[t] @ f[t].T
                grad["outb"] += dy[t] @ b[t].T
                grad["out"] += dy[t].sum(axis=1, keepdims=True)
                dh = self.step_back("f", dh + self.p["outf"].T @ dy[t], kept["f"][t], grad)
            dh = np.zeros((HIDDEN, len(pick)), dtype=np.float32)
            for t in range(SPAN):
                dh = self.step_back("b", (dh + self.p["outb"].T @ dy[t]) * inside[t], kept["b"][SPAN - 1 - t], grad)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / STEPS)
            for k, g in grad.items():
                g *= min(1, 1 / max(norm, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts in one buffer: (texts, languages) sums of probabilities and of position labels, and their letter positions."""
        size = np.diff(offsets)
        per = -(-size // SPAN)
        owner = np.repeat(np.arange(len(size)), per)
        begin = offsets[owner] + SPAN * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
        n = np.minimum(offsets[owner + 1] - begin, SPAN)
        total, named, letters = np.zeros((len(size), len(self.languages))), np.zeros((len(size), len(self.languages))), np.zeros(len(size))
        for at in range(0, len(owner), WIDE):
            some, first = owner[at : at + WIDE], begin[at : at + WIDE]
            place = first[None, :] + np.arange(SPAN)[:, None]
            own = data[np.minimum(place, len(data) - 1)]
            inside = (np.arange(SPAN)[:, None] < n[at : at + WIDE]).astype(np.float32)
            weight = LETTER[own] * inside
            sums = np.zeros((2, len(self.languages), len(some)), dtype=np.float32)
            for t, y in self.probabilities(own, inside):
                sums[0] += y * weight[t]
                sums[1] += (y >= y.max(axis=0)) * weight[t]
            for out, rows in ((total, sums[0]), (named, sums[1]), (letters[:, None], weight.sum(axis=0)[None, :])):
                for k, row in enumerate(rows):
                    out[:, k] += np.bincount(some, row, minlength=len(size))
        return total, named, letters


def held_out(doc_id) -> object:
    """Rows that training leaves out: the checksum of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans of the texts, with their languages."""
    for batch in batches:
        lang, out = [], []
        for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            out += [raw[at : at + SPAN] for at in range(0, len(raw), SPAN)]
            lang += [name] * (len(out) - len(lang))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "span"])


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Network | None:
    """A network from the whole texts of at most `rows` distinct rows of each language: those with the least hashes of id and text.

    Only rows with text and language that are not held out; a row repeated with equal id and text counts once, and rows of
    one id with several texts count each. Every such language is learned, however many rows it has. None if there are no
    such rows. Other columns are not read.
    """
    own = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"))
    # Distinct rows are counted first; then the share of hash values that holds about four times the rows wanted is taken, so
    # that no other text is shuffled.
    shares = own.groupBy("lang").agg(F.least(F.lit(4.0 * rows) / F.approx_count_distinct("h", 0.03), F.lit(1.0)).alias("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))

    def least(of: DataFrame) -> DataFrame:
        return of.groupBy("lang", "h").agg(F.min("t").alias("t")).withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "t")

    share = {r["lang"]: r["share"] for r in shares.collect()}  # a row for each language, which are the network's outputs
    if not share:
        return None
    within = own.join(F.broadcast(shares.sparkSession.createDataFrame(list(share.items()), "lang string, share double")), "lang")
    sample = materialise(least(within.where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))), "language-sample")
    got = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    short = [lang for lang, x in share.items() if x < 1 and got.get(lang, 0) < rows]  # hashes that came out uneven: take all rows
    if short:
        sample = sample.where(~F.col("lang").isin(short)).union(least(own.where(F.col("lang").isin(short))))
    found = sorted((r["lang"], bytes(r["span"])) for r in sample.mapInArrow(_spans, "lang string, span binary").toLocalIterator())
    languages = sorted(share)
    network = Network.fresh(languages)
    network.train([s for _, s in found], np.array([languages.index(lang) for lang, _ in found]))
    return network


def _predict(batches: Iterator[pa.RecordBatch], network: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1), 1 << 18):
            texts = batch.column(1).slice(a, b - a).to_pylist()
            lang = [UNDETERMINED] * (b - a)
            score, share = np.zeros(b - a), np.zeros(b - a)
            if network is not None:
                total, named, n = network.documents(data, offsets)
                best = total.argmax(axis=1)
                for i, text in enumerate(texts):
                    if n[i] and any(c.isalpha() for c in text):
                        lang[i] = network.languages[best[i]]
                        score[i], share[i] = min(total[i, best[i]] / n[i], 1.0), min(named[i, best[i]] / n[i], 1.0)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[2:]), pa.array(lang), pa.array(score), pa.array(share)], [f"k{i}" for i in range(batch.num_columns - 2)] + ["lang_pred", "score", "labelled"])


def _identified(docs: DataFrame, network: Network | None, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """Columns k0, k1, ... as in `keep`, lang_pred, score and labelled."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    source = docs.select(F.lit(0).alias("o"), quoted(text_col).alias("t"), *(quoted(c).alias(f"k{i}") for i, c in enumerate(keep)))
    return source.mapInArrow(returning(lambda b: _predict(b, shared.value)), ", ".join([*kinds, "lang_pred string", "score double", "labelled double"]))


def identify_languages(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in `keep` and lang_pred, score (mean probability of it) and labelled (share of positions with that label).

    Texts that are null or have no letter, or all without a network, are `und` with score 0. Equal probabilities go to the
    first language by name. One narrow pass; repeated rows are predicted each; other columns are not read.
    """
    return _identified(docs, network, keep, text_col).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "labelled")


def in_known_languages(docs: DataFrame, network: Network | None, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, in all their columns, whatever these are named, whose language is found with at least that score."""
    found = _identified(docs, network, tuple(docs.columns), text_col).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
