"""Language identification: a scalar version of the network, the training sample, odd rows, held-out accuracy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import language as L
from lacuna.llm.language import HIDDEN, SPAN, Network, identify_languages, train_languages
from lacuna.llm.queries import op2_language_id

LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def brute(network, text):
    """One byte at a time, in double precision."""
    raw, p, total, letters = text.encode(), network.p, np.zeros(len(network.languages)), 0

    def step(d, h, byte):
        x, a = p["inputs" + d][byte].astype(float), p["state" + d].astype(float) @ h + p["bias" + d][:, 0]
        z, r = sigmoid(x[:HIDDEN] + a[:HIDDEN]), sigmoid(x[HIDDEN : 2 * HIDDEN] + a[HIDDEN : 2 * HIDDEN])
        return h + z * (np.tanh(r * a[2 * HIDDEN :] + x[2 * HIDDEN :]) - h)

    for at in range(0, len(raw), SPAN):
        span, ahead, back = raw[at : at + SPAN], [], []
        h = np.zeros(HIDDEN)
        for byte in span:
            ahead.append(h := step("f", h, byte))
        h = np.zeros(HIDDEN)
        for byte in reversed(span):
            back.append(h := step("b", h, byte))
        for byte, f, b in zip(span, ahead, reversed(back), strict=True):
            y = np.exp(p["outf"] @ f + p["outb"] @ b + p["out"][:, 0])
            if byte in LETTERS:
                total += y / y.sum()
                letters += 1
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    return network.languages[int(total.argmax())], float(total.max() / letters)


@pytest.fixture(scope="module")
def network(spark):
    words = {"en": "the and of in to is that", "de": "der die und das ein ist nicht", "es": "el la y de que los una"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[lang].split(), 40)), lang) for i, lang in enumerate(list(words) * 40)]
    return train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_against_one_byte_at_a_time(spark, network, monkeypatch):
    texts = ["the and of", "der die und das " * 30, "é", "123", "", " ", "el la y los una 7 %", "日本語 the", "x" * 1000, "und und und, the!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [brute(network, t) for t in texts]
    for wide in (L.WIDE, 3):
        monkeypatch.setattr(L, "WIDE", wide)
        data, offsets = np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
        total, _, n = network.documents(data, offsets)
        for i, (lang, score) in enumerate(want):
            assert lang == "und" or (network.languages[total[i].argmax()] == lang and np.isclose(total[i].max() / n[i], score, atol=1e-4))
    for r in identify_languages(df, network).collect():
        assert r.lang_pred == want[r.doc_id][0] and np.isclose(r.score, want[r.doc_id][1], atol=1e-4)


@pytest.mark.parametrize("seed", range(6))
def test_repeated_ids_keep_every_language(spark, seed, monkeypatch):
    """Many rows of one id, beside many ids: neither language may be lost from the sample."""
    one = next(i for i in range(seed * 50, 10**6) if not spark_crc(i))
    rows = [(one, f"the and of {i}", "en") for i in range(2500)] + [(i, f"der die das {i}", "de") for i in range(2500)] + [(one, "copy", "xx")] * 900
    seen = {}
    monkeypatch.setattr(Network, "train", lambda self, spans, label: seen.update(zip(*np.unique(label, return_counts=True), strict=True)))
    got = train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert got.languages == ["de", "en", "xx"] and seen == {0: 20, 1: 20, 2: 1}


def spark_crc(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_all_spans_of_the_sample_are_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Network, "train", lambda self, spans, label: seen.extend(spans))
    text = "".join(f"word{i} " for i in range(4000))
    train_languages(spark.createDataFrame([(2, text, "en")] * 3, "doc_id long, text string, lang string"))
    assert b"".join(sorted(seen, key=text.encode().index)).decode() == text


def test_repeated_rows_nulls_and_clashing_columns(spark, network):
    rows = [(1, "the and of", "en", 0.5, "z", b"k"), (1, "the and of", "en", 0.5, "z", b"k"), (None, None, None, None, None, None), (2, "", "de", 1.0, "y", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, t binary")
    out = identify_languages(df.select("doc_id", "text", "lang", "t"), network, keep=("doc_id", "t"))
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 4)) for r in out.collect())
    assert got[0] == (0, "und", 0.0) and got[1] == got[2] and got[1][1] == "en" and got[3] == (2, "und", 0.0)
    assert {r.lang_pred for r in identify_languages(df, network).collect()} == {"en", "und"}
    assert identify_languages(df.limit(0), network).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = op2_language_id(spark, sf).where("held_out").join(true, "doc_id").where("lang is not null and lang_pred <> 'und'")
    n, good = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and good / n > 0.97
