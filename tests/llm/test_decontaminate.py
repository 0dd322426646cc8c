"""Phrase and proximity matches of the positional index against a search word by word."""

import random
import re
from collections import Counter

import pytest

import lacuna.llm.decontaminate as D
from lacuna.llm.decontaminate import contamination, uncontaminated

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def windows(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(docs, items, size, within):
    count = Counter(x for _, t in docs for x in words(t))
    out = []
    for doc, text in docs:
        w, hit, exact, near = words(text), set(), set(), set()
        for item, item_text in items:
            for win in windows(item_text, size):
                n = len(win)
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == win:
                        exact.add(str(item))
                        hit |= set(range(s, s + n))
                order = sorted(range(n), key=lambda j: count[win[j]])
                for p in range(len(w)):
                    if w[p] == win[order[0]] and all(x in w[max(p - within, 0) : p + within + 1] for x in win):
                        near.add(str(item))
        out.append((doc, len(w), len(hit), sorted(exact), sorted(near), sorted(hit)))
    return out


@pytest.mark.parametrize("block,step", [(8 << 20, 1 << 20), (40, 1 << 20), (300, 60)])
def test_against_brute_force(spark, monkeypatch, block, step):
    rng = random.Random(block + step)
    vocab = [f"w{i}" for i in range(25)] + ["É", "ça", "A", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9])))) for i in range(14)]
    items += [(3, "w1 w2 w3 w4"), (3, "w1 w2 w3 w4"), (90, None), (91, ""), (92, " .,"), (93, "zzz w1 w2")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 30]))]
        for _ in range(rng.randrange(3)):
            own = words(rng.choice(items)[1])
            if rng.random() < 0.4:
                rng.shuffle(own)
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((i, rng.choice([" ", ", "]).join(w)))
    docs += [(60, None), (61, docs[5][1]), (61, docs[5][1]), (62, "w1 " * 500)]
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    plain = D.slices
    monkeypatch.setattr(D, "slices", lambda texts: plain(texts, step))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, seg string, n_hit int").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.near), sorted({p for s in r.spans for p in range(s.start, s.end)})) for r in contamination(df, it, 4, within=6).collect()]
    want = brute(docs, items, 4, 6)
    assert sorted(got) == sorted(want)
    assert any(set(n) - set(e) for _, _, _, e, n, _ in want)  # proximity finds more than phrases
    kept = uncontaminated(df, it, 4)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, h, *_ in want if not h)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(docs.limit(0), items).collect() == [] and uncontaminated(docs.limit(0), items).collect() == []
    assert [r.n_hit for r in contamination(docs, items.limit(0)).collect()] == [0] and uncontaminated(docs, items.limit(0)).count() == 1
    assert [(r.n_hit, r["items"]) for r in contamination(docs, items).collect()] == [(3, ["1"])]
