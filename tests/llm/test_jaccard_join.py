import random
import re

import pytest
from pyspark.sql import functions as F

import lacuna.llm.jaccard_join as join
from lacuna.llm.jaccard_join import jaccard_components, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [tokens(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ça", "A", "a"]
    rows = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w) if rng.random() < 0.8 else "\n ".join(w).upper())
    rows += [None, "", " \t", "x" * 5000, rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = make(seed)
    rows += [(5, "one two three four five six"), (5, rows[7][1])]  # repeated ids
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, point string").repartition(3)
    got = sorted(tuple(r) for r in jaccard_components(df).collect())
    assert got == brute(rows)


def test_large_group_of_near_copies_and_empty_table(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)
    assert jaccard_components(df.limit(0)).collect() == []


def near_copies(rng, m, size=60, changes=2):
    base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(m):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(size)] = f"u{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def chain(rng, m, size=60):
    """Texts of which each is linked to the next only."""
    words = [f"c{rng.randrange(10**7)}" for _ in range(size + 3 * m)]
    return [" ".join(words[3 * i : 3 * i + size]) for i in range(m)]


@pytest.mark.parametrize("held", [8, 1 << 22])
def test_large_cells_and_groups_in_blocks(spark, monkeypatch, held):
    """All splits at once: buckets in parts, cells and groups in many blocks, rings and pairs of blocks."""
    rng = random.Random(9)
    texts = near_copies(rng, 120, 150) + near_copies(rng, 50, 200, 8) + chain(rng, 60) + [f"{i} alone " * 3 for i in range(30)]
    rng.shuffle(texts)
    monkeypatch.setattr(join, "HELD", held)
    monkeypatch.setattr(join, "CELL", 8)
    monkeypatch.setattr(join, "GROUP", 400)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_null_and_repeated_ids_keep_their_links(spark):
    rng = random.Random(2)
    a, b, c = chain(rng, 3)
    x, y = near_copies(rng, 2, 120, 1)
    rows = [(1, a), (None, b), (None, b), (5, c), (None, x), (None, y), (7, "other words of one text"), (7, "all that is different here is so"), (8, None), (None, None), (None, " ")]
    df = spark.createDataFrame([(i, t, "k", 3, 4) for i, t in rows], "doc_id long, text string, node string, h int, rep int")
    got = sorted(map(str, jaccard_components(df).select("doc_id", "component_id", F.col("n_shingles") > 0).collect()))
    want = [(1, 1, True), (None, 1, True), (None, 1, True), (5, 1, True), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 8, False), (None, None, False), (None, None, False)]
    assert [x[x.index("doc_id") :] for x in got] == sorted(f"doc_id={i}, component_id={k}, (n_shingles > 0)={n})" for i, k, n in want)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    texts = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert ("1", a) in texts and not {t for _, t in texts} & {b, c} and len({t for _, t in texts} & {x, y}) == 1 and len(texts) == 7
    assert one_of_each(df.limit(0)).collect() == []


def test_one_of_each_against_brute_force(spark):
    rows = make(11)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    low = {i: k for i, _, k in brute(rows)}
    want = sorted(i for i, t in rows if low[i] == i)
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == want
