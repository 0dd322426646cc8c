"""Nearest neighbours against brute force, at the recall that ships."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import lacuna.llm.neighbours as N
from lacuna.llm.neighbours import RECALL, Tree, nearest


def brute(x, k):
    """{query: [(id, cosine)]} of the ids divisible by 50."""
    u = {i: v / np.abs(v).max() for i, v in x.items()}
    u = {i: v / np.linalg.norm(v) for i, v in u.items()}
    ids, m = np.array(sorted(u)), np.stack([u[i] for i in sorted(u)])
    out = {}
    for q in ids[ids % 50 == 0].tolist():
        score = m @ u[q]
        order = [(-round(s, 12), i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q]
        out[q] = [(i, -s) for s, i in sorted(order)[:k]]
    return out


def found(df, k=5, **more):
    got = {}
    for r in sorted(nearest(df, F.col("vec_id") % 50 == 0, k, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("kind", ["clusters", "plain"])
def test_recall_of_a_tree_that_grows(spark, monkeypatch, kind):
    """At the default recall, on a tree with several rounds of leaves fitted further."""
    monkeypatch.setattr(N, "SAMPLE", 600)
    monkeypatch.setattr(N, "LEAF", 20)
    monkeypatch.setattr(N, "FULL", 60)
    rng = np.random.default_rng(7)
    n, d = 6000, 12
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = 0.15 * x + rng.normal(size=(80, d))[rng.integers(0, 80, n)]
        x[rng.integers(0, n, 60)] = 5 * rng.normal(size=(60, d))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got, want = found(df), brute(dict(enumerate(x)), 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert RECALL == 0.95 and hits >= 0.9 * 5 * len(want)
    for q, own in got.items():
        assert all(np.isclose(s, x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i]), rtol=0, atol=1e-12) for i, s in own)
        assert own == sorted(own, key=lambda r: (-r[1], r[0]))
    index = spark.createDataFrame([(i, i, v, [i]) for i, v in enumerate(x.tolist())], "w1 long, w2 int, v array<double>, ids array<long>").withColumn("w1", F.xxhash64("w1"))
    tree, filed, held = N.planted(index, d)
    sizes = [r["count"] for r in filed.groupBy("leaf").count().collect()]
    assert sum(sizes) == n == held.sum() and max(sizes) <= 60 and len(held) > 100  # leaves stay small, their number grows


def test_doubles_far_from_one(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [1.0, 1.0000001]), (3, [-1e300, 1e10]), (4, [1.0, 1.0]), (5, [5e-324, 0.0]), (6, [1.0, 2.0, 3.0])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0)[0]
    assert [i for i, _ in got] == [4, 2, 1, 5, 3] and got[0][1] == pytest.approx(1, abs=1e-15) and got[1][1] < got[0][1] and got[2][1] == pytest.approx(0.5**0.5) and got[4][1] == pytest.approx(-(0.5**0.5))


def test_leaves_go_on_until_they_hold_enough():
    tree = Tree(np.zeros((5, 1)), np.array([[1, 5], [0, 0], [0, 0], [0, 0], [0, 0]]), np.array([-1, 0, 1, 2, 3]))
    held = np.array([1, 2, 4, 9])
    assert len(tree.visit(np.zeros(1), 1, held, 6)) == 3 and len(tree.visit(np.zeros(1), 1, held, 1)) == 1 and len(tree.visit(np.zeros(1), 4, held, 0)) == 4


def test_odd_rows_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("inf")]), (8, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("v", "id", "asks", "leaf", "rank", "query_id")})
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(df, F.col("vec_id") % 50 == 0, recall=1.0).collect())
    assert [r for r in got if r[0] == 50] == [(50, 1, 8), (50, 2, 0), (50, 3, 0)]
    assert {r[2] for r in got if r[0] == 0} == {8, 50}
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
