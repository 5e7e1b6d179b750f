"""Leave-one-group-out forests against forests that are grown one by one."""

import numpy as np
import pytest

from immunoscan.operators import fold_forest as FF
from immunoscan.operators.grove import draws

CUTS = [np.array([-1.0, 0.0, 0.5, 1.0]), np.array([0.0]), np.array([2.0, 4.0, 6.0])]
HOW = {"trees": 7, "depth": 4, "leaf": 5, "tries": 2}


def _table():
    gen = np.random.default_rng(3)
    g = np.where(gen.random(600) < 0.4, 0, gen.integers(0, 7, 600))  # one group holds nearly half of the rows
    x = np.c_[gen.normal(size=600), gen.integers(-1, 2, 600), gen.normal(3, 3, 600)]
    y = (x[:, 0] + (x[:, 2] > 4) + gen.normal(size=600) > 1).astype(int)
    y[g == 6] = 0  # never held out
    return np.array([f"g{k}" for k in g], object), np.arange(600) * 7919, y, x


def _plain(b, y, w, weight, tree, tries, leaf, depth, place=1):
    """A tree over bins by recursion, as nested tuples, tried split by split."""
    mass = np.array([w[y == k].sum() * weight[k] for k in (0, 1)])
    p = mass[1] / mass.sum()
    if place.bit_length() > depth or w.sum() < 2 * leaf or p in (0, 1):
        return p
    gini = lambda m: 0 if m.sum() == 0 else m.sum() - (m**2).sum() / m.sum()
    top, seen = None, 0
    for c in FF.column_order(tree, place, b.shape[1]):
        if seen >= tries and top is not None:
            break
        seen += 1
        for cut in range(int(b[:, c].max()) if len(b) else 0):
            low = b[:, c] <= cut
            if min(w[low].sum(), w[~low].sum()) < leaf:
                continue
            sides = [np.array([w[s & (y == k)].sum() * weight[k] for k in (0, 1)]) for s in (low, ~low)]
            gain = gini(mass) - sum(map(gini, sides))
            if gain > 1e-9 * mass.sum() and (top is None or gain > top[0] + 1e-9 * mass.sum()):
                top = (gain, c, cut)
    if top is None:
        return p
    _, c, cut = top
    low = b[:, c] <= cut
    return c, cut, *[_plain(b[s], y[s], w[s], weight, tree, tries, leaf, depth, 2 * place + k) for k, s in enumerate((low, ~low))]


def _walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _frame(spark, g, ids, y, x):
    return spark.createDataFrame([(a, int(i), int(b), *map(float, v)) for a, i, b, v in zip(g, ids, y, x)], "g string, i long, y int, a double, b double, c double")


def test_equal_to_forests_one_by_one(spark):
    g, ids, y, x = _table()
    bins = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(CUTS)], axis=1)
    want = {}
    for fold in sorted(set(g) - {"g6"}):
        use = g != fold
        n, ones = use.sum(), y[use].sum()
        weight = (n / (2 * (n - ones)), n / (2 * ones))
        w = draws(ids[use], HOW["trees"])
        grown = [_plain(bins[use][w[:, t] > 0], y[use][w[:, t] > 0], w[w[:, t] > 0, t], weight, t, 2, 5, 4) for t in range(HOW["trees"])]
        want |= {int(i): np.mean([_walk(t, b) for t in grown]) for i, b in zip(ids[~use], bins[~use])}
    df = _frame(spark, g, ids, y, x)
    for parts, block, lot in ((1, 100, 7), (5, 4, 3)):
        got = {r["id_"]: r["p_"] for r in FF.scores(df.repartition(parts), "g", "i", "y", ["a", "b", "c"], cuts=CUTS, block=block, lot=lot, **HOW).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    p, t = np.array([want[int(i)] for i in ids[g == "g0"]]).round(12), y[g == "g0"]
    area = np.mean((p[t == 1][:, None] > p[t == 0]) + 0.5 * (p[t == 1][:, None] == p[t == 0]))
    found = {r["g"]: r["auc"] for r in FF.left_out(df, "g", "i", "y", ["a", "b", "c"], cuts=CUTS, **HOW).collect()}
    assert found.keys() == set(g) - {"g6"} and found["g0"] == pytest.approx(area, abs=1e-6) and area > 0.7


def test_odd_tables(spark):
    schema = "g string, i long, y int, a double"
    assert FF.scores(spark.createDataFrame([], schema), "g", "i", "y", ["a"], trees=2).isEmpty()
    # one group only: nothing is left to learn from
    assert FF.left_out(spark.createDataFrame([("x", k, k % 2, 1.0) for k in range(9)], schema), "g", "i", "y", ["a"], trees=2).isEmpty()
    # nulls: values count as 0, labels as class 0, a null group teaches but is never held out; equal values can't be split
    rows = [(k, 10 * n + i, i % 2, None) for n, k in enumerate(("x", "y", None)) for i in range(8)] + [("x", 99, None, None)]
    done = FF.scores(spark.createDataFrame(rows, schema), "g", "i", "y", ["a"], trees=3).collect()
    assert {r["group_"] for r in done} == {"x", "y"} and len(done) == 17 and all(0 <= r["p_"] <= 1 for r in done)
