"""Distributed ranks, exact signed-rank tests and shared-pass folds, against plain Python and numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from immunoscan.operators import assays as A
from immunoscan.operators import folds as FO
from immunoscan.operators import learning as L
from immunoscan.operators import peptides as P
from immunoscan.operators import ranks as R

rng = random.Random(8)
ROWS = [("hot", rng.choice([0.0, 1.5, 2.0, float(rng.randrange(40))]), i) for i in range(900)]
ROWS += [(g, rng.choice([None, 1.0, 2.0]), 1000 + 10 * k + i) for k, g in enumerate("abcdefgh") for i in range(rng.randint(1, 6))] + [(None, 1.0, 5000), (None, 2.0, 5001)]


def _mean_ranks(values):
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    return {v: np.mean([i + 1 for i, o in enumerate(order) if o == v]) for v in set(values)}


def test_tied_and_numbered(spark):
    df = spark.createDataFrame(ROWS, "g string, v double, id long").repartition(5)
    groups = {}
    for g, v, i in ROWS:
        groups.setdefault(g, []).append((v, i))
    want = {(g, v): r for g, rows in groups.items() for v, r in _mean_ranks([v for v, _ in rows]).items()}
    assert {(r["g"], r["v"]): r["rank"] for r in R.tied(df, ["g"], "v").collect()} == want
    got = {r["id"]: (r["row_number"], r["total"]) for r in R.numbered(df, ["g"], ["v", "id"]).collect()}
    assert got == {i: (n + 1, len(rows)) for rows in groups.values() for n, (_, i) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))}
    assert R.numbered(df.where("id < 0"), ["g"], ["v"]).isEmpty()


def test_no_window_over_a_group(spark):
    df = spark.createDataFrame(ROWS, "g string, v double, id long")
    plan = P.model_rows(df.withColumnRenamed("v", "y"), ["g"], "y", "id")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # over rows only within a range; the other windows are over one row a range and group
    assert all("range_" in line for line in windows if "a_n" in line) and windows


def test_auc(spark):
    rows = [("x", rng.choice([1.0, 2.0, 3.0, 4.0, 5.0]), rng.random() < 0.4) for _ in range(300)] + [("one", 1.0, True), ("one", 2.0, True)]
    got = {r["g"]: r["auc"] for r in A.auc(spark.createDataFrame(rows, "g string, v double, t boolean"), "g", "v", "t").collect()}
    pos, neg = [v for g, v, t in rows if g == "x" and t], [v for g, v, t in rows if g == "x" and not t]
    assert got["one"] is None and got["x"] == round(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)), 6)


def _exact(diffs):
    """p over all sign patterns."""
    size = _mean_ranks([abs(d) for d in diffs])
    ranks = [size[abs(d)] for d in diffs]
    w = sum(r for r, d in zip(ranks, diffs) if d > 0)
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(diffs))]
    return min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))


@pytest.mark.parametrize("seed", range(4))
def test_signed_ranks_equal_all_sign_patterns(spark, seed):
    r = random.Random(seed)
    base = {i: float(r.randrange(6)) for i in range(12)}
    methods = {m: {i: b + r.choice([-3, -2, -1, 0, 1, 1, 2, 3, 4]) * (m != "same") for i, b in base.items()} for m in ("m", "n", "same")}
    methods["up"] = {i: b + 1 + i for i, b in base.items()}
    rows = [("base", str(i), b) for i, b in base.items()] + [(m, str(i), v) for m, vs in methods.items() for i, v in vs.items()]
    got = {x["method"]: x for x in L.signed_ranks(spark.createDataFrame(rows, "method string, g string, v double"), "method", "g", "v", "base").collect()}
    for m, vs in methods.items():
        diffs = [vs[i] - base[i] for i in base if vs[i] != base[i]]
        assert got[m]["pairs"] == len(diffs) and got[m]["kind"] == "exact" and got[m]["p"] == pytest.approx(_exact(diffs) if diffs else 1.0, abs=1e-9)
    assert got["up"]["label"] == "better" and got["same"]["label"] == "no different" and got["same"]["pairs"] == 0


def test_signed_ranks_of_many_pairs_are_normal(spark):
    r = random.Random(1)
    rows = [(m, i, r.gauss(0.4 * (m == "m"), 1)) for m in ("base", "m") for i in range(400)]
    df = spark.createDataFrame([(m, str(i), v) for m, i, v in rows], "method string, g string, v double")
    got = L.signed_ranks(df, "method", "g", "v", "base").first()
    n = got["pairs"]
    z = (got["w_plus"] - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert got["kind"] == "normal" and got["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)
    # both ways agree where both can be had
    few = df.where("g < '140'")
    assert L.signed_ranks(few, "method", "g", "v", "base").first()["p"] == pytest.approx(L.signed_ranks(few, "method", "g", "v", "base", exact=0).first()["p"], abs=0.02)


def test_signed_ranks_stay_exact_up_to_the_given_number_of_pairs(spark):
    r = random.Random(2)
    rows = [(m, i, r.randrange(40) + 3.0 * (m == "m")) for m in ("base", "m") for i in range(300)]
    df = spark.createDataFrame([(m, str(i), float(v)) for m, i, v in rows], "method string, g string, v double")
    got = L.signed_ranks(df, "method", "g", "v", "base", exact=1023).first()
    v = {m: {i: x for k, i, x in rows if k == m} for m in ("base", "m")}
    diffs = [v["m"][i] - v["base"][i] for i in v["base"] if v["m"][i] != v["base"][i]]
    size, ways = _mean_ranks([abs(d) for d in diffs]), {0: 1}
    for d in diffs:  # whole numbers of any size
        step = int(2 * size[abs(d)])
        ways = {s: ways.get(s, 0) + ways.get(s - step, 0) for s in {*ways, *(s + step for s in ways)}}
    w = int(2 * sum(size[abs(d)] for d in diffs if d > 0))
    p = 2 * min(sum(n for s, n in ways.items() if s <= w), sum(n for s, n in ways.items() if s >= w)) / 2 ** len(diffs)
    assert got["pairs"] == len(diffs) > 50 and got["kind"] == "exact" and got["p"] == pytest.approx(min(1.0, p), abs=1e-9)


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 1.99, 2.0, 3.5, 8.0])
def test_upper_tail(spark, z):
    got = spark.range(1).select(L.upper_tail(F.lit(z))).first()[0]
    assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def _plain(x, y, penalty=1.0):
    """A balanced logistic regression by plain Newton steps: weights on standardised features, and the constant."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    ridge, b = penalty * np.array([1.0] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * b)
    return b, mean, sd


def test_folds_equal_plain_fits(spark):
    gen = np.random.default_rng(5)
    g = gen.integers(0, 6, 400)
    x = gen.normal(size=(400, 3)) * [1, 5, 0.1] + g[:, None]
    y = (gen.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 2.5)))).astype(int)
    y[g == 5] = 1  # a group of one class is left out by no fold
    df = spark.createDataFrame([(f"s{a}", int(b), *map(float, c)) for a, b, c in zip(g, y, x)], "s string, label int, a double, b double, c double").repartition(7)
    sets = {"one": ["b"], "all": ["a", "b", "c"]}
    got = {(k, h): (raw, std) for k, h, raw, std in FO.fit(df, "s", "label", sets, block=4)}
    assert {h for _, h in got} == {f"s{i}" for i in range(5)} | {FO.NONE}
    for (k, h), (raw, std) in got.items():
        cols = ["abc".index(c) for c in sets[k]]
        use = np.array([f"s{i}" != h for i in g])
        b, mean, sd = _plain(x[use][:, cols], y[use])
        assert np.allclose(std, b[:-1], atol=1e-6) and np.allclose(raw, [*(b[:-1] / sd), b[-1] - (b[:-1] / sd) @ mean], atol=1e-6)
    out = {(r["features"], r["s"]): r["auc"] for r in FO.left_out(df, "s", "label", sets).collect()}
    for (k, h), auc in out.items():
        test = np.array([f"s{i}" == h for i in g])
        cols = ["abc".index(c) for c in sets[k]]
        score = x[test][:, cols] @ np.array(got[k, h][0][:-1])
        pos, neg = score[y[test] == 1], score[y[test] == 0]
        assert auc == pytest.approx(np.mean(pos[:, None] > neg[None]) + 0.5 * np.mean(pos[:, None] == neg[None]), abs=1e-6)
    top = FO.all_weights(df, "s", "label", sets).where("features = 'all' and place = 1").first()
    assert top["feature"] == "a"
