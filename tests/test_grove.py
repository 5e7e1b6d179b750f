"""Grouped forests: passes and parts give the same trees as growing whole, by plain search over all features and cuts."""

import numpy as np
from pyspark.sql import functions as F

from immunoscan.operators import grove as G
from immunoscan.operators import learning as L

gen = np.random.default_rng(2)
SPEC = G.spec_of(3, [(0, [0.0, 1.0, 2.0, 3.0]), (0, [5.0, 1.0, 1.0, 9.0]), (1, [0.0, 0.0, 1.0, 1.0]), (2, [3.0, 2.0, 1.0, 0.0])])
ROWS = [(g, int(i), bytes(c.tolist()), float(2 * c[0] - (c[2] > 1) * c[1] + e)) for g, n in (("big", 900), ("mid", 200), ("tiny", 4), ("one", 1)) for i, c, e in zip(range(n), gen.integers(0, 4, (n, 3)), gen.normal(size=n), strict=True)]


def _plain(rows, weights, node, depth, leaf):
    """Every feature and every cut between two of its values, tried out."""
    y, w = np.array([r[3] for r in rows]), weights
    out = [(node, float((w * y).sum() / w.sum()))]
    if node.bit_length() > depth or w.sum() < 2 * leaf:
        return out
    top = (1e-9 * max(1.0, abs((w * y).sum())), None)
    for f in range(len(SPEC.reads)):
        v = SPEC.values[f][[r[2][SPEC.reads[f]] for r in rows]]
        for cut in sorted(set(SPEC.values[f]))[:-1]:
            left = v <= cut
            a, b = w[left].sum(), w[~left].sum()
            if a >= leaf and b >= leaf:
                gain = (w * y)[left].sum() ** 2 / a + (w * y)[~left].sum() ** 2 / b - (w * y).sum() ** 2 / w.sum()
                if gain > top[0] + 1e-9:
                    top = (gain, left)
    if top[1] is None:
        return out
    for child, side in ((2 * node, top[1]), (2 * node + 1, ~top[1])):
        out += _plain([r for r, s in zip(rows, side, strict=True) if s], w[side], child, depth, leaf)
    return out


def _forest(df, **how):
    return {(r["group"], r["tree"], r["node"]): round(r["value"], 9) for r in G.fit(df, SPEC, trees=3, depth=4, leaf=3, **how).collect()}


def test_passes_and_parts_grow_the_same_trees(spark):
    df = spark.createDataFrame(ROWS, "group string, id long, codes binary, y double")
    want = {}
    for g in ("big", "mid", "tiny", "one"):
        own = [r for r in ROWS if r[0] == g]
        draws = G.draws(np.array([r[1] for r in own]), 3)
        for t in range(3):
            use = draws[:, t] > 0
            if use.any():
                want |= {(g, t, n): round(v, 9) for n, v in _plain([r for r, u in zip(own, use, strict=True) if u], draws[use, t].astype(float), 1, 4, 3)}
    assert _forest(df) == want  # all in parts
    assert _forest(df.repartition(7), local=150) == want  # the large nodes by passes
    assert _forest(df.repartition(3), local=2) == want  # nearly all by passes
    assert G.fit(df.where("id < 0"), SPEC).isEmpty()


def test_predictions_are_means_of_leaves(spark):
    df = spark.createDataFrame(ROWS, "group string, id long, codes binary, y double").repartition(4)
    forest = G.fit(df, SPEC, trees=3, depth=4).cache()
    nodes = {(r["group"], r["tree"], r["node"]): r for r in forest.collect()}
    for most in (5_000_000, 10):
        got = {(r["group"], r["id"]): r["predicted"] for r in G.predict(df, forest, most).collect()}
        for g, i, c, _ in ROWS:
            trees = 1 + max((t for h, t, _ in nodes if h == g), default=-1)
            if not trees or any((g, t, 1) not in nodes for t in range(trees)):
                continue
            values = []
            for t in range(trees):
                node = nodes[g, t, 1]
                while node["column"] >= 0:
                    node = nodes[g, t, 2 * node["node"] + (0 if node["mask"] >> c[node["column"]] & 1 else 1)]
                values.append(node["value"])
            assert abs(got[g, i] - np.mean(values)) < 1e-9


def test_codes_stand_for_the_padded_features(spark):
    peptides = ["SIINFEKL", "GILGFVFTL", "LLFGYPVYVAXQ", "ACDEFGHIKLMNPQRS", "A"]
    df = spark.createDataFrame([(p,) for p in peptides], "p string").select(L.encode_padded(F.col("p"), 12).alias("f"), L.padded_codes(F.col("p")).alias("c"))
    spec = L.padded_spec(12)
    place = {(p, j): 40 * p + j for p in range(12) for j in range(20)}
    for r in df.collect():
        got = [spec.values[f][r["c"][spec.reads[f]]] for f in range(len(spec.reads))]
        hot = [got[place[p, j]] for p in range(12) for j in range(20)]
        rows = [got[place[p, j] + 20] for p in range(12) for j in range(20)]
        assert hot + rows + got[480:] == r["f"]


def test_boosting_equals_plain_rounds(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] in ("mid", "one")], "group string, id long, codes binary, y double").repartition(3)
    own = [r for r in ROWS if r[0] == "mid"]
    codes, now = [r[2] for r in own], np.full(200, np.mean([r[3] for r in own]))
    for _ in range(3):
        left = [(*r[:3], float(r[3] - p)) for r, p in zip(own, now, strict=True)]
        nodes = dict(_plain(left, np.ones(200), 1, 2, 1))
        splits = {r["node"]: r for r in G.fit(spark.createDataFrame(left, "group string, id long, codes binary, y double"), SPEC, 1, 2, 1, sample=False).collect()}
        assert {n: round(r["value"], 9) for n, r in splits.items()} == {n: round(v, 9) for n, v in nodes.items()}
        for i, c in enumerate(codes):
            node = 1
            while splits[node]["column"] >= 0:
                node = 2 * node + (0 if splits[node]["mask"] >> c[splits[node]["column"]] & 1 else 1)
            now[i] += 0.1 * splits[node]["value"]
    for local in (20_000, 100):  # in a task, and round by round
        got = {r["id"]: r["predicted"] for r in G.predict(df.where("group = 'mid'"), G.boost(df, SPEC, 3, 2, 1, 0.1, local)).collect()}
        assert np.allclose([got[r[1]] for r in own], now, atol=1e-9)
