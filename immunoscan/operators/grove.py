"""Regression forests for many groups at once, grown level by level in shared passes.

A row is a few small codes (the letters of a peptide, its length). Features are tables over one code each, so a node needs only
the sums by column and code, whatever the number of features; a split is the set of codes that go left.

Nodes with more than ``local`` rows grow by passes over all rows: tasks add up the sums of every such node of every tree and
group, these are added up by node, and the best split of each is one row. When no node is that large, rows are
dealt out once by (group, tree, node) and each part grows to its end in a task. So a group may be of any size, small groups
cost no pass, and the number of passes is at most the depth. Rows count once to several times in a tree, as a
Poisson draw from their id and the tree says: the same for every partitioning, and after a lost task.

A forest is a table: group, tree, node (root 1, children 2i and 2i + 1), column (-1: a leaf), mask (bit c: code c goes left), value, n.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

NODES = "group string, tree int, node long, column int, mask long, value double, n double"
TOP = 1 << 22  # more than any node of a tree 20 deep


@dataclass
class Spec:
    """Features: the column each one reads, and its value for each code."""

    columns: int
    codes: int
    reads: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.values, axis=1, kind="stable")
        ordered = np.take_along_axis(self.values, self.order, axis=1)
        self.cuts = ordered[:, :-1] < ordered[:, 1:]  # between equal values there is no split


def spec_of(columns: int, features: list[tuple[int, list[float]]]) -> Spec:
    codes = max(len(v) for _, v in features)
    values = np.array([[*v, *[v[-1]] * (codes - len(v))] for _, v in features], float)
    return Spec(columns, codes, np.array([c for c, _ in features]), values)


def draws(ids: np.ndarray, trees: int) -> np.ndarray:
    """How often each row (of a long id) counts in each tree."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    steps = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) if k else np.exp(-1) for k in range(9)])
    return np.searchsorted(steps, u, side="right")


def once(ids: np.ndarray, trees: int) -> np.ndarray:
    return np.ones((len(ids), trees), np.int64)


def sums(codes: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec) -> np.ndarray:
    """Rows and sums of y by column and code."""
    flat = (codes + np.arange(spec.columns) * spec.codes).ravel()
    size = spec.columns * spec.codes
    n = np.bincount(flat, np.repeat(w, spec.columns), size)
    return np.stack([n, np.bincount(flat, np.repeat(w * y, spec.columns), size)]).reshape(2, spec.columns, spec.codes)


def best(cells: np.ndarray, leaf: int, spec: Spec) -> tuple[int, int, float, float]:
    """Column (-1 for none), mask, rows on the left and on the right of the split that lowers the squared error most. Of equal ones the first."""
    n, s = np.cumsum(np.take_along_axis(cells[:, spec.reads], spec.order[None], axis=2), axis=2)
    total, mass = n[0, -1], s[0, -1]
    left, low = n[:, :-1], s[:, :-1]
    right = total - left
    ok = spec.cuts & (left >= leaf) & (right >= leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, low**2 / left + (mass - low) ** 2 / right - mass**2 / total, 0.0)
    top = gain.max()
    at = int((gain >= top - 1e-9 * max(1.0, top)).argmax())  # the first of those that differ by rounding only, in whatever order sums were added
    f, j = divmod(at, gain.shape[1])
    if gain[f, j] <= 1e-9 * max(1.0, abs(mass)):
        return -1, 0, total, 0.0
    return int(spec.reads[f]), int(sum(1 << int(c) for c in spec.order[f, : j + 1])), float(left[f, j]), float(right[f, j])


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, node: int, depth: int, leaf: int, spec: Spec) -> list[tuple]:
    """(node, column, mask, value, n) of the subtree over these rows."""
    out, todo = [], [(node, np.arange(len(y)))]
    while todo:
        at, rows = todo.pop()
        n = w[rows].sum()
        value = float((w[rows] * y[rows]).sum() / n)
        column, mask = -1, 0
        if at.bit_length() <= depth and n >= 2 * leaf:
            column, mask, _, _ = best(sums(codes[rows], y[rows], w[rows], spec), leaf, spec)
        out.append((at, column, mask, value, float(n)))
        if column >= 0:
            go = (mask >> codes[rows, column].astype(np.int64)) & 1 == 1
            todo += [(2 * at, rows[go]), (2 * at + 1, rows[~go])]
    return out


def _down(codes: np.ndarray, trees: int, splits: dict) -> np.ndarray:
    """The node of each row in each tree, as far as ``splits`` (tree -> [(node, column, mask)] by node) goes."""
    now = np.ones((len(codes), trees), np.int64)
    for tree, known in splits.items():
        for node, column, mask in known:
            at = now[:, tree] == node
            now[at, tree] = 2 * node + 1 - ((mask >> codes[at, column].astype(np.int64)) & 1)
    return now


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    group = np.array(batch.column("group").to_pylist(), object)
    raw = batch.column("codes").to_pylist()
    codes = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1) if raw else np.empty((0, 1), np.uint8)
    return group, codes, batch.column("y").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)


def fit(rows: DataFrame, spec: Spec, trees: int = 100, depth: int = 20, leaf: int = 3, local: int = 20_000, sample: bool = True) -> DataFrame:
    """The forest of each group, as NODES. ``rows``: group, id (long), codes (binary, a byte a column), y; none of them null. Without
    ``sample`` each row counts once in each tree."""
    drawn = draws if sample else once
    spark = rows.sparkSession
    rows = rows.select("group", "id", "codes", F.col("y").cast("double").alias("y"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > local).collect()  # groups that need passes
    known: dict = {r["group"]: {t: [] for t in range(trees)} for r in sizes}
    front = {(r["group"], t, 1) for r in sizes for t in range(trees)} if depth > 0 else set()
    done: list[tuple] = []
    while front:
        found = _level(rows, spec, trees, leaf, known, front, drawn)
        front = set()
        for group, tree, node, column, mask, value, left, right in found:
            done.append((group, tree, node, column, mask, value, left + right))
            if column < 0:
                continue
            known[group][tree].append((node, column, mask))
            front |= {(group, tree, child) for child, n in ((2 * node, left), (2 * node + 1, right)) if n > local and child.bit_length() <= depth}
    state = spark.sparkContext.broadcast((known, {(g, t, n) for g, t, n, column, *_ in done if column < 0}))

    def deal(batches):
        known, leaves = state.value
        for batch in batches:
            group, codes, y, ids = _arrays(batch)
            for g in set(group.tolist()):
                own = np.flatnonzero(group == g)
                w = drawn(ids[own], trees)
                now = _down(codes[own], trees, known.get(g, {}))
                r, t = np.nonzero(w)
                node = now[r, t]
                if g in known:
                    keep = np.array([(g, a, b) not in leaves for a, b in zip(t.tolist(), node.tolist())], bool)
                    r, t, node = r[keep], t[keep], node[keep]
                raw = batch.column("codes").take(pa.array(own[r]))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(r), pa.string()), pa.array(t, pa.int32()), pa.array(node, pa.int64()), raw.cast(pa.binary()), pa.array(y[own[r]], pa.float64()), pa.array(w[r, t], pa.float64())], names=["group", "tree", "node", "codes", "y", "w"])

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), -1)
        order = np.lexsort((*codes.T, part["y"].to_numpy()))  # sums don't depend on how rows came
        grown = grow(codes[order], part["y"].to_numpy()[order], part["w"].to_numpy()[order], int(key[2]), depth, leaf, spec)
        return pd.DataFrame([(key[0], key[1], *row) for row in grown], columns=[c.split()[0] for c in NODES.split(", ")])

    dealt = rows.mapInArrow(deal, "group string, tree int, node long, codes binary, y double, w double")
    small = dealt.groupBy("group", "tree", "node").applyInPandas(finish, NODES)
    return small.unionByName(spark.createDataFrame(done, NODES)) if done else small


def _level(rows: DataFrame, spec: Spec, trees: int, leaf: int, known: dict, front: set, drawn) -> list[tuple]:
    """One pass: group, tree, node, column, mask, value, rows left, rows right of each node of the front."""
    nodes: dict = {}
    for g, t, n in front:
        nodes.setdefault(g, []).append((t, n))
    state = rows.sparkSession.sparkContext.broadcast((known, nodes))

    def add(batches):
        known, nodes = state.value
        have: dict = {}
        for batch in batches:
            group, codes, y, ids = _arrays(batch)
            for g in set(group.tolist()) & set(nodes):
                own = np.flatnonzero(group == g)
                w, now = drawn(ids[own], trees), _down(codes[own], trees, known[g])
                for t, n in nodes[g]:
                    use = (now[:, t] == n) & (w[:, t] > 0)
                    if use.any():
                        cells = sums(codes[own][use], y[own][use], w[use, t].astype(float), spec)
                        have[g, t, n] = have.get((g, t, n), 0) + cells
        keys = list(have)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([have[k].ravel().tolist() for k in keys], pa.list_(pa.float64()))], names=["group", "tree", "node", "v"])

    def split(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(2 * spec.columns * spec.codes)
        cells[part["i"].to_numpy()] = part["v"].to_numpy()
        cells = cells.reshape(2, spec.columns, spec.codes)
        column, mask, left, right = best(cells, leaf, spec)
        n, s = cells[:, 0].sum(axis=1)
        return pd.DataFrame([(*key, column, mask, s / n, left, right)], columns=["group", "tree", "node", "column", "mask", "value", "n_left", "n_right"])

    parts = rows.where(F.col("group").isin(*nodes)).mapInArrow(add, "group string, tree int, node long, v array<double>").select("group", "tree", "node", F.posexplode("v").alias("i", "v"))
    whole = parts.groupBy("group", "tree", "node", "i").agg(F.sum("v").alias("v")).groupBy("group", "tree", "node")
    return [tuple(r) for r in whole.applyInPandas(split, "group string, tree int, node long, column int, mask long, value double, n_left double, n_right double").collect()]  # a row a large node


def boost(rows: DataFrame, spec: Spec, rounds: int = 100, depth: int = 8, leaf: int = 1, rate: float = 0.1, local: int = 20_000) -> DataFrame:
    """Boosted trees of each group, as NODES for ``predict``: tree 0 is the mean, each further one fits what those before leave over. Groups of up to
    ``local`` rows are boosted in a task each; for larger ones every round is a ``fit`` of one tree and a table of what is left over."""
    rows = rows.select("group", "id", "codes", F.col("y").cast("double").alias("y"))
    large = [r["group"] for r in rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > local).collect()]
    times = rounds + 1  # predictions are means over the trees

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), -1)
        y = part["y"].to_numpy()
        order = np.lexsort((*codes.T, y))
        codes, y = codes[order], y[order]
        now, w = np.full(len(y), y.mean()), np.ones(len(y))
        out = [(key[0], 0, 1, -1, 0, float(y.mean()) * times, float(len(y)))]
        for t in range(1, times):
            grown = grow(codes, y - now, w, 1, depth, leaf, spec)
            nodes, at = {g[0]: g for g in grown}, np.ones(len(y), np.int64)
            for node in sorted(nodes):
                if nodes[node][1] >= 0:
                    mine = at == node
                    at[mine] = 2 * node + 1 - ((nodes[node][2] >> codes[mine, nodes[node][1]].astype(np.int64)) & 1)
            now = now + rate * np.array([nodes[n][3] for n in at.tolist()])
            out += [(key[0], t, node, column, mask, value * rate * times, n) for node, column, mask, value, n in grown]
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    small = rows.where(~F.col("group").isin(*large)) if large else rows
    out = small.groupBy("group").applyInPandas(whole, NODES)
    if large:
        mine = rows.where(F.col("group").isin(*large))
        mean = settled(mine.groupBy("group").agg(F.avg("y").alias("m"), F.count("*").cast("double").alias("n")))
        out = out.unionByName(mean.select("group", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(-1).alias("column"), F.lit(0).cast("long").alias("mask"), (F.col("m") * times).alias("value"), "n"))
        left = settled(mine.join(F.broadcast(mean.select("group", "m")), "group").select("group", "id", "codes", (F.col("y") - F.col("m")).alias("y")))  # a row a large group
        for t in range(1, times):
            tree = settled(fit(left, spec, 1, depth, leaf, local, sample=False))
            left = settled(predict(left, tree).select("group", "id", "codes", (F.col("y") - rate * F.col("predicted")).alias("y")))
            out = out.unionByName(tree.select("group", F.lit(t).alias("tree"), "node", "column", "mask", (F.col("value") * rate * times).alias("value"), "n"))
    return out


def walker(nodes: pd.DataFrame, codes: int):
    """A function that gives the mean over one group's trees (a table of NODES) for rows of codes below ``codes``, given as one array a column."""
    nodes = nodes.sort_values(["tree", "node"])
    tree, node = nodes["tree"].to_numpy(np.int64), nodes["node"].to_numpy(np.int64)
    key, inner = tree * TOP + node, nodes["column"].to_numpy(np.int64) >= 0
    size, levels = int(tree.max()) + 1, int(node.max()).bit_length() - 1
    roots = np.searchsorted(key, np.arange(size) * TOP + 1).astype(np.int32)
    column = np.where(inner, nodes["column"], 0).astype(np.int32)
    low = (nodes["mask"].to_numpy(np.int64)[:, None] >> np.arange(codes)) & 1
    child = np.where(inner[:, None], (tree * TOP + 2 * node)[:, None] + 1 - low, key[:, None])
    after = np.searchsorted(key, child).astype(np.int32).ravel()  # the next node by node and code; a leaf stays
    share = nodes["value"].to_numpy(float) / size

    def mean(columns: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.zeros(columns.shape[1])
        for first in range(0, len(out), block):
            part = np.ascontiguousarray(columns[:, first : first + block])
            n = part.shape[1]
            flat, start, place = part.ravel(), column * np.int32(n), np.arange(n, dtype=np.int32)
            at = np.repeat(roots[:, None], n, axis=1)
            for _ in range(levels):
                at = after[at * np.int32(codes) + flat[start[at] + place]]
            for t in range(size):
                out[first : first + n] += share[at[t]]
        return out

    return mean


def predict(rows: DataFrame, forest: DataFrame, most: int = 5_000_000) -> DataFrame:
    """``rows`` with ``predicted``, the mean over the trees of the row's group; rows of groups without a forest go. The forests are sent to all tasks, of as many
    groups at a time as have ``most`` nodes together; each lot is a pass over the rows of its groups."""
    spark = rows.sparkSession
    sizes = sorted((r["group"], r["n"]) for r in forest.groupBy("group").agg(F.count("*").alias("n")).collect())
    lots, now = [], 0
    for g, n in sizes:
        if not lots or now + n > most:
            lots.append([])
            now = 0
        lots[-1].append(g)
        now += n
    out = None
    for lot in lots:
        table = forest.where(F.col("group").isin(*lot)).toPandas()  # at most ``most`` nodes, or one group's
        trees = {}
        for g, part in table.groupby("group"):
            key = (part["tree"].to_numpy(np.int64) * TOP + part["node"].to_numpy(np.int64))
            order = np.argsort(key)
            trees[g] = (int(part["tree"].max()) + 1, key[order], *(part[c].to_numpy()[order] for c in ("column", "mask", "value")))
        part = _predicted(rows.where(F.col("group").isin(*lot)), spark.sparkContext.broadcast(trees))
        out = part if out is None else out.unionByName(part)
    return rows.withColumn("predicted", F.lit(0.0)).where(F.lit(False)) if out is None else out


def _predicted(rows: DataFrame, shared) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches):
        for batch in batches:
            group = np.array(batch.column("group").to_pylist(), object)
            raw = batch.column("codes").to_pylist()
            out = np.zeros(len(raw))
            codes = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1) if raw else None
            for g in set(group.tolist()):
                own = np.flatnonzero(group == g)
                size, key, column, mask, value = shared.value[g]
                for t in range(size):
                    at = np.searchsorted(key, np.full(own.size, t * TOP + 1))
                    while True:
                        inner = np.flatnonzero(column[at] >= 0)
                        if not inner.size:
                            break
                        k = at[inner]
                        right = 1 - ((mask[k] >> codes[own[inner], column[k]].astype(np.int64)) & 1)
                        at[inner] = np.searchsorted(key, t * TOP + 2 * (key[k] - t * TOP) + right)
                    out[own] += value[at] / size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "predicted"])

    return rows.mapInArrow(run, f"{schema}, predicted double")
