"""Leave-one-group-out forests of classification trees, all folds in shared passes.

A fold is a group that is held out. The same tree of two folds differs only by two groups' rows, and most of its splits are
the same; so a node belongs to the path of splits that leads to it, and folds that split alike share it. A level of the trees is two passes. One counts the rows of
every open node by column, bin and class, over all groups, once for all folds. The other runs over the folds, a row each with the group's residues (some 24 bytes a residue): it takes
their own rows off the counts and chooses. Counts are whole numbers, so a fold's forest is that of a fit without the group, whatever the partitioning and after a lost task.

Values are cut into bins at given or approximate quantiles of all rows (labels have no part in them). Rows count once to several
times in a tree, as a Poisson draw from their id and the tree says. Classes are balanced within the fold, impurity is Gini's. A split looks at ``tries`` columns, drawn by tree and
place; if none of these can part the node, at one more, and so on.

What each fold has split stays with the fold. The driver holds the different splits of ``lot`` trees and the counts of one level's open nodes; each lot is ``depth`` levels and a pass that scores.
"""

from __future__ import annotations

import pickle
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assays import auc
from .grove import draws
from .settle import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

def column_order(tree: int, place: int, columns: int) -> np.ndarray:
    """The order in which a split looks at columns; ``place`` is the node's number in a full tree (root 1)."""
    return np.random.default_rng([tree, place]).permutation(columns)


def choose(cells: np.ndarray, weight: np.ndarray, order: np.ndarray, tries: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fold, the column (-1: none) and the bin up to which rows go low, of the split that lowers Gini's impurity most. ``cells``: rows
    by fold, column, bin and class; ``weight``: of the classes, by fold."""
    low = np.cumsum(cells, axis=2)
    whole = low[:, :, -1:]
    low = low[:, :, :-1]
    high = whole - low
    ok = (low.sum(axis=3) >= leaf) & (high.sum(axis=3) >= leaf)
    by = weight[:, None, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = [((v * by) ** 2).sum(axis=3) / (v * by).sum(axis=3) for v in (low, high, whole)]
        gain = np.where(ok, purity[0] + purity[1] - purity[2], 0.0)[:, order]
    least = 1e-9 * (whole[:, 0, 0] * weight).sum(axis=1)
    column, cut = np.full(len(cells), -1), np.zeros(len(cells), int)
    for k in range(min(tries, len(order)), len(order) + 1):
        part = gain[:, :k].reshape(len(cells), -1)
        top = part.max(axis=1, initial=0.0)
        at = (part >= (top - least)[:, None]).argmax(axis=1)  # the first of those that differ by rounding only
        new = (column < 0) & (top > least)
        column[new], cut[new] = order[at[new] // gain.shape[2]], at[new] % gain.shape[2]
    return column, cut


def _rows(batch, cuts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups, ids, classes and bins (rows x columns) of a batch."""
    group = np.array(batch.column(0).to_pylist(), object)
    ids, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
    bins = np.stack([np.searchsorted(c, batch.column(3 + k).to_numpy(zero_copy_only=False)) for k, c in enumerate(cuts)], axis=1) if len(ids) else np.empty((0, len(cuts)), int)
    return group, ids, y.astype(int), bins


def quantile_cuts(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, F.array(*map(F.lit, at)), 10_000).alias(c) for c in columns]).first()
    return [np.unique(np.array(found[c] or [0.0], float)) for c in columns]


def scores(rows: DataFrame, group: str, id: str, label: str, columns: list[str], trees: int = 200, depth: int = 6, leaf: int = 20, tries: int | None = None, bins: int = 64, cuts: list | None = None, block: int = 4096, lot: int = 50) -> DataFrame:
    """group_ (text), id_, y_, p_: each row of a group with both classes, and its mean probability over the trees of the fold that holds its group out. ``id`` is a long;
    nulls among the columns count as 0, and labels other than 1 as class 0. A group without rows of both classes inside and outside is no fold; a null group is never held out."""
    tries = tries or max(1, int(len(columns) ** 0.5))
    ready = rows.select(F.col(group).cast("string").alias("group_"), F.col(id).alias("id_"), F.coalesce(F.col(label) == 1, F.lit(False)).cast("int").alias("y_"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(columns)])
    cuts = cuts or quantile_cuts(ready, [f"x_{i}" for i in range(len(columns))], bins)
    sizes = ready.groupBy("group_").agg(F.count("*").alias("n"), F.sum("y_").alias("pos")).collect()  # a row a group
    n, pos = sum(r["n"] for r in sizes), sum(r["pos"] for r in sizes)
    held = sorted((r["group_"], n - r["n"], pos - r["pos"]) for r in sizes if r["group_"] is not None and 0 < r["pos"] < r["n"] and 0 < pos - r["pos"] < n - r["n"])
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ready = settled(ready.repartition(max(cores, ready.rdd.getNumPartitions())))  # small tables come in one part, and a row costs all its trees
    out = None
    for i in range(0, len(held), block):
        folds = {g: (m / (2 * (m - ones)), m / (2 * ones)) for g, m, ones in held[i : i + block]}
        now = settled(_packed(ready.where(F.col("group_").isin(*folds)) if len(held) > block else ready, folds, cuts).repartition(2 * cores))
        for first in range(0, trees, lot):
            now = _grown(ready, now, folds, cuts, range(first, min(trees, first + lot)), depth, leaf, tries)
        done = _unpacked(now, trees)
        out = done if out is None else out.unionByName(done)
    return out if out is not None else ready.select("group_", "id_", "y_", F.lit(0.0).alias("p_")).where(F.lit(False))


FOLD = "group_ string, ids binary, y binary, bins binary, p binary, state binary"
MADE = "array<struct<tree:int,node:int,column:int,cut:int,low:boolean,high:boolean>>"


def _packed(rows: DataFrame, folds: dict, cuts: list) -> DataFrame:
    """A row a fold: its residues' ids, classes, bins and sums of probabilities as bytes, some 24 each."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if key[0] not in folds:
            return pd.DataFrame([], columns=[c.split()[0] for c in FOLD.split(", ")])
        part = part.sort_values("id_")
        bins = np.stack([np.searchsorted(c, part[f"x_{k}"].to_numpy()) for k, c in enumerate(cuts)]).astype(np.uint16)
        return pd.DataFrame([(key[0], part["id_"].to_numpy(np.int64).tobytes(), part["y_"].to_numpy(np.uint8).tobytes(), bins.tobytes(), np.zeros(len(part)).tobytes(), b"")], columns=[c.split()[0] for c in FOLD.split(", ")])

    return rows.where("group_ is not null").groupBy("group_").applyInPandas(pack, FOLD)


def _unpacked(packed: DataFrame, trees: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for g, ids, y, p in zip(*(batch.column(c).to_pylist() for c in ("group_", "ids", "y", "p")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(ids), pa.string()), pa.array(ids), pa.array(np.frombuffer(y, np.uint8).astype(np.int32)), pa.array(np.frombuffer(p) / trees)], names=["group_", "id_", "y_", "p_"])

    return packed.mapInArrow(run, "group_ string, id_ long, y_ int, p_ double")


def _grown(rows: DataFrame, packed: DataFrame, folds: dict, cuts: list, which: range, depth: int, leaf: int, tries: int) -> DataFrame:
    """``packed`` with the probabilities of these trees added. The driver gets the different splits and the counts of their nodes, whatever the number of folds."""
    splits: dict = {t: {} for t in which}
    following = dict.fromkeys(which, 2)
    front = {t: [1] for t in which}
    for level in range(depth):
        totals = _totals(rows, cuts, splits, front)
        made = settled(_decided(packed, totals, splits, folds, cuts, which, level, depth, leaf, tries))
        packed = made.drop("made")
        ways = made.select(F.inline("made")).groupBy("tree", "node", "column", "cut").agg(F.bool_or("low").alias("low"), F.bool_or("high").alias("high")).collect()
        front = {t: [] for t in which}
        for t, node, column, cut, low, high in sorted(map(tuple, ways)):
            children = (following[t], following[t] + 1)
            following[t] += 2
            splits[t].setdefault(node, {})[column, cut] = children
            front[t] += [child for child, open_ in zip(children, (low, high), strict=True) if open_]
        if not any(front.values()):
            break
    return settled(_scored(packed, len(cuts), depth))


def _totals(rows: DataFrame, cuts: list, splits: dict, front: dict) -> dict:
    """For each tree the open nodes, in order, and all rows of each by column, bin and class."""
    wide = max(len(c) for c in cuts) + 1
    cells = len(cuts) * wide * 2
    state = rows.sparkSession.sparkContext.broadcast((splits, {t: set(v) for t, v in front.items()}))

    def count(batches):
        splits, front = state.value
        have: dict = {}
        for batch in batches:
            _, ids, y, bins = _rows(batch, cuts)
            if not len(ids):
                continue
            drawn = draws(ids, max(splits) + 1)
            cell = (np.arange(len(cuts)) * wide + bins) * 2 + y[:, None]
            for t, ways in splits.items():
                todo = [(1, np.flatnonzero(drawn[:, t]))]
                while todo:
                    node, r = todo.pop()
                    if not r.size:
                        continue
                    if node in front[t]:
                        own = np.bincount(cell[r].ravel(), np.repeat(drawn[r, t], len(cuts)), cells).astype(np.int64)
                        have[t, node] = have.get((t, node), 0) + own
                    for (column, cut), children in ways.get(node, {}).items():
                        below = bins[r, column] <= cut
                        todo += [(children[0], r[below]), (children[1], r[~below])]
        yield from _counted(have)

    def add(batches):
        have: dict = {}
        for batch in batches:
            for t, node, at, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (t, node) not in have:
                    have[t, node] = np.zeros(cells, np.int64)
                have[t, node][np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        yield from _counted(have)

    schema = "tree int, node int, at binary, n binary"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out: dict = {}
    for t, node, at, n in sorted(tuple(r) for r in rows.mapInArrow(count, schema).repartition(parts, "tree", "node").mapInArrow(add, schema).collect()):  # a row an open node
        nodes, dense = out.setdefault(t, ([], []))
        nodes.append(node), dense.append(np.zeros(cells, np.int32 if sum(np.frombuffer(n, np.int64)) < 2**31 else np.int64))
        dense[-1][np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int64)
    return {t: (np.array(nodes), np.array(dense)) for t, (nodes, dense) in out.items()}


def _counted(have: dict):
    at = {k: np.flatnonzero(v).astype(np.int32) for k, v in have.items()}
    keys = list(have)
    for i in range(0, len(keys), 1000):
        some = keys[i : i + 1000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.int32()), pa.array([k[1] for k in some], pa.int32()), pa.array([at[k].tobytes() for k in some], pa.binary()), pa.array([have[k][at[k]].tobytes() for k in some], pa.binary())], names=["tree", "node", "at", "n"])


class _State:
    """A fold's trees by place in a full tree (root 1): shared node (0: none or closed), column (-1: a leaf), cut and probability."""

    def __init__(self, raw: bytes, trees: int, depth: int):
        shape = (trees, 2 << depth)
        if raw:
            self.node, self.column, self.cut, self.value = pickle.loads(zlib.decompress(raw))
        else:
            self.node, self.column, self.cut, self.value = np.zeros(shape, np.int32), np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.full(shape, 0.5)
            self.node[:, 1] = 1

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Trees x rows: where each row of bins (columns x rows) is after so many levels; what ends before stays."""
        at = np.ones((len(self.node), bins.shape[1]), np.int64)
        tree, row = np.arange(len(self.node))[:, None], np.arange(bins.shape[1])
        for _ in range(levels):
            c = self.column[tree, at]
            at = np.where(c >= 0, 2 * at + (bins[np.maximum(c, 0), row] > self.cut[tree, at]), at)
        return at

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps((self.node, self.column, self.cut, self.value)), 1)


def _decided(packed: DataFrame, totals: dict, splits: dict, folds: dict, cuts: list, which: range, level: int, depth: int, leaf: int, tries: int) -> DataFrame:
    """``packed`` with the splits of one more level of each fold, and ``made``, which those are and whether their children are open."""
    k_, wide = len(cuts), max(len(c) for c in cuts) + 1
    cells = k_ * wide * 2
    state = packed.sparkSession.sparkContext.broadcast((totals, splits, folds))
    first = 1 << level

    def run(batches):
        totals, splits, folds = state.value
        orders = {(t, p): column_order(t, p, k_) for t in which for p in range(first, 2 * first)}
        for batch in batches:
            for row in batch.to_pylist():
                y, ids = np.frombuffer(row["y"], np.uint8), np.frombuffer(row["ids"], np.int64)
                bins = np.frombuffer(row["bins"], np.uint16).reshape(k_, -1).astype(np.int64)
                have, made = _State(row["state"] if level else b"", len(which), depth), []
                drawn = draws(ids, which[-1] + 1)[:, which[0] :].T  # trees x rows
                place = have.places(bins, level)
                weight = np.array([folds[row["group_"]]])
                cell = (np.arange(k_)[:, None] * wide + bins) * 2 + y
                for i, t in enumerate(which):
                    open_ = np.flatnonzero(have.node[i, first : 2 * first]) + first
                    if t not in totals or not open_.size:
                        continue
                    nodes, dense = totals[t]
                    at = np.minimum(np.searchsorted(nodes, have.node[i, open_]), len(nodes) - 1)
                    known = nodes[at] == have.node[i, open_]
                    open_, at = open_[known], at[known]
                    slot = np.full(2 * first, -1)
                    slot[open_] = np.arange(len(open_))
                    mine = np.where(place[i] >= first, slot[np.minimum(place[i], 2 * first - 1)], -1)
                    r = np.flatnonzero((mine >= 0) & (drawn[i] > 0))
                    own = np.bincount((mine[r] * cells + cell[:, r]).ravel(), np.tile(drawn[i, r], k_), len(open_) * cells).astype(np.int64)
                    left = (dense[at] - own.reshape(-1, cells)).reshape(-1, k_, wide, 2)
                    column, cut = _chosen(left, weight, np.array([orders[t, p] for p in open_]).reshape(-1, k_), tries, leaf)
                    each = np.arange(len(open_))
                    below = left[each, np.maximum(column, 0)]
                    whole, below = below.sum(axis=1), np.where((np.arange(wide) <= cut[:, None])[:, :, None], below, 0).sum(axis=1)
                    share = [v[:, 1] * weight[0, 1] / np.maximum(1e-300, (v * weight).sum(axis=1)) for v in (whole, below, whole - below)]
                    if level == 0 and len(open_):
                        have.value[i, 1] = share[0][0]
                    goes = np.flatnonzero(column >= 0)
                    have.column[i, open_[goes]], have.cut[i, open_[goes]] = column[goes], cut[goes]
                    opens = []
                    for side, p, n in ((0, share[1], below), (1, share[2], whole - below)):
                        have.value[i, 2 * open_[goes] + side] = p[goes]
                        opens.append((n.sum(axis=1) >= 2 * leaf) & (p > 0) & (p < 1))  # pure nodes are done
                    made += [{"tree": t, "node": int(nodes[at[j]]), "column": int(column[j]), "cut": int(cut[j]), "low": bool(opens[0][j]), "high": bool(opens[1][j])} for j in goes]
                    for side in (0, 1):  # whose numbers are known when all folds have chosen
                        have.node[i, 2 * open_[goes] + side] = np.where(opens[side][goes], -1, 0)
                yield pa.RecordBatch.from_pylist([row | {"state": have.packed(), "made": made}], schema=arrow)

    def numbered(batches):
        """Children get the numbers that the driver gave to the splits."""
        _, splits, _ = state.value
        for batch in batches:
            for row in batch.to_pylist():
                have = _State(row["state"], len(which), depth)
                for i, p in np.argwhere(have.node == -1).tolist():
                    up = p // 2
                    have.node[i, p] = splits[which[i]][int(have.node[i, up])][int(have.column[i, up]), int(have.cut[i, up])][p % 2]
                yield pa.RecordBatch.from_pylist([row | {"state": have.packed()}], schema=plain)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, plain = (to_arrow_schema(StructType.fromDDL(d)) for d in (f"{FOLD}, made {MADE}", FOLD))
    ready = packed.mapInArrow(numbered, FOLD) if level else packed
    return ready.mapInArrow(run, f"{FOLD}, made {MADE}")


def _chosen(cells: np.ndarray, weight: np.ndarray, orders: np.ndarray, tries: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """``choose`` for nodes that look at their columns in orders of their own; the columns beyond ``tries`` are looked at where needed only."""
    column, cut = np.full(len(cells), -1), np.zeros(len(cells), int)
    todo = np.arange(len(cells))
    for most in sorted({min(tries, orders.shape[1]), orders.shape[1]}):
        if not todo.size:
            break
        own = orders[todo, :most]
        c, at = choose(cells[todo[:, None], own], np.repeat(weight, len(todo), axis=0), np.arange(most), tries, leaf)
        column[todo], cut[todo] = np.where(c >= 0, own[np.arange(len(todo)), np.maximum(c, 0)], -1), at
        todo = todo[c < 0]
    return column, cut


def _scored(packed: DataFrame, columns: int, depth: int) -> DataFrame:
    """``packed`` with the probabilities of its trees added to the rows' sums."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    plain = to_arrow_schema(StructType.fromDDL(FOLD))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                have, bins = _State(row["state"], 0, depth), np.frombuffer(row["bins"], np.uint16).reshape(columns, -1)
                at, p = have.places(bins, depth), np.frombuffer(row["p"]).copy()
                for i in range(len(at)):
                    p += have.value[i, at[i]]
                yield pa.RecordBatch.from_pylist([row | {"p": p.tobytes(), "state": b""}], schema=plain)

    return packed.mapInArrow(run, FOLD)


def left_out(rows: DataFrame, group: str, id: str, label: str, columns: list[str], **how) -> DataFrame:
    """group, auc: each group with both classes scored by the forest that has not seen it."""
    done = scores(rows, group, id, label, columns, **how)
    return auc(done.select("group_", F.round("p_", 12).alias("p_"), (F.col("y_") == 1).alias("t_")), "group_", "p_", "t_").select(F.col("group_").alias(group), "auc")
