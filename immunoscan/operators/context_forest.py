"""A forest of classification trees on the context vectors of residues, grown level by level in passes over the sequences.

A context vector has 89 numbers, a hundred times its letter; so it is never a row. Tasks work out the vectors of some thousand residues at a
time, as bins, from the letters, add up the classes of every open node by column and bin, and leave one array a node. Sums of these
arrays give the splits, a row a node. A pass costs the same whatever the lengths of the sequences.

Numbers of the residue itself, shares of letters and places have fixed bins; means of scales are cut at quantiles of all taught residues, from their counts on a grid. Rows count once to
several times in a tree, as a Poisson draw from sequence, place and tree says: the same for every partitioning, and after a lost task. Classes weigh the same;
a node looks at as many columns as the root of their number, drawn by tree and node; impurity is Gini's.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import codes_of, spans_of
from .fold_forest import choose, column_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BINS, GRID, BLOCK, LOT = 32, 4096, 1 << 14, 1 << 20
POISSON = np.searchsorted(np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(8)]), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


@dataclass
class Space:
    """Bins of context vectors: ``scales`` (values by code, 0 first, a row a scale), how far a context reaches, and the cuts on the grid of each
    side's means (sides x scales x GRID: bin of a grid cell; None before they are known)."""

    scales: np.ndarray
    reach: int = 4
    grid: np.ndarray | None = None

    def __post_init__(self):
        self.letters = self.scales.shape[1] - 1
        self.width = len(self.scales) + self.letters
        self.columns = 3 * self.width + 2
        own = [np.searchsorted(np.unique(v[1:]), v) for v in self.scales]
        self.own = np.array([*own, *np.eye(self.letters + 1, dtype=int)[1:]]).astype(np.uint8)  # bin by column and code
        values = sorted({k / s for s in range(1, self.reach + 1) for k in range(s + 1)})
        self.share = np.array([[values.index(k / max(1, s)) if k <= s else 0 for k in range(self.reach + 1)] for s in range(self.reach + 1)], np.uint8)  # bin by size and number
        self.low, high = self.scales[:, 1:].min(axis=1), self.scales[:, 1:].max(axis=1)
        self.low = np.minimum(self.low, 0.0)  # 0 where there is no neighbour
        self.step = GRID / (np.maximum(high, 0.0) - self.low + 1e-9)

    def means(self, codes: np.ndarray, sizes: list[np.ndarray], first: int, m: int):
        """Side, scale and grid cell of the means of m residues from ``first`` (of codes with gaps of zeros between sequences)."""
        for side in (0, 1):
            at = first - self.reach if side == 0 else first + 1
            for k, scale in enumerate(self.scales):
                v = scale[codes[at : at + m + self.reach - 1]]
                total = v[:m].copy()
                for o in range(1, self.reach):
                    total += v[o : o + m]
                total /= sizes[side]
                total -= self.low[k]
                total *= self.step[k]
                yield side, k, np.clip(total, 0, GRID - 1).astype(np.int32)  # beyond it are gaps only

    def bins(self, codes: np.ndarray, before: np.ndarray, after: np.ndarray, first: int, m: int) -> np.ndarray:
        """Bins by column and residue."""
        out = np.empty((self.columns, m), np.uint8)
        out[: self.width] = self.own[:, codes[first : first + m]]
        sizes = [np.minimum(before, self.reach), np.minimum(after, self.reach)]
        for side, k, cell in self.means(codes, [np.maximum(1, s) for s in sizes], first, m):
            out[(1 + side) * self.width + k] = self.grid[side, k][cell]
        for side, size in enumerate(sizes):
            at = first - self.reach if side == 0 else first + 1
            part, row = codes[at : at + m + self.reach - 1], (size * (self.reach + 1)).astype(np.uint8)
            for a in range(self.letters):
                is_ = (part == a + 1).view(np.uint8)
                n = row + is_[:m]
                for o in range(1, self.reach):
                    n += is_[o : o + m]
                out[(1 + side) * self.width + len(self.scales) + a] = self.share.ravel()[n]
        last = before + after  # the sequence's length less one
        out[-2] = np.minimum(before / np.maximum(1, last) * BINS, BINS - 1)
        out[-1] = np.minimum(np.minimum(before, after) / np.maximum(1.0, last / 2) * BINS, BINS - 1)
        return out


def _lots(batches):
    """The same rows in batches of some LOT letters, one sequence at least."""
    for batch in batches:
        ends = np.cumsum([0, *(len(s.as_py()) for s in batch.column("seq"))])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + LOT, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _blocks(batch, reach: int):
    """For each block of residues of a batch (seq, spots, hash): codes with gaps, letters before and after each residue, where the block
    begins, labels, ids."""
    parts, lengths, labels = [np.zeros(reach, np.uint8)], [], []
    for seq, spots in zip(batch.column("seq"), batch.column("spots"), strict=True):
        codes = codes_of(seq.as_py())
        y = np.zeros(len(codes) + reach, np.uint8)
        y[np.asarray(spots.as_py() or [], np.int64) - 1] = 1
        parts += [codes.astype(np.uint8), np.zeros(reach, np.uint8)]
        lengths.append(len(codes)), labels.append(y)
    if not lengths:
        return
    parts.append(np.zeros(reach, np.uint8))
    codes, y, lengths = np.concatenate(parts), np.concatenate(labels), np.array(lengths)
    hashes = batch.column("hash").to_numpy(zero_copy_only=False).astype(np.uint64)
    ends = np.cumsum(lengths + reach)
    for first in range(0, len(y), BLOCK):
        at = np.arange(first, min(len(y), first + BLOCK))
        which = np.searchsorted(ends, at, side="right")
        before = at - (ends - lengths - reach)[which]
        after = lengths[which] - 1 - before
        yield codes, before, after, first + reach, y[at], which, hashes[which]


def _draws(hashes: np.ndarray, before: np.ndarray, trees: int) -> np.ndarray:
    """How often each residue counts, by tree."""
    with np.errstate(over="ignore"):
        x = (hashes + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] + np.arange(1, (trees + 3) // 4 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return POISSON[x.view(np.uint16)[:, :trees].T]


def _nodes(bins: np.ndarray, column: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node (root 1, children 2i and 2i + 1) of each residue in one tree; ``column`` by node, -1 where a tree ends."""
    m = bins.shape[1]
    at, place, flat = np.ones(m, np.int32), np.arange(m, dtype=np.int32), bins.ravel()
    for _ in range(depth):
        c = column[at]
        go = 2 * at + (flat[np.maximum(c, 0) * np.int32(m) + place] > cut[at])
        at = np.where(c >= 0, go, at).astype(np.int32)
    return at


def _summed(rows: DataFrame, run, key: str) -> DataFrame:
    """What tasks yield as (key, v: an array), summed by key and place."""
    parts = rows.select("seq", "spots", "hash").mapInArrow(run, f"{key} int, v array<double>").select(key, F.posexplode("v").alias("i", "v"))
    return parts.groupBy(key, "i").agg(F.sum("v").alias("v"))


def _arrays(have: dict, key: str):
    return pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.ravel().tolist() for v in have.values()], pa.list_(pa.float64()))], names=[key, "v"])


def _gridded(rows: DataFrame, space: Space) -> np.ndarray:
    """The bin of each grid cell: quantiles of the means of all residues. To the driver come the filled cells, GRID a mean at most."""

    def run(batches):
        have: dict = {}
        for batch in _lots(batches):
            for codes, before, after, first, *_ in _blocks(batch, space.reach):
                real = after >= 0
                sizes = [np.maximum(1, np.minimum(s, space.reach)) for s in (before, np.maximum(0, after))]
                for side, k, cell in space.means(codes, sizes, first, len(before)):
                    key = side * len(space.scales) + k
                    have[key] = have.get(key, 0) + np.bincount(cell[real], minlength=GRID)
        yield _arrays(have, "mean")

    counts = np.zeros((2 * len(space.scales), GRID))
    for r in _summed(rows, run, "mean").where("v > 0").collect():
        counts[r["mean"], r["i"]] = r["v"]
    up_to = np.cumsum(counts, axis=1) - counts  # residues in lower cells
    bins = np.minimum(BINS - 1, up_to * BINS // np.maximum(1, counts.sum(axis=1, keepdims=True)))
    return bins.astype(np.uint8).reshape(2, len(space.scales), GRID)


def fit(rows: DataFrame, space: Space, trees: int, depth: int, leaf: int = 5) -> dict:
    """Columns, cuts (bins up to which residues go low), probabilities and gains by tree and node. ``rows``: seq, spots (places from 1 of class 1), hash (a long of its own for each)."""
    space.grid = _gridded(rows, space)
    n = rows.agg(F.sum(F.length("seq")).alias("n"), F.sum(F.size("spots")).alias("ones")).first()
    total, ones = n["n"] or 0, n["ones"] or 0
    weight = np.array([[total / (2 * max(1, total - ones)), total / (2 * max(1, ones))]])
    tries = int(np.ceil(np.sqrt(space.columns)))
    size = 2 << depth
    column, cut = np.full((trees, size), -1, np.int32), np.zeros((trees, size), np.int32)
    value, gain = np.full((trees, size), 0.5), np.zeros((trees, size))
    front = [(t, 1) for t in range(trees)]
    for level in range(depth):
        if not front:
            break
        looks = np.zeros((trees, size, tries), np.int32)
        for t, node in front:
            looks[t, node] = column_order(t, node, space.columns)[:tries]
        found, later = _level(rows, space, weight, column, cut, looks, front, level, leaf), []
        for t, node, c, at, worth, own, low, high, n_low, n_high in found:
            value[t, node] = own
            if c < 0:
                continue
            column[t, node], cut[t, node], gain[t, node] = c, at, worth
            for child, p, m in ((2 * node, low, n_low), (2 * node + 1, high, n_high)):
                value[t, child] = p
                if m >= 2 * leaf and 0 < p < 1:
                    later.append((t, child))
        front = later
    return {"space": space, "column": column, "cut": cut, "value": value, "gain": gain, "depth": depth}


def _level(rows, space, weight, column, cut, looks, front, level, leaf) -> list[tuple]:
    """One pass: tree, node, column (-1: none), cut, gain, probabilities of the node and its children, and their sizes."""
    trees, size, tries = looks.shape
    cells = tries * BINS * 2

    def run(batches):
        slot = np.full((trees, size), -1, np.int32)
        for k, (t, node) in enumerate(front):
            slot[t, node] = k
        nodes_of = [np.array([node for s, node in front if s == t], int) for t in range(trees)]
        have = np.zeros(len(front) * cells)
        for batch in _lots(batches):
            for codes, before, after, first, y, _, hashes in _blocks(batch, space.reach):
                bins = space.bins(codes, before, np.maximum(0, after), first, len(y))
                drawn = _draws(hashes, before, trees)
                drawn[:, after < 0] = 0
                flat, m = bins.ravel(), np.int32(len(y))
                for t in range(trees):
                    mine = slot[t][_nodes(bins, column[t], cut[t], level)]
                    r = np.flatnonzero((mine >= 0) & (drawn[t] > 0)).astype(np.int32)
                    if not r.size:
                        continue
                    start = int(slot[t][slot[t] >= 0].min())  # the slots of a tree follow each other
                    own, w, base = mine[r] - start, drawn[t, r], y[r].astype(np.int32)
                    nodes = nodes_of[t]
                    part = np.zeros(len(nodes) * cells)
                    for k in range(tries):
                        which = looks[t, nodes, k] * m
                        part += np.bincount((own * np.int32(cells) + k * (2 * BINS) + base) + 2 * flat[which[own] + r].astype(np.int32), w, len(part))
                    have[start * cells : start * cells + len(part)] += part
        yield _arrays(dict(enumerate(have.reshape(-1, cells))), "slot")

    def split(key, part):
        import pandas as pd

        sums = np.zeros(cells)
        sums[part["i"].to_numpy()] = part["v"].to_numpy()
        t, node = front[int(key[0])]
        sums = sums.reshape(1, tries, BINS, 2)
        c, at = (int(v[0]) for v in choose(sums, weight, np.arange(tries), tries, leaf))
        whole, low = sums[0, 0].sum(axis=0), sums[0, max(c, 0), : at + 1].sum(axis=0)
        sides = [whole, low, whole - low]
        mass = [v * weight[0] for v in sides]
        share = [v[1] / max(1e-300, v.sum()) for v in mass] if whole.sum() else [0.5] * 3
        pure = [(v**2).sum() / max(1e-300, v.sum()) for v in mass]
        return pd.DataFrame([(t, node, int(looks[t, node, c]) if c >= 0 else -1, at, pure[1] + pure[2] - pure[0], *share, sides[1].sum(), sides[2].sum())], columns=["tree", "node", "column", "cut", "gain", "p", "low", "high", "n_low", "n_high"])

    done = _summed(rows, run, "slot").groupBy("slot").applyInPandas(split, "tree int, node int, column int, cut int, gain double, p double, low double, high double, n_low double, n_high double")
    return sorted(tuple(r) for r in done.collect())  # a row a node


def importances(forest: dict) -> np.ndarray:
    """What the splits gain by each column: shares by tree, then of their sum."""
    out = np.zeros(forest["space"].columns)
    for column, gain in zip(forest["column"], forest["gain"], strict=True):
        own = np.bincount(column[column >= 0], gain[column >= 0], len(out))
        out += own / max(1e-300, own.sum())
    return out / max(1e-300, out.sum())


def runs(rows: DataFrame, forest: dict, least: int, share: float = 0.5) -> DataFrame:
    """seq_id, start, end, length, score: runs of residues whose probability is ``share`` or more, and its mean."""
    kind = rows.schema["seq_id"].dataType.simpleString()

    def run(batches):
        space, trees = forest["space"], len(forest["column"])
        for batch in _lots(batches):
            found = []  # of the batch, by residue
            for codes, before, after, first, y, which, _ in _blocks(batch, space.reach):
                bins, p = space.bins(codes, before, np.maximum(0, after), first, len(y)), np.zeros(len(y))
                for t in range(trees):
                    p += forest["value"][t][_nodes(bins, forest["column"][t], forest["cut"][t], forest["depth"])]
                found.append((np.where(after >= 0, p / trees, -1.0), before, which))  # gaps end a run
            if not found:
                continue
            p, before, which = (np.concatenate(c) for c in zip(*found, strict=True))
            first, last = spans_of(p >= share, least)
            n = last - first + 1
            score = np.add.reduceat(p, np.stack([first, last + 1], axis=1).ravel())[::2] / n if n.size else np.zeros(0)  # a gap follows the last
            ids = batch.column("seq_id").take(pa.array(which[first]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(before[first] + 1, pa.int64()), pa.array(before[last] + 1, pa.int64()), pa.array(n, pa.int64()), pa.array(score)], names=["seq_id", "start", "end", "length", "score"])

    return rows.select("seq_id", "seq", "spots", "hash").mapInArrow(run, f"seq_id {kind}, start long, end long, length long, score double")
