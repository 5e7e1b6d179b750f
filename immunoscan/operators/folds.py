"""Leave-one-group-out logistic regressions, all folds and feature sets in the same passes.

A fold is a group that is held out; one more fold holds out none. Each pass over the rows sums up, for every fold and
feature set that has not converged, the gradient and the Hessian at its present weights: a task leaves a fold's own group out
and yields one row a fold and set. Sums of these rows are the Newton step. So the number of passes is that of Newton steps,
whatever the number of groups.

Features are standardised by the fold's own rows and classes are balanced within them. Means, deviations and class sizes of a fold are those of
all rows less those of the held-out group. Weights have a penalty of half their square, the constant has none.
The driver holds folds x sets x (features + 1) weights, which is the result itself; ``block`` folds are worked on at a time.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assays import auc

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

NONE = "(none)"


def _sums(rows: DataFrame, group: str, label: str, columns: list[str]) -> list:
    """One row a group: sizes of the classes, sums and sums of squares."""
    x = [F.col(c) for c in columns]
    return rows.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * c) for c in x]).alias("ss")).collect()


def fit(rows: DataFrame, group: str, label: str, sets: dict[str, list[str]], penalty: float = 1.0, most: int = 50, close: float = 1e-9, block: int = 512) -> list[tuple]:
    """(set, held-out group, weights on the raw features with the constant last, weights on standardised features) of each fold whose
    group has both classes, and of the fold NONE."""
    columns = sorted({c for cs in sets.values() for c in cs})
    rows = rows.select(F.col(group).cast("string").alias("g_"), (F.col(label) == 1).cast("int").alias("y_"), *[F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in columns])
    each = _sums(rows, "g_", "y_", columns)
    n, pos = sum(r["n"] for r in each), sum(r["pos"] for r in each)
    s, ss = (np.sum([r[k] for r in each], axis=0) for k in ("s", "ss"))
    held = [(r["g_"], r["n"], r["pos"], np.array(r["s"]), np.array(r["ss"])) for r in sorted(each, key=lambda r: str(r["g_"])) if 0 < r["pos"] < r["n"] and 0 < pos - r["pos"] < n - r["n"]]
    if 0 < pos < n:
        held.append((NONE, 0, 0, np.zeros(len(columns)), np.zeros(len(columns))))
    out = []
    for i in range(0, len(held), block):
        out += _newton(rows, held[i : i + block], columns, sets, n, pos, s, ss, penalty, most, close)
    return out


def _newton(rows, held, columns, sets, n, pos, s, ss, penalty, most, close) -> list[tuple]:
    names = [h[0] for h in held]
    size = np.array([n - h[1] for h in held], float)
    ones = np.array([pos - h[2] for h in held], float)
    mean = np.array([(s - h[3]) for h in held]) / size[:, None]
    sd = np.sqrt(np.maximum(np.array([(ss - h[4]) for h in held]) / size[:, None] - mean**2, 0))
    sd[sd <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    weight = np.stack([size / (2 * (size - ones)), size / (2 * ones)], axis=1)  # of class 0 and 1
    at = {k: [columns.index(c) for c in cs] for k, cs in sets.items()}
    beta = {k: np.zeros((len(held), len(v) + 1)) for k, v in at.items()}
    open_ = {(k, f) for k in sets for f in range(len(held))}
    for _ in range(most):
        if not open_:
            break
        todo = {k: [f for f in range(len(held)) if (k, f) in open_] for k in sets}
        state = rows.sparkSession.sparkContext.broadcast((names, mean, sd, weight, at, beta, todo))

        def run(batches):
            names, mean, sd, weight, at, beta, todo = state.value
            place = {g: f for f, g in enumerate(names)}
            sums: dict = {}
            for batch in batches:
                own = np.array([place.get(g, -1) for g in batch.column(0).to_pylist()])
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1) if len(y) else np.empty((0, len(columns)))
                for k, folds in todo.items():
                    for f in folds:
                        use = own != f
                        z = np.concatenate([(x[use][:, at[k]] - mean[f, at[k]]) / sd[f, at[k]], np.ones((use.sum(), 1))], axis=1)
                        p = 1 / (1 + np.exp(-np.clip(z @ beta[k][f], -500, 500)))
                        w = weight[f][y[use]]
                        g, h = z.T @ (w * (y[use] - p)), (z * (w * p * (1 - p))[:, None]).T @ z
                        have = sums.get((k, f))
                        sums[k, f] = np.concatenate([g, h.ravel()]) + (0 if have is None else have)
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["set", "fold", "v"])

        parts = rows.mapInArrow(run, "set string, fold int, v array<double>").select("set", "fold", F.posexplode("v").alias("i", "v"))
        got: dict = {}
        for r in parts.groupBy("set", "fold", "i").agg(F.sum("v").alias("v")).collect():  # folds x sets x the numbers of a Newton step
            k = r["set"]
            d = len(at[k]) + 1
            got.setdefault((k, r["fold"]), np.zeros(d + d * d))[r["i"]] = r["v"]
        for (k, f), v in got.items():
            d = len(at[k]) + 1
            ridge = penalty * np.append(np.ones(d - 1), 0.0)
            step = np.linalg.solve(v[d:].reshape(d, d) + np.diag(ridge + 1e-12), v[:d] - ridge * beta[k][f])
            beta[k][f] += step * min(1.0, 10 / max(1e-30, np.abs(step).max()))
            if np.abs(step).max() < close:
                open_.discard((k, f))
    out = []
    for k, cols in at.items():
        for f, g in enumerate(names):
            b = beta[k][f]
            raw = b[:-1] / sd[f, cols]
            out.append((k, g, [*raw.tolist(), float(b[-1] - raw @ mean[f, cols])], b[:-1].tolist()))
    return out


def left_out(rows: DataFrame, group: str, label: str, sets: dict[str, list[str]], **how) -> DataFrame:
    """set, group, auc: each group with both classes scored by the fold that has not seen it."""
    models = [m for m in fit(rows, group, label, sets, **how) if m[1] != NONE]
    columns = sorted({c for cs in sets.values() for c in cs})
    # a row a group and set; weights in the order of ``columns``, 0 where the set lacks one
    spread = [(k, g, [float(dict(zip(sets[k], w, strict=False)).get(c, 0.0)) for c in columns] + [w[-1]]) for k, g, w, _ in models]
    table = rows.sparkSession.createDataFrame(spread, "features string, held_ string, w_ array<double>")
    scored = rows.join(table, F.col(group).cast("string") == F.col("held_"))
    value = sum((F.col("w_")[i] * F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(columns)), F.col("w_")[len(columns)])
    key = F.struct("features", F.col(group).alias("group_"))
    out = auc(scored.select(key.alias("key"), value.alias("value"), (F.col(label) == 1).alias("truth")), "key", "value", "truth")
    return out.select("key.features", F.col("key.group_").alias(group), "auc")


def all_weights(rows: DataFrame, group: str, label: str, sets: dict[str, list[str]], **how) -> DataFrame:
    """features, feature, weight (on standardised values), place by size: of the fits on all rows, for reading only."""
    models = [m for m in fit(rows, group, label, sets, **how) if m[1] == NONE]
    flat = [(k, c, w, i + 1) for k, _, _, b in models for i, (c, w) in enumerate(sorted(zip(sets[k], b, strict=True), key=lambda t: (-abs(t[1]), t[0])))]
    return rows.sparkSession.createDataFrame(flat, "features string, feature string, weight double, place int")
