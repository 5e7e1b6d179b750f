"""Per-residue tracks of the five scales, above-threshold regions, and votes over methods.

Every job here is local to a sequence, so numpy works on the sequence's own letters inside the tasks (``arrays``) and rows leave last: no
exchange, no sort. Linear sums are kept in thousandths, which makes threshold tests exact; the product track is rounded to
nine decimals before it is tested. ``window``, ``threshold`` and ``least`` are the caller's; None takes the
method's default, and where that is None too the sequence's mean is the threshold.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import AA, METHODS, milli
from . import arrays as R
from .arrays import codes_of, half_up, letters_of, rounded, spans_of, sums_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

ALL = list(METHODS)


def letters(seqs: DataFrame) -> DataFrame:
    """Adds ``aa``, the letters, and ``code``, their places in AA from 1, 0 for others."""
    out = seqs.where("n > 0").withColumn("aa", F.split("seq", ""))
    return out.withColumn("code", F.transform("aa", lambda c: F.instr(F.lit(AA), c)))


def held(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each. The optimiser doesn't move expressions across it, so what was computed
    before is not written out again in each place that uses it."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def upto(n, start: int = 1) -> Column:
    """start..n, empty if n is less."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= start, F.sequence(F.lit(start), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def valued(code: str, values: list[int], unknown: int) -> Column:
    """The value of each letter."""
    table = F.array(*[F.lit(v) for v in (unknown, *values)])
    return F.transform(code, lambda c: table[c])


def window_of(method: str, window: int | None) -> int:
    return METHODS[method][0] if window is None else window


def kinds(methods: list[str], window: int | None = None, threshold: float | None = None) -> list[tuple]:
    """What tasks need to know of each method: name, values in thousandths by code, window, whether it multiplies, scale, fixed threshold or None."""
    cut = lambda m: METHODS[m][1] if threshold is None else threshold
    values = lambda m: np.array([1000 if m == "emini" else 0, *milli(m)])
    return [(m, values(m), window_of(m, window), m == "emini", scale(m, window), None if cut(m) is None else float(cut(m))) for m in methods]


def values_of(codes: np.ndarray, kind: tuple) -> np.ndarray:
    """Window sums in thousandths, or products over their mean. The k-th value belongs to position k + window // 2."""
    _, values, w, product, _, _ = kind
    if not product:
        return sums_of(values[codes], w)
    each, size = values[codes] / 1000, max(0, len(codes) - w + 1)
    out = each[:size].copy()
    for k in range(1, w):
        out *= each[k : k + size]
    mean = np.cumsum(out)[-1] / size if size else 0.0  # added from left to right
    return out / mean if mean > 0 else out


def scores_of(values: np.ndarray, kind: tuple) -> np.ndarray:
    """The values over their scale, to six decimals. Sums are whole numbers, so their quotients round exactly."""
    return rounded(values) if kind[3] else half_up(values * 1000, kind[2]) / 1e6


def called(values: np.ndarray, kind: tuple) -> np.ndarray:
    """Whether each value is at or above the threshold."""
    _, _, _, product, by, cut = kind
    if cut is not None:
        return (rounded(values, 9) if product else values) >= round(cut * by, 9)
    # a mean as threshold; the sum is cut to a whole number, as sums in thousandths are
    return values.astype(np.int64) * len(values) >= int(total_of(values))


def total_of(values: np.ndarray) -> float:
    """The sum from left to right."""
    return float(np.cumsum(values)[-1]) if len(values) else 0.0


def tracked(seqs: DataFrame, methods: list[str] = ALL, window: int | None = None) -> DataFrame:
    """``seqs`` with ``aa``, its letters, and an array of values for each method: window sums in thousandths, or products over their mean.
    The k-th value belongs to position k + window // 2."""
    of = kinds(methods, window)

    def made(seq):
        codes = codes_of(seq)
        return [values_of(codes, k) for k in of]

    out = R.extended(seqs, ", ".join(f"`t_{m}` array<{'double' if m == 'emini' else 'int'}>" for m in methods), made)
    return out.withColumn("aa", F.split("seq", ""))


def scale(method: str, window: int | None = None) -> int:
    """What a value of the track is divided by to give the score."""
    return 1 if method == "emini" else 1000 * window_of(method, window)


def score(value: Column, method: str, window: int | None = None) -> Column:
    return F.round(value.cast("double") / scale(method, window), 6)


def count(values: Column) -> Column:
    """The size of an array, null for none, so that means of nothing are null."""
    return F.nullif(F.size(values), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def residues(seqs: DataFrame) -> DataFrame:
    """seq_id, n, pos (from 1), aa."""
    return seqs.where("n > 0").select("seq_id", "n", F.posexplode(F.split("seq", "")).alias("p", "aa")).select("seq_id", "n", (F.col("p") + 1).cast("long").alias("pos"), "aa")


def track(seqs: DataFrame, methods: list[str] = ALL, window: int | None = None) -> DataFrame:
    """seq_id, method, pos, aa, score, one row a method and scored position."""
    of = kinds(methods, window)
    names = pa.array(methods)

    def rows(seq):
        codes, aa, each = codes_of(seq), letters_of(seq), []
        for i, k in enumerate(of):
            values, half = values_of(codes, k), k[2] // 2
            each.append((np.full(len(values), i), half + 1 + np.arange(len(values)), aa.slice(half, len(values)), scores_of(values, k)))
        method, pos, letters_, score_ = zip(*each, strict=True)
        return [names.take(pa.array(np.concatenate(method))), np.concatenate(pos), pa.concat_arrays(letters_), np.concatenate(score_)]

    return R.exploded(seqs, ["seq_id"], "method string, pos long, aa string, score double", rows)


def scored_places(seqs: DataFrame, methods: list[str] = ALL, window: int | None = None) -> DataFrame:
    """seq_id, method, pos, score: ``track`` without letters, in the order of ``arrays.parted``."""

    def maker(kind):
        def made(seq):
            values = values_of(codes_of(seq), kind)
            return [kind[0], kind[2] // 2 + 1 + np.arange(len(values)), scores_of(values, kind)]

        return made

    return R.parted(seqs, ["seq_id"], "method string, pos long, score double", [maker(k) for k in kinds(methods, window)])


def aligned(seqs: DataFrame, methods: list[str] = ALL, window: int | None = None, then=None, gives: str | None = None) -> DataFrame:
    """seq_id, pos, aa and a score column for each method, one row a residue; null where a method has no full window. ``then`` and ``gives`` as in
    ``arrays.exploded``."""
    of = kinds(methods, window)

    def rows(seq):
        codes, out = codes_of(seq), [np.arange(1, len(seq) + 1), letters_of(seq)]
        for k in of:
            values, whole = values_of(codes, k), np.full(len(seq), np.nan)
            whole[k[2] // 2 : k[2] // 2 + len(values)] = scores_of(values, k)
            out.append(whole)
        return out

    return R.exploded(seqs, ["seq_id"], "pos long, aa string, " + ", ".join(f"`{m.replace('-', '_')}` double" for m in methods), rows, then, gives)


def runs(flags: Column, least: int = 1) -> Column:
    """``s, e``: maximal runs of true flags of at least this length, as places from 1."""
    first = F.filter(upto(F.size(flags)), lambda i: flags[i - 1] & ((i == 1) | ~F.coalesce(F.get(flags, i - 2), F.lit(False))))
    last = F.filter(upto(F.size(flags)), lambda i: flags[i - 1] & ~F.coalesce(F.get(flags, i), F.lit(False)))
    both = F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return F.filter(both, lambda r: r["e"] - r["s"] + 1 >= least)


def with_runs(seqs: DataFrame, methods: list[str] = ALL, least: int = 6, window: int | None = None, threshold: float | None = None, tracks: bool = True) -> DataFrame:
    """``tracked`` with the runs of each method as ``r_<method>``, an array of ``s, e``; without the tracks and letters if they are not wanted."""
    of = kinds(methods, window, threshold)

    def made(seq):
        codes, out = codes_of(seq), []
        for k in of:
            values = values_of(codes, k)
            first, last = spans_of(called(values, k), least)
            out += [values] * tracks + [(first + 1, last + 1)]
        return out

    fields = [f for m in methods for f in [f"`t_{m}` array<{'double' if m == 'emini' else 'int'}>"] * tracks + [f"`r_{m}` array<struct<s:int,e:int>>"]]
    out = R.extended(seqs, ", ".join(fields), made)
    return held(out.withColumn("aa", F.split("seq", ""))) if tracks else out


def means_of(values: np.ndarray, first: np.ndarray, last: np.ndarray, kind: tuple) -> np.ndarray:
    """The mean score of each run."""
    size = last - first + 1
    if kind[3]:
        return np.array([total_of(values[s : e + 1]) for s, e in zip(first, last, strict=True)]) / size
    added = np.concatenate(([0], np.cumsum(values)))
    return (added[last + 1] - added[first]) / (kind[4] * size)


def regions(seqs: DataFrame, methods: list[str] = ALL, least: int = 6, window: int | None = None, threshold: float | None = None) -> DataFrame:
    """seq_id, method, start, end, length, peptide, score: runs at or above the threshold, with their mean score."""
    of = kinds(methods, window, threshold)

    def rows(seq):
        codes, out = codes_of(seq), [[] for _ in range(6)]
        for k in of:
            values, half = values_of(codes, k), k[2] // 2
            first, last = spans_of(called(values, k), least)
            size = last - first + 1
            mean = means_of(values, first, last, k)
            mean = rounded(mean) if k[3] else mean
            spans = zip((first + half).tolist(), (last + half + 1).tolist(), strict=True)
            for whole, part in zip(out, ([k[0]] * len(size), (first + half + 1).tolist(), (last + half + 1).tolist(), size.tolist(), [seq[s:e] for s, e in spans], mean.tolist()), strict=True):
                whole += part
        return out

    return R.exploded(seqs, ["seq_id"], "method string, start long, end long, length long, peptide string, score double", rows)


def predicted(seqs: DataFrame, methods: list[str] = ALL, least: int = 6) -> DataFrame:
    """``seqs`` with threshold_<i>, positions_<i>, scores_<i> and epitopes_<i> for the i-th method."""
    of = kinds(methods)

    def made(seq):
        codes, out = codes_of(seq), []
        for k in of:
            values, half = values_of(codes, k), k[2] // 2
            first, last = spans_of(called(values, k), least)
            spans = zip((first + half).tolist(), (last + half + 1).tolist(), strict=True)
            cut = k[5] if k[5] is not None else total_of(values) / (k[4] * len(values)) if len(values) else None
            out += [cut, half + 1 + np.arange(len(values)), scores_of(values, k), (first + half + 1, last + half + 1, [seq[s:e] for s, e in spans], means_of(values, first, last, k))]
        return out

    each = "threshold_{0} double, positions_{0} array<bigint>, scores_{0} array<double>, epitopes_{0} array<struct<start:bigint,end:bigint,sequence:string,score:double>>"
    return R.extended(seqs, ", ".join(each.format(i) for i in range(len(methods))), made)


def votes_of(seq: str, of: list[tuple], least: int) -> np.ndarray:
    """For each residue the number of methods whose regions cover it."""
    codes, turns = codes_of(seq), np.zeros(len(seq) + 1, np.int64)
    for k in of:
        first, last = spans_of(called(values_of(codes, k), k), least)
        turns[first + k[2] // 2] += 1  # a method's regions are apart, so no place stands here twice
        turns[last + k[2] // 2 + 1] -= 1
    return np.cumsum(turns[:-1])


def vote_arrays(seqs: DataFrame, methods: list[str] = ALL, least: int = 6, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """seq_id, n, the columns to keep, votes: for each residue the number of methods whose regions cover it."""
    of = kinds(methods)
    out = R.extended(seqs.select("seq_id", "n", *keep, *([] if "seq" in keep else ["seq"])), "votes array<int>", lambda seq: [votes_of(seq, of, least)])
    return out.select("seq_id", "n", *keep, "votes")


def votes(seqs: DataFrame, methods: list[str] = ALL) -> DataFrame:
    """seq_id, pos, votes: number of methods whose regions cover each residue."""
    of = kinds(methods)
    return R.exploded(seqs, ["seq_id"], "pos long, votes long", lambda seq: [np.arange(1, len(seq) + 1), votes_of(seq, of, 6)])


def consensus(seqs: DataFrame, methods: int = 2, least: int = 6) -> DataFrame:
    """seq_id, start, end, length, top: runs of residues with at least so many votes."""
    of = kinds(ALL)

    def rows(seq):
        votes = votes_of(seq, of, 6)
        first, last = spans_of(votes >= methods, least)
        ends = np.stack((first, last + 1), axis=1).ravel()  # every second part is a run; what lies behind the last end is none
        top = np.maximum.reduceat(np.append(votes, 0), ends)[::2] if len(first) else first
        return [first + 1, last + 1, last - first + 1, top]

    return R.exploded(seqs, ["seq_id"], "start long, end long, length long, top long", rows)


def thresholds(seqs: DataFrame, methods: list[str] = ALL, window: int | None = None, threshold: float | None = None) -> DataFrame:
    """seq_id, method, threshold: the caller's, else the method's, else the mean of the sequence's track."""
    of = kinds(methods, window, threshold)

    def rows(seq):
        codes = codes_of(seq)
        each = [(k[0], values_of(codes, k), k) for k in of]
        each = [(m, rounded(np.array([total_of(v) / (k[4] * len(v))]))[0] if k[5] is None else k[5]) for m, v, k in each if len(v)]
        return [[m for m, _ in each], [float(t) for _, t in each]]

    return R.exploded(seqs, ["seq_id"], "method string, threshold double", rows)


def summaries(seqs: DataFrame, methods: list[str] = ALL) -> DataFrame:
    """seq_id, method, top, low, mean of each track; 0 for an empty track."""
    of = kinds(methods)

    def rows(seq):
        codes, out = codes_of(seq), []
        for k in of:
            v = values_of(codes, k)
            out.append((*scores_of(np.array([v.max(), v.min()]), k), rounded(np.array([total_of(v) / (k[4] * len(v))]))[0]) if len(v) else (0.0, 0.0, 0.0))
        return [[k[0] for k in of], *map(list, zip(*out, strict=True))]

    return R.exploded(seqs, ["seq_id"], "method string, top double, low double, mean double", rows)


def top_spans(seqs: DataFrame, method: str, share: float = 0.8, least: int = 4, top: int = 5) -> DataFrame:
    """seq_id, start, end, rank: the runs at or above the track's percentile with the greatest means."""
    t, half = F.col(f"`t_{method}`"), METHODS[method][0] // 2
    out = tracked(seqs, [method]).withColumn("sorted_", F.sort_array(t)).withColumn("place_", (F.size(t) - 1) * F.lit(share))
    low = F.floor("place_").cast("int")
    at = [F.get("sorted_", low).cast("double"), F.get("sorted_", F.least(low + 1, F.size(t) - 1)).cast("double")]
    out = held(out.withColumn("cut_", at[0] + (at[1] - at[0]) * (F.col("place_") - low)))  # a filter before would compute the track anew
    out = out.where(F.size(t) > 0).withColumn("o_", F.transform(t, lambda x: x >= F.col("cut_")))
    mean = lambda r: total(F.slice(t, r["s"], r["e"] - r["s"] + 1)) * 1000 / (r["e"] - r["s"] + 1)
    spans = F.transform(runs(F.col("o_"), least), lambda r: F.struct((-mean(r)).alias("m"), (r["s"] + half).cast("long").alias("start"), (r["e"] + half).cast("long").alias("end")))
    each = out.withColumn("r_", F.sort_array(spans)).select("seq_id", F.posexplode(F.slice("r_", 1, top)).alias("p", "r"))
    return each.select("seq_id", "r.start", "r.end", (F.col("p") + 1).cast("long").alias("rank"))


def islands(rows: DataFrame, keys: list[str], least: int, *aggs) -> DataFrame:
    """Maximal runs of consecutive ``pos`` in a table of rows, within ``keys``: start, end, length and the given aggregates."""
    from pyspark.sql import Window

    run = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    out = rows.withColumn("run", run).groupBy(*keys, "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("length"), *aggs)
    return out.where(F.col("length") >= least).drop("run")
