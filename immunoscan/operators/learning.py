"""Feature arrays of peptides and residues, and models fitted on them with Spark ML.

Encodings are column expressions that give arrays; ``vector`` turns them into what Spark ML takes. A substitution matrix is a
parameter: rows of 20 numbers by letter. ``alike`` builds one from the scales.
"""

from __future__ import annotations

import statistics
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims as D
from . import arrays as R
from . import context_forest as CF
from .arrays import codes_of, rounded
from .assays import auc
from .grove import spec_of
from .innate import axa_points, best_stretch, cut_points, cut_sites, heads
from .ranks import tied
from .tracks import held, letters, upto, valued

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

AA = D.AA
# Fixed values of the five properties of a letter: scaled hydropathy, volume, polarity, aromatic or not, charge (0.5 is neutral).
CHARGES = {"D": 0.0, "E": 0.0, "K": 1.0, "R": 1.0, "H": 0.6}
NEUTRAL = [0.5, 0.5, 0.5, 0.0, 0.5]
PROPERTIES = [[round((D.HYDROPATHY[i] / 10 + 4.5) / 9, 3), D.VOLUME[i], D.POLARITY[i], float(a in "FHWY"), CHARGES.get(a, 0.5)] for i, a in enumerate(AA)]


def alike() -> list[list[int]]:
    """How alike two letters are: 5 less what their standardised scales differ by on average, as whole numbers."""
    scaled = [_standard(D.SCALES[s]) for s in D.SCALES]
    return [[round(5 - 2 * sum(abs(v[i] - v[j]) for v in scaled) / len(scaled)) for j in range(20)] for i in range(20)]


def _standard(values: list[float]) -> list[float]:
    mean, sd = statistics.fmean(values), statistics.pstdev(values)
    return [(v - mean) / sd for v in values]


def _rows(table: list[list[float]], unknown: list[float]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in (unknown, *table)])


ONE_HOT = [[float(i == j) for j in range(20)] for i in range(20)]
NONE = [0.0] * 20


def _codes(peptide: Column, size: int) -> list[Column]:
    return [F.instr(F.lit(AA), F.substring(peptide, i + 1, 1)) * (F.length(peptide) > i).cast("int") for i in range(size)]


def encode_padded(peptide: Column, size: int = 12, matrix: list[list[int]] | None = None) -> Column:
    """One-hot and substitution rows of ``size`` letters (cut, or filled with zeros), the length's share, and whether place 2 is in
    LMI or TS and the last of the first nine in VLI or YF."""
    matrix = matrix or alike()
    codes = _codes(peptide, size)
    n = F.least(F.length(peptide), F.lit(size))
    two, nine = F.substring(peptide, 2, 1), F.substr(peptide, F.least(F.lit(9), n), F.lit(1))
    flags = [F.when(two.isin(*"LMI"), 1.0), F.when(two.isin(*"TS"), 1.0), F.when(nine.isin(*"VLI"), 1.0), F.when(nine.isin(*"YF"), 1.0)]
    hot, rows = _rows(ONE_HOT, NONE), _rows(matrix, NONE)
    extra = F.array(n.cast("double") / size, *[f.otherwise(0.0) for f in flags])
    return F.concat(F.flatten(F.transform(F.array(*codes), lambda c: hot[c])), F.flatten(F.transform(F.array(*codes), lambda c: rows[c])), extra)


def padded_codes(peptide: Column, size: int = 12) -> Column:
    """What ``encode_padded`` is made from, a byte each: the codes of ``size`` letters (0: none), the length, the code of the last of the first nine."""
    n = F.least(F.length(peptide), F.lit(size))
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    nine = F.instr(F.lit(AA), F.substr(peptide, F.least(F.lit(9), n), F.lit(1)))
    return F.unhex(F.concat(*[byte(c) for c in _codes(peptide, size)], byte(n), byte(nine)))


def padded_spec(size: int = 12, matrix: list[list[int]] | None = None):
    """The features of ``encode_padded`` as tables over ``padded_codes``."""
    matrix, tables = matrix or alike(), []
    for p in range(size):
        tables += [(p, [0.0] + [float(i == j) for i in range(20)]) for j in range(20)]
        tables += [(p, [0.0] + [float(matrix[i][j]) for i in range(20)]) for j in range(20)]
    among = lambda kinds: [0.0] + [float(a in kinds) for a in AA]
    tables += [(size, [i / size for i in range(size + 1)]), (1, among("LMI")), (1, among("TS")), (size + 1, among("VLI")), (size + 1, among("YF"))]
    return spec_of(size + 2, tables)


def piece_codes(codes: np.ndarray, k: int, size: int = 12) -> np.ndarray:
    """``padded_codes`` of each piece of k letters of a sequence of letter codes, an array a column."""
    n, cut = max(0, len(codes) - k + 1), min(k, size)
    out = np.zeros((size + 2, n), np.uint8)
    for p in range(cut):
        out[p] = codes[p : p + n]
    out[size] = cut
    out[size + 1] = codes[min(9, cut) - 1 :][:n]
    return out


def piece_scores(seqs: DataFrame, mean, k: int) -> DataFrame:
    """seq_id, start, y, percentile: ``mean`` (of a ``grove.walker``) of each piece of k letters, and 100 times its rank by y, then start, over the sequence's pieces."""

    def rows(seq):
        y = mean(piece_codes(codes_of(seq), k))
        rank = np.empty(len(y))
        rank[np.argsort(y, kind="stable")] = np.arange(1, len(y) + 1)
        return [np.arange(1, len(y) + 1), y, 100 * (rank / max(1, len(y)))]

    return R.parted(seqs, ["seq_id"], "start long, y double, percentile double", [rows], by=1)


def _nine(k: int) -> list[int]:
    """Which letter of a peptide of k letters stands at each of nine places; 0 for a gap. Short ones get the gap behind the middle,
    of long ones the middle is thinned evenly."""
    if k <= 9:
        mid = k // 2 + 1
        return [*range(1, mid + 1), *[0] * (9 - k), *range(mid + 1, k + 1)]
    step = (k - 6) / 3
    return [1, 2, 3, *[int(3 + step * i) + 1 for i in range(4)], k - 1, k]


def encode_anchored(peptide: Column, matrix: list[list[int]] | None = None) -> Column:
    """One-hot and scaled substitution rows at nine places that keep both ends; null for lengths outside 8 to 11."""
    matrix = [[(v + 4) / 15 for v in row] for row in (matrix or alike())]
    rows = _rows([hot + sub for hot, sub in zip(ONE_HOT, matrix, strict=True)], [0.0] * 40)
    out = F.lit(None).cast("array<double>")
    for k in (8, 9, 10, 11):
        places = F.array(*[F.instr(F.lit(AA), F.substring(peptide, p, 1)) if p else F.lit(0) for p in _nine(k)])
        out = F.when(F.length(peptide) == k, F.flatten(F.transform(places, lambda c: rows[c]))).otherwise(out)
    return out


def encode_core(core: Column) -> Column:
    """Five properties of each of nine letters, and one-hot rows of places 1, 4, 6 and 9."""
    codes, own, hot = F.array(*_codes(core, 9)), _rows(PROPERTIES, NEUTRAL), _rows(ONE_HOT, NONE)
    ends = F.array(*[F.get(codes, i) for i in (0, 3, 5, 8)])
    return F.concat(F.flatten(F.transform(codes, lambda c: own[c])), F.flatten(F.transform(ends, lambda c: hot[c])))


CONTEXT = ["hydropathy", *D.SCALES, "volume"]


#: nine scales of a residue and its context
CONTEXT = {
    "hydropathy": [v / 10 for v in D.HYDROPATHY], "accessibility": D.SCALES["emini"], "flexibility": D.SCALES["karplus-schulz"], "turn": D.SCALES["chou-fasman"], "antigenicity": D.SCALES["kolaskar-tongaonkar"],
    "helix": D.HELIX, "sheet": D.SHEET, "charge": D.CHARGE, "volume": D.RESIDUE_VOLUME,
}


def context_names() -> list[str]:
    """Names of the numbers of ``residue_context``, in order."""
    own = [*CONTEXT, *(f"is_{a}" for a in AA)]
    return [*own, *(f"left_{n}" for n in own), *(f"right_{n}" for n in own), "relative", "distance"]


def residue_context(seqs: DataFrame, reach: int = 4) -> DataFrame:
    """seq_id, pos, centre, left, right (arrays: CONTEXT properties, standardised, then one-hot), relative, distance: of each
    residue, and means over up to ``reach`` residues on either side, zeros where there are none."""
    tables = [_standard(values) for values in CONTEXT.values()]
    rows = _rows([[t[i] for t in tables] + ONE_HOT[i] for i in range(20)], [0.0] * (len(tables) + 20))
    width = len(tables) + 20
    zero = F.array_repeat(F.lit(0.0), width)
    out = letters(seqs).withColumn("f_", F.transform("code", lambda c: rows[c]))

    def mean(part):
        sums = F.aggregate(part, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        return F.when(F.size(part) > 0, F.transform(sums, lambda v: v / F.nullif(F.size(part), F.lit(0)))).otherwise(zero)

    def row(x, i):
        first = F.greatest(F.lit(1), i + 1 - reach)
        return F.struct((i + 1).cast("long").alias("pos"), x.alias("centre"), mean(F.slice("f_", first, i + 1 - first)).alias("left"), mean(F.slice("f_", i + 2, reach)).alias("right"))

    last = F.greatest(F.lit(1), F.col("n") - 1)
    each = out.select("seq_id", "n", F.inline(F.transform("f_", row)))
    at = F.col("pos") - 1
    return each.select("seq_id", "pos", "centre", "left", "right", (at / last).alias("relative"), (F.least(at, F.col("n") - 1 - at) / F.greatest(F.lit(1.0), (F.col("n") - 1) / 2)).alias("distance"))


def context_space(reach: int = 4) -> CF.Space:
    """The numbers of ``residue_context``, in order, for a ``context_forest``."""
    return CF.Space(np.array([[0.0, *_standard(v)] for v in CONTEXT.values()]), reach)


def scale_context(seqs: DataFrame, scale: str = "hydropathy", reach: int = 4) -> DataFrame:
    """seq_id, pos, centre, left, right, relative, distance of ``residue_context`` for one of its scales, to six decimals: numbers, not arrays."""
    table = np.array([0.0, *_standard(CONTEXT[scale])])

    def rows(seq):
        n = len(seq)
        v = np.concatenate((np.zeros(reach), table[codes_of(seq)], np.zeros(reach)))
        at = np.arange(n)
        before, after = np.minimum(at, reach), np.minimum(n - 1 - at, reach)  # how many there are on either side
        left, right = np.zeros(n), np.zeros(n)
        for k in range(reach):  # from the left to the right
            left += v[k : k + n]
            right += v[reach + 1 + k : reach + 1 + k + n]
        out = [v[reach : reach + n], left / np.maximum(1, before), right / np.maximum(1, after)]
        return [at + 1, *map(rounded, out), at / max(1, n - 1), np.minimum(at, n - 1 - at) / max(1.0, (n - 1) / 2)]

    return R.exploded(seqs, ["seq_id"], "pos long, centre double, left double, right double, relative double, distance double", rows)


def signal_features(seqs: DataFrame) -> DataFrame:
    """seq_id and the named numbers of the first 70 letters: charge in letters 1 to 5, hydropathy of 6 to 20, small letters and
    the best A-x-A triple of 16 to 30, hydropathy in ten and charge in five parts of the first 50, shares of nine letters in the first 40, charged
    letters of the first ten, the best hydrophobic stretch, the cuts' scores, the length. Sequences under 15 letters have none."""
    out = held(cut_sites(seqs.where("n >= 15")).withColumns({"charges": valued("code", [round(10 * v) for v in D.CHARGE], 0), "b_": best_stretch(F.lit(40))}))
    part = lambda a, b: F.slice("aa", a, b - a + 1)
    count = lambda arr, kinds: F.size(F.filter(arr, lambda c: c.isin(*kinds))).cast("double")
    total = lambda arr: F.aggregate(arr, F.lit(0), lambda a, x: a + x)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    core, tail = F.slice("hydro", 6, 15), F.slice("hydro", 16, 15)
    n_core, n_tail = F.size(core), F.size(tail)
    squares = total(F.transform(core, lambda x: x * x))
    core_mean, tail_mean = share(total(core).cast("double"), 10 * n_core), share(total(tail).cast("double"), 10 * n_tail)
    triples = upto(F.least(F.lit(30), F.col("n")) - 2, 16)
    best = F.array_max(F.transform(triples, lambda i: axa_points(F.get("aa", i - 1), F.get("aa", i + 1))))
    profile = F.least(F.col("n"), F.lit(50)).cast("int")
    ten, five = F.floor(profile / 10).cast("int"), F.floor(profile / 5).cast("int")
    cuts = F.transform(upto(F.least(F.lit(35), F.col("n") - 1), 15), cut_points)
    named = {
        "basic": count(part(1, 5), "KR") / 5, "charge": count(part(1, 5), "KR") + 0.1 * count(part(1, 5), "H") - count(part(1, 5), "DE"), "starts_met": (F.get("aa", F.lit(0)) == "M").cast("double"),
        "core": core_mean, "core_top": F.array_max(core) / 10, "core_share": count(part(6, 20), "LIVFAMW") / n_core, "core_sd": F.sqrt(F.greatest(F.lit(0), n_core * squares - total(core) * total(core)).cast("double")) / (10 * n_core), "core_size": n_core / 15,
        "small": share(count(part(16, 30), "AGSCT"), n_tail), "tail": tail_mean, "falls": F.when(n_tail > 0, core_mean - tail_mean).otherwise(0.0), "axa": F.coalesce(best, F.lit(0)) / 27.0,
        **{f"hydro_{i}": total(F.slice("hydro", i * ten + 1, ten)).cast("double") / (10 * ten) for i in range(10)}, **{f"charge_{i}": total(F.slice("charges", i * five + 1, five)).cast("double") / 10 for i in range(5)},
        **{f"share_{a}": count(part(1, 40), a) / F.least(F.col("n"), F.lit(40)) for a in "LAVIFKRGS"}, "basic_ten": count(part(1, 10), "KR") / 10, "acidic_ten": count(part(1, 10), "DE") / 10,
        "stretch_at": F.coalesce(-F.col("b_.s") - 1, F.lit(0)) / 40.0, "stretch_size": F.coalesce(-F.col("b_.w"), F.lit(0)) / 20.0, "stretch_mean": F.coalesce(F.col("b_.c").cast("double") / (-10 * F.col("b_.w")), F.lit(0.0)),
        "cut": F.col("cut").cast("double"), "cut_score": F.coalesce("cut_score", F.lit(0.0)), "cut_mean": share(total(cuts).cast("double"), 10 * F.size(cuts)), "size": F.col("n") / 70,
    }
    return out.select("seq_id", *[F.round(c.cast("double"), 6).alias(k) for k, c in named.items()])


def cut_windows(seqs: DataFrame) -> DataFrame:
    """seq_id, cut, features of every candidate place 15 to 35: hydropathy and smallness around it, and its context points."""
    out = heads(seqs.where("n >= 16"))
    at = lambda p: F.get("hydro", p - 1)
    row = lambda p: F.struct(p.cast("long").alias("cut"), F.array(p / 40.0, *[F.coalesce(at(p + 1 + o), F.lit(0)) / 45.0 for o in range(-5, 3)], *[F.when(F.get("aa", p + o).isin(*D.SMALL), 1.0).otherwise(0.0) for o in range(-5, 3)], cut_points(p) / 50.0).alias("features"))
    return out.select("seq_id", F.inline(F.transform(upto(F.least(F.lit(35), F.col("n") - 1), 15), row)))


def split_mark(key: str, share: int = 8) -> Column:
    """True for about ``share`` tenths of the keys, whatever the partitions."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10 < share


def vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("raw_", array_to_vector(features))


def _scaled(train: DataFrame):
    return StandardScaler(inputCol="raw_", outputCol="x_", withMean=True, withStd=True).fit(train)


def fit_regression(train: DataFrame, label: str, trees: int = 100, depth: int = 20, leaf: int = 3):
    """Scaler and random forest on ``features``."""
    train = vector(train)
    scaler = _scaled(train)
    return scaler, RandomForestRegressor(featuresCol="x_", labelCol=label, predictionCol="predicted", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42).fit(scaler.transform(train))


def apply_model(model, df: DataFrame) -> DataFrame:
    """Adds ``predicted`` (a regression) or ``probability`` of class 1."""
    scaler, fitted = model
    out = fitted.transform(scaler.transform(vector(df)))
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability")[1])
    return out.drop("raw_", "x_", "rawPrediction", *(["prediction"] if "prediction" in out.columns else []))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight_``: both classes weigh the same. Two numbers come to the driver."""
    n = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    return df.withColumn("weight_", F.when(F.col(label) == 1, sum(n) / (2 * max(1, n[0]))).otherwise(sum(n) / (2 * max(1, n[1]))))


def fit_classifier(train: DataFrame, label: str, kind: str = "forest", trees: int = 100, depth: int = 15, leaf: int = 5):
    train = balanced(vector(train), label)
    scaler = _scaled(train)
    ready = scaler.transform(train)
    common = {"featuresCol": "x_", "labelCol": label, "weightCol": "weight_"}
    if kind == "logistic":
        return scaler, LogisticRegression(maxIter=100, **common).fit(ready)
    if kind == "boosted":
        return scaler, GBTClassifier(maxIter=trees, maxDepth=depth, seed=42, **common).fit(ready)
    return scaler, RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42, **common).fit(ready)


def regression_metrics(df: DataFrame, group: str, truth: str, predicted: str, binds: float = 500.0) -> DataFrame:
    """group, n, r2, rmse, auc (of truth below ``binds``, both columns log10) of each group."""
    y, p = F.col(truth), F.col(predicted)
    sums = df.groupBy(group).agg(F.count("*").alias("n"), F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst"))
    ranks = auc(df.select(group, (-p).alias("score_"), (F.pow(F.lit(10.0), y) < binds).alias("truth_")), group, "score_", "truth_")
    out = sums.join(ranks.select(group, "auc"), group)
    return out.select(group, "n", F.round(1 - F.try_divide("sse", "sst"), 6).alias("r2"), F.round(F.sqrt(F.col("sse") / F.col("n")), 6).alias("rmse"), "auc")


def signed_ranks(df: DataFrame, method: str, group: str, value: str, base: str, exact: int = 50) -> DataFrame:
    """method, pairs, w_plus, w_minus, z, p, kind, mean, base_mean, label: signed-rank test of each method's values against the base
    method's, pairs by group; ties share ranks, equal pairs don't count. Up to ``exact`` pairs p comes from the null distribution of the rank sum
    with these ties, beyond from the normal approximation. Below 0.05 the greater mean is better. No pairs: p is 1."""
    ref = df.where(F.col(method) == base).select(group, F.col(value).alias("base_"))
    both = df.where(F.col(method) != base).join(ref, group).withColumn("d", F.round(F.col(value) - F.col("base_"), 9))
    means = both.groupBy(method).agg(F.avg(value).alias("mean"), F.avg("base_").alias("base_mean"))
    ranked = tied(both.where("d <> 0").withColumn("abs_", F.abs("d")), [method], "abs_", plus=F.when(F.col("d") > 0, 1).otherwise(0))
    each = F.array_repeat((2 * F.col("rank")).cast("int"), F.when(F.col("total_n") <= exact, F.col("n").cast("int")).otherwise(0))
    # beyond ``exact`` pairs the lists are empty, so no group of any size is gathered
    sums = ranked.groupBy(method).agg(
        F.sum("n").alias("pairs"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("plus")) * F.col("rank")).alias("w_minus"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"), F.flatten(F.collect_list(each)).alias("doubled"),
    )
    n = F.col("pairs").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    normal = 2 * upper_tail(F.abs(F.col("w_plus") - n * (n + 1) / 4) / spread)
    out = means.join(sums, method, "left").withColumn("tail_", smaller_tail(F.coalesce("doubled", F.array().cast("array<int>")), F.coalesce(2 * F.col("w_plus"), F.lit(0)).cast("long")))
    p = F.when(F.col("pairs").isNull(), 1.0).when(F.col("pairs") <= exact, F.least(F.lit(1.0), 2 * F.col("tail_"))).otherwise(F.least(F.lit(1.0), normal))
    out = out.withColumns({"p": p, "z": F.round(z, 6), "kind": F.when(F.coalesce("pairs", F.lit(0)) <= exact, "exact").otherwise("normal")})
    label = F.when((F.col("p") < 0.05) & (F.col("mean") > F.col("base_mean")), "better").when(F.col("p") < 0.05, "worse").otherwise("no different")
    return out.select(method, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), "z", F.round("p", 9).alias("p"), "kind", F.round("mean", 9).alias("mean"), F.round("base_mean", 9).alias("base_mean"), label.alias("label"))


def smaller_tail(doubled: Column, at: Column) -> Column:
    """The smaller of the probabilities that a sum of doubled ranks with random signs is at most, or at least, ``at``. A rank halves
    what stands and adds the other half that much further, so nothing overflows; k ranks cost some k^3 / 2 additions."""

    @F.pandas_udf("double")
    def tail(doubled: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for ranks, w in zip(doubled, at, strict=True):
            have = np.ones(1)
            for r in ranks:
                more = np.zeros(len(have) + r)
                more[: len(have)] = have / 2
                more[r:] += have / 2
                have = more
            out.append(min(have[: w + 1].sum(), have[w:].sum()))
        return pd.Series(out, dtype=float)

    return tail(doubled, at)


def upper_tail(z: Column) -> Column:
    """The normal distribution beyond z >= 0: a series up to 4, from there 30 steps of the continued fraction."""
    density = F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5
    steps = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    fraction = F.aggregate(steps(30, 1), z, lambda f, k: z + k / f)
    series = F.aggregate(steps(1, 80), F.array(z, z), lambda a, k: F.array(a[0] * z * z / (2 * k + 1), a[1] + a[0] * z * z / (2 * k + 1)))
    return F.when(z < 4, 0.5 - density * series[1]).otherwise(density / fraction)
