"""Sweeps, controls, rankings and histograms of metrics; residue roll-up and chain assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tracks import upto


def fallback_percentile(ic50: Column) -> Column:
    """Percentile of an affinity without reference set: linear between fixed knots."""
    knots = [(50, 500, 0.5, 2.0), (500, 5000, 2.0, 10.0), (5000, 50000, 10.0, 100.0)]
    out = F.when(ic50 < 50, 0.1)
    for lo, hi, a, b in knots[:2]:
        out = out.when(ic50 < hi, a + (ic50 - lo) / (hi - lo) * (b - a))
    lo, hi, a, b = knots[2]
    return out.otherwise(F.least(F.lit(b), a + (ic50 - lo) / (hi - lo) * (b - a)))


def counts(found: Column, truth: Column, n: Column) -> list[Column]:
    """tp, fp, fn, tn of found places against true ones; both are arrays without repeats, of ``n`` places in all."""
    tp = F.size(F.array_intersect(found, truth)).cast("long")
    fp, fn = F.size(found).cast("long") - tp, F.size(truth).cast("long") - tp
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (n - tp - fp - fn).alias("tn")]


def sweep(votes: DataFrame, thresholds: range = range(1, 6)) -> DataFrame:
    """seq_id, threshold, tp, fp, fn, tn of votes >= threshold. ``votes``: seq_id, n, votes (one a place), spots (the true places)."""
    parts = [F.struct(F.lit(t).cast("long").alias("threshold"), *counts(F.filter(upto(F.col("n")), lambda i: F.col("votes")[i - 1] >= t), F.col("spots"), F.col("n"))) for t in thresholds]
    return votes.select("seq_id", F.inline(F.array(*parts)))


def median_controls(res: DataFrame, truth: str, features: dict[str, int]) -> DataFrame:
    """One feature as predictor: at or beyond the structure's median, above (1) or below (-1); nulls are not called."""
    by = Window.partitionBy("structure_id")
    each = res
    for f, sign in features.items():
        v = sign * F.col(f)
        each = each.withColumn("c_" + f, F.coalesce(v >= F.median(v).over(by), F.lit(False)))
    rows = each.select("structure_id", F.col(truth).alias("t"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col("c_" + f).alias("c")) for f in features])).alias("x"))
    t, c = F.col("t"), F.col("x.c")
    return rows.groupBy("structure_id", "x.feature").agg(F.count_if(c & t).alias("tp"), F.count_if(c & ~t).alias("fp"), F.count_if(~c & t).alias("fn"), F.count_if(~c & ~t).alias("tn"))


def ranking(metrics: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups by mean metric, best first. One row a group reaches the final window."""
    out = metrics.groupBy(group).agg(F.round(F.avg(metric), 4).alias(metric))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), group)).cast("long"))


def histogram(values: DataFrame, group: str, value: str, bins: int = 16) -> DataFrame:
    """Equal bins from least to greatest, the last one closed; empty bins count 0. One value only: a range of 1 around it."""
    v = F.col(value)
    ends = values.where(v.isNotNull()).groupBy(group).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"))
    ends = ends.withColumns({"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long")
    counts = values.where(v.isNotNull()).join(ends, group).groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.select(group, "mean", "median", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return spine.join(counts, [group, "bin"], "left").na.fill(0, ["n"])


def z_scores(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Per-group z-scores with the population deviation; 0 where the value is missing or the group constant."""
    by = Window.partitionBy(group)
    z = {f: F.coalesce(F.when(F.stddev_pop(f).over(by) > 1e-12, (F.col(f) - F.avg(f).over(by)) / F.stddev_pop(f).over(by)), F.lit(0.0)) for f in features}
    return df.withColumns(z)


def residue_rollup(atoms: DataFrame) -> DataFrame:
    """One row a residue: the CA's place, the atoms' area, the CA's b-factor or else the atoms' mean."""
    ca = lambda c: F.max(F.when(F.col("atom") == "CA", F.col(c)))
    return atoms.groupBy("structure_id", "chain_id", "idx").agg(*[ca(c).alias(c) for c in "xyz"], F.sum("area").alias("sasa"), F.coalesce(ca("bfactor"), F.avg("bfactor")).alias("bfactor"))


def chain_sequences(res: DataFrame, wanted: DataFrame, least: int = 6) -> DataFrame:
    """Whole chains that hold a wanted residue, as sequences of at least ``least`` letters."""
    rows = res.join(wanted.select("structure_id", "chain_id").distinct(), ["structure_id", "chain_id"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "aa")))
    out = rows.groupBy("structure_id", "chain_id").agg(F.array_join(F.transform(ordered, lambda r: r["aa"]), "").alias("seq"))
    return out.withColumn("n", F.length("seq").cast("long")).where(F.col("n") >= least)
