"""Assay clean-up, allele selection, curation of antigen sets, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import tied


def clean(assays: DataFrame) -> DataFrame:
    return assays.where(F.col("peptide").rlike("^[A-Z]{8,15}$") & (F.col("allele").contains("HLA") | F.col("allele").contains("H-2")))


def affinity(quant: Column, qual: Column) -> Column:
    """Numeric value, else by the first qualitative key that is contained, else 500; within 1..100000."""
    q = F.lower(qual)
    word = F.when(q.contains("positive-high"), 50.0).when(q.contains("positive-intermediate"), 200.0).when(q.contains("positive-low"), 1000.0).when(q.contains("positive"), 500.0).when(q.contains("negative"), 20000.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(100000.0), F.coalesce(quant.try_cast("double"), word, F.lit(500.0))))


def allele_counts(assays: DataFrame, least: int, top: int) -> DataFrame:
    counts = assays.groupBy("allele").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "allele").limit(top)


def mhc_class(allele: Column) -> Column:
    return F.when(allele.rlike("DRB|DQB|DPB"), "II").otherwise("I")


def validate(claims: DataFrame, seqs: DataFrame) -> DataFrame:
    """claims: seq_id, pep_id, peptide, start. Position by exact slice, else by first occurrence."""
    both = claims.join(seqs.select("seq_id", "seq", "n"), "seq_id")
    slice_ = F.expr("substring(seq, cast(start as int), length(peptide)) = peptide")
    found = F.when(slice_, F.col("start")).otherwise(F.expr("cast(locate(peptide, seq) as long)"))
    return both.select("seq_id", "pep_id", "peptide", "n", found.alias("at"), slice_.alias("exact")).where("at > 0")


def capped(cands: DataFrame, per: str, order: list, cap: int, relaxed: int, top: int) -> DataFrame:
    """The first ``top`` rows with at most ``cap`` of each group, or ``relaxed`` where that gives too few. Both caps bound
    what a group passes on."""
    rank = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    few = cands.withColumn("rank", rank).where(F.col("rank") <= max(cap, relaxed))
    enough = few.agg((F.count_if(F.col("rank") <= cap) >= top).alias("enough"))  # one row
    return few.join(F.broadcast(enough)).where(~F.col("enough") | (F.col("rank") <= cap)).drop("enough").orderBy(*order).limit(top)


def rates(df: DataFrame) -> DataFrame:
    """Sensitivity, specificity, precision, F1 and MCC from tp, fp, fn, tn; 0 where a denominator is empty."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return df.withColumns({"sens": div(tp, tp + fn), "spec": div(tn, tn + fp), "ppv": div(tp, tp + fp), "npv": div(tn, tn + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "accuracy": div(tp + tn, tp + tn + fp + fn), "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def auc(df: DataFrame, group: str, score: str, truth: str) -> DataFrame:
    """Mann-Whitney AUC per group, ties averaged; null for a group of one class."""
    true = F.col(truth)
    values = tied(df, [group], score, pos=F.when(true, 1).otherwise(0), neg=F.when(~true, 1).otherwise(0))
    out = values.groupBy(group).agg(F.sum(F.col("pos") * F.col("rank")).alias("rs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    value = (F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return out.select(group, "pos", "neg", F.round(F.when((F.col("pos") > 0) & (F.col("neg") > 0), value), 6).alias("auc"))
