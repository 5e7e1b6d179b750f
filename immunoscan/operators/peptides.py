"""k-mers, score conversions and binder levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import AA
from .ranks import numbered


def kmers(seqs: DataFrame, k: int, step: int = 1) -> DataFrame:
    """Every k-mer (or every step-th): seq_id, start, end, peptide. The k-mers are cut first, so rows don't carry the sequence."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?=(.{{{k}}}))"), F.lit(1))
    if step > 1:
        cut = F.filter(cut, lambda _, i: i % step == 0)
    out = seqs.where(F.col("n") >= k).select("seq_id", F.posexplode(cut).alias("p", "peptide"))
    start = (F.col("p") * step + 1).cast("long")
    return out.select("seq_id", start.alias("start"), (start + k - 1).alias("end"), "peptide")


def stride(k: int, overlap: int) -> int:
    return k - overlap + 1 if overlap < k else 1


def standard(peptide: Column) -> Column:
    return peptide.rlike(f"^[{AA}]+$")


def ic50_of(score: Column, slope: float = 0.5, top: float = 500.0) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(50000.0), top * F.exp(-slope * score)))


def percentile_of(ic50: Column) -> Column:
    return F.when(ic50 < 50, 0.1).when(ic50 < 500, 1 + (ic50 - 50) / 450 * 4).when(ic50 < 5000, 5 + (ic50 - 500) / 4500 * 45).otherwise(50 + F.least(F.lit(50.0), (ic50 - 5000) / 45000 * 50))


def level_of(ic50: Column) -> Column:
    return F.when(ic50 < 50, "Strong").when(ic50 < 500, "Moderate").when(ic50 < 5000, "Weak").otherwise("Non-binder")


def model_output(log10_ic50: Column) -> tuple[Column, Column]:
    """ic50 and score of a model's log10 prediction."""
    return F.pow(F.lit(10.0), log10_ic50), F.greatest(F.lit(0.0), 1 - log10_ic50 / 5)


def model_rows(df: DataFrame, group: list[str], y: str, key: str) -> DataFrame:
    """Adds ic50, score, binding (strong, weak, none) and percentile: 100 times the rank by ic50 over the group's rows."""
    out = numbered(df, group, [y, key])
    percentile = 100 * (F.col("row_number") / F.col("total"))
    return out.withColumns(model_columns(y) | {"percentile": percentile}).drop("row_number", "total")


def model_columns(y: str) -> dict[str, Column]:
    ic50, score = model_output(F.col(y))
    return {"ic50": ic50, "score": score, "binding": F.when(ic50 < 50, "strong").when(ic50 < 500, "weak").otherwise("none")}


def allele_name(raw: Column) -> Column:
    bare = F.regexp_replace(F.upper(F.regexp_replace(raw, " ", "")), "^([A-C])([0-9]{2})([0-9]{2})$", "$1*$2:$3")
    return F.when(F.startswith(bare, F.lit("HLA-")), bare).otherwise(F.concat(F.lit("HLA-"), bare))
