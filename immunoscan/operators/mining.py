"""Antigens mined from assay records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Organisms that are left out, and terms of names that are.
ORGANISMS = ["homo sapiens", "mus musculus", "rattus norvegicus", "unidentified", "canis lupus familiaris", "bos taurus", "gallus gallus", "mus musculus c57bl/6"]
TERMS = ["polyprotein", "hypothetical", "unknown", "unnamed", "conserved hypothetical"]


def candidates(records: DataFrame) -> DataFrame:
    """source_mol (60 letters), accession, organism, positives, peptides: records of upper-case peptides of 8 to 25 letters with
    a place, a source and an accession, of organisms that are not left out. Positive: the word, or nothing. The accession and
    organism are those of the source's last record."""
    accession = F.regexp_extract("source_iri", r"ncbi\.nlm\.nih\.gov/protein/([A-Za-z0-9_.]+)", 1)
    rows = records.where(F.col("peptide").rlike("^[A-Z]{8,25}$") & (F.col("start") != "") & (F.col("end") != "") & (F.trim("source_mol") != "") & ~F.lower("organism").isin(*ORGANISMS)).withColumn("accession", accession).where("accession <> ''")
    positive = F.lower("qual").contains("positive") | (F.col("qual") == "")
    by = rows.groupBy(F.substring(F.trim("source_mol"), 1, 60).alias("source_mol"))
    return by.agg(F.max_by("accession", "rec_id").alias("accession"), F.max_by(F.substring("organism", 1, 40), "rec_id").alias("organism"), F.count_if(positive).alias("positives"), F.count_distinct(F.when(positive, F.col("peptide"))).alias("peptides"))


def richest(cands: DataFrame, least: int = 5) -> DataFrame:
    """The candidate with the most positives of each accession, the first name of equals."""
    rank = F.row_number().over(Window.partitionBy("accession").orderBy(F.desc("positives"), "source_mol"))
    return cands.where(F.col("positives") >= least).withColumn("rank", rank).where("rank = 1").drop("rank")


def named(cands: DataFrame, top: int = 120) -> DataFrame:
    """Candidates without the terms in their names, those with the most positives."""
    keep = F.lit(True)
    for term in TERMS:
        keep = keep & ~F.contains(F.lower("source_mol"), F.lit(term))
    return cands.where(keep).orderBy(F.desc("positives"), "accession").limit(top)
