"""Sinks of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import new_folder


def epitope_rows(regions: DataFrame) -> DataFrame:
    """method, start, end, sequence, score with three decimals, by sequence."""
    return regions.select("seq_id", "method", "start", "end", F.col("peptide").alias("sequence"), F.round("score", 3).alias("score"))


EPITOPES = "seq_id long, method string, start long, end long, sequence string, score double"


def write_epitopes(regions: DataFrame) -> str:
    """Tab-separated files with a header in a new shared folder; Spark writes them in parallel."""
    path = new_folder(regions.sparkSession, "epitopes")
    epitope_rows(regions).write.csv(path, sep="\t", header=True)
    return path


def read_epitopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPITOPES).csv(path, sep="\t", header=True)
