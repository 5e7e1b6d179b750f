"""Sequences that arrive as files are scored like a batch.

Every job is local to a sequence, so nothing is kept between micro-batches: each one runs the batch job and appends its rows.
The checkpoint remembers which files are done; a batch that is repeated after a failure writes to the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import new_folder
from ..sources.files import FASTA_BREAK, records


def score_arriving(spark: SparkSession, path: str, schema: str, job: Callable[[DataFrame], DataFrame], files: int = 100) -> DataFrame:
    """Runs ``job`` over all parquet files that are there, ``files`` a micro-batch, and returns what it appended."""
    out, marks = new_folder(spark, "arrived"), new_folder(spark, "progress")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

    def append(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def score_fasta(spark: SparkSession, path: str, job: Callable[[DataFrame], DataFrame], files: int = 100, out: str | None = None, marks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs ``job`` over the records (name, seq, n) of all FASTA files that are there, ``files`` a micro-batch, and returns what it appended, and the
    records that were put aside: name, seq, reason.

    A file is whole within a batch. ``out`` and ``marks`` of a run that broke off, given again, take it up where it stood: files that are done
    aren't read again, and the batch that was under way overwrites its own folders. Letters are cleaned by ``job``."""
    out, marks = out or new_folder(spark, "arrived"), marks or new_folder(spark, "progress")
    stream = spark.readStream.option("lineSep", FASTA_BREAK).option("maxFilesPerTrigger", files).text(path).select("value", F.col("_metadata.file_path").alias("file"))

    def append(batch: DataFrame, number: int) -> None:
        found = records(batch)
        good = found.where("reason is null").select("name", "seq", F.length("seq").cast("long").alias("n"))
        found.where("reason is not null").write.mode("overwrite").parquet(f"{out}/aside/batch={number}")
        job(good).write.mode("overwrite").parquet(f"{out}/done/batch={number}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/done").drop("batch"), spark.read.parquet(f"{out}/aside").drop("batch")
