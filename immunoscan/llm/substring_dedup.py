"""Operator 3: substring dedup over word windows, by a log-structured fingerprint index.

The index keeps sorted immutable runs of (fingerprint, count). A new batch is aggregated, merge-joined
with every live run, and written as a run of its own; when too many runs have piled up they are
compacted into one, which later batches are joined with. Runs are bucketed tables with one sorted file a bucket, so that neither the
join nor the compaction shuffles history again: only the new batch moves. Fingerprints that have now
been seen twice are reported; repeats.intervals then verifies every window around them. An index outlives the call: ``names`` of its
runs, given to another one, go on where it stopped.

The fingerprints are those of the grams that stand for windows (repeats.py), not of all windows: 16 bytes for each window would be more than
the disk budget of four times the input.

Null text counts as empty. Empty and short texts keep all their words. Rows that repeat are copies of
each other. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import Windows, anchor_rows, dealt, intervals, removal
from .shared import discard, materialize, partitions, row_keys, shared_dir, small_batches, table

WORDS = Windows("words", length=35, gram=8)


class FingerprintIndex:
    """Runs of (c, n) in the shared folder. ``fanout``: live runs before a compaction."""

    def __init__(self, spark: SparkSession, fanout: int = 2, names: list[str] | None = None, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.runs: list[DataFrame] = [self._open(name) for name in names or []]

    @property
    def names(self) -> list[str]:
        """What another index over the same runs is opened with, together with ``buckets``."""
        return [run.scratch_name for run in self.runs]

    def _open(self, name: str) -> DataFrame:
        run = self.spark.table(name)
        run.scratch_path, run.scratch_name = f"{shared_dir(self.spark)}/{name}", name
        return run

    def _write(self, counts: DataFrame) -> DataFrame:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        dealt_out = counts.repartition(self.buckets, "c").sortWithinPartitions("c")
        dealt_out.write.bucketBy(self.buckets, "c").sortBy("c").option("path", path).format("parquet").saveAsTable(name)
        return self._open(name)

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"drop table if exists {run.scratch_name}")
        discard(run)

    def ingest(self, fingerprints: DataFrame) -> DataFrame:
        """Adds a batch (column c, one row an occurrence); returns those that have now occurred twice."""
        new = self._write(fingerprints.groupBy("c").agg(F.count("*").alias("n")))
        seen = new.select("c", "n")
        for k, run in enumerate(self.runs):
            seen = seen.join(run.select("c", F.col("n").alias(f"n{k}")), "c", "left")
        total = sum((F.coalesce(f"n{k}", F.lit(0)) for k in range(len(self.runs))), F.col("n"))
        twice = materialize(seen.where(total > 1).select("c"), "twice")
        self.runs.append(new)
        if len(self.runs) > self.fanout:
            self.compact()
        return twice

    def compact(self) -> None:
        both = self.runs[0].select("c", "n")
        for run in self.runs[1:]:
            both = both.unionByName(run.select("c", "n"))
        merged = self._write(both.groupBy("c").agg(F.sum("n").alias("n")))
        for run in self.runs:
            self._drop(run)
        self.runs = [merged]

    def close(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []


def repeated_anchors(docs: DataFrame, spec: Windows, batches: int) -> DataFrame:
    """Anchor rows whose fingerprint occurs twice, found by feeding the index batch after batch."""
    spark = docs.sparkSession
    keyed = docs.select("text", *row_keys())
    rows = materialize(anchor_rows(keyed, spec), "anchors")
    index, twice = FingerprintIndex(spark), []
    for b in range(batches):
        twice.append(index.ingest(rows.where(F.pmod("r1", F.lit(batches)) == b).select("c")))
    index.close()
    known = twice[0]
    for more in twice[1:]:
        known = known.unionByName(more)
    # written first, so that the join reads both sides from plain exchanges and a frequent fingerprint can be split
    known = materialize(known.distinct(), "known")
    out = materialize(rows.join(known, "c", "left_semi"), "repeated")
    for used in (rows, known, *twice):
        discard(used)
    return out


def dedup(docs: DataFrame, spec: Windows = WORDS, batches: int = 4, keep_text: bool = False) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of every document (and the kept text as binary)."""
    small_batches(docs.sparkSession)
    found = repeated_anchors(docs, spec, batches)
    texts = dealt(docs)
    return removal(texts, intervals(texts, found, spec), spec.unit, keep_text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")
