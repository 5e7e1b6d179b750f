"""Operator 5: byte-exact dedup of repeated 200-byte strings, by content-selected anchors and window hashes.

These replace distributed prefix doubling: there are no sorted ranks and no doubling of pairs. The positions are
the anchors of repeats.py (every 200-byte string holds one), and three fixed rounds compare 64-bit hashes made from
the text: grams of 96 bytes, then ranges of windows, then single strings of 200 bytes. A position whose hash is
unique in a round takes no part in the next. Ranking all byte positions would shuffle eight bytes and more for
each byte of text: some 7 GB for 0.5 GB of input in the first round alone (calculated), against a disk budget of 2 GB.

Null text counts as empty. Short texts keep all their bytes. Rows that repeat are copies of each other.
Extra columns are ignored. An empty table gives an empty result. Matches never cross documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import Windows, anchor_rows, dealt, intervals, removal
from .shared import discard, materialize, row_keys, small_batches, table

BYTES = Windows("bytes", length=200, gram=96, node=32)


def repeated_positions(docs: DataFrame, spec: Windows) -> DataFrame:
    """First round: positions whose gram occurs twice."""
    rows = materialize(anchor_rows(docs.select("text", *row_keys()), spec), "positions")
    # written first, so that the join below reads both sides from plain exchanges and a frequent rank can be split
    ranks = materialize(rows.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "ranks")
    out = materialize(rows.join(ranks, "c", "left_semi"), "repeated")
    discard(rows)
    return out


def dedup(docs: DataFrame, spec: Windows = BYTES, keep_text: bool = False) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of every document (and the kept bytes)."""
    small_batches(docs.sparkSession)
    found = repeated_positions(docs, spec)
    texts = dealt(docs)
    return removal(texts, intervals(texts, found, spec), spec.unit, keep_text)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
