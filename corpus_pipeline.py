"""Corpus clean-up in five stages; each reads what its predecessor wrote and works on all of it.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``docs``, whatever their names are. They decide by
row: rows that share a doc_id, or have none, are documents of their own, and rows that repeat share their fate. Very long
texts are read whole. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from immunoscan.llm import bpe, decontamination, language_id, secrets, simhash_dedup
from immunoscan.llm.shared import materialize, row_keys, table

SURE = 0.4  # least probability of the predicted language
SHINGLE, SIMILARITY = 5, 0.8  # of the near-dedup stage


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs``, with their row keys, that have (left_semi) or lack (left_anti) a match in ``keys`` (r1, r2)."""
    named = keys.select(F.col("r1").alias("r1_key_"), F.col("r2").alias("r2_key_"))
    return docs.select(*docs.columns, *row_keys("_key_")).join(named, ["r1_key_", "r2_key_"], how)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too), or in no language the network is sure of, go. Of equally likely
    languages the first by name counts."""
    keyed = docs.select("doc_id", "text", "lang", F.struct(*[k for k in row_keys()]).alias("key"))
    found = language_id.identify(keyed.select("key", "text"), language_id.fit(docs), "key")
    good = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(F.col("key.r1").alias("r1_key_"), F.col("key.r2").alias("r2_key_")).distinct()
    return docs.select(*docs.columns, *row_keys("_key_")).join(good, ["r1_key_", "r2_key_"], "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: of the least doc_id. Of rows
    with one doc_id the least key stays, a null doc_id comes last. Null and blank texts are one group; of a row that repeats one stays."""
    kept = materialize(simhash_dedup.kept_rows(docs, SHINGLE, SIMILARITY), "kept")
    out = _matched(docs, kept, "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["r1_key_", "r2_key_"])
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of the benchmark go; other rows of their doc_id stay, and so do null and empty texts."""
    hit = decontamination.contaminated_rows(docs, table(spark, sf_dir, "benchmark"))
    return _matched(docs, hit, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; the documents stay. A null text stays null."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as digests, with a round trip; a null text has none."""
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
