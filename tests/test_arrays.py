"""numpy jobs over sequences against Spark's own rounding and plain Python, and how fast they are."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from immunoscan.operators import arrays as R
from immunoscan.operators import tracks as T

rng = random.Random(9)


def test_rounding_is_that_of_spark(spark):
    values = [0.0, 2.5e-7, 5e-7, -5e-7, 1.0000005, -1.0000015, 0.1234565, 1e6 + 0.0000005, 123.4567895] + [rng.uniform(-3, 3) for _ in range(2000)] + [rng.randrange(10**7) / 2e6 + 5e-7 for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    want = [r["r"] for r in df.select("i", F.round("v", 6).alias("r")).orderBy("i").collect()]
    assert R.rounded(np.array(values)).tolist() == want


def test_letters_pieces_and_runs():
    assert R.letters_of("ACé").to_pylist() == ["A", "C", "é"] and R.codes_of("ACéY").tolist() == [1, 2, 0, 20]
    assert R.pieces_of("ACDEF", np.array([0, 2]), 3).to_pylist() == ["ACD", "DEF"] and R.pieces_of("AC", np.zeros(0, int), 3).to_pylist() == []
    flags = [rng.random() < 0.7 for _ in range(500)]
    text = "".join("x" if f else "." for f in flags)
    want = [(i, i + len(p) - 1) for i, p in ((sum(len(q) + 1 for q in text.split(".")[:k]), p) for k, p in enumerate(text.split("."))) if len(p) >= 3]
    assert list(zip(*(x.tolist() for x in R.spans_of(np.array(flags), 3)), strict=True)) == want


def test_tracks_of_two_million_letters_take_seconds(spark):
    """The interpreted array functions took some 30 s for the five tracks and regions of so many."""
    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20_000))
    seqs = spark.range(100, numPartitions=8).select(F.col("id").alias("seq_id"), F.lit(text).alias("seq"), F.lit(len(text)).cast("long").alias("n"))
    T.aligned(seqs.limit(1)).count()
    began = time.time()
    rows = T.aligned(seqs).agg(F.count("*").alias("n"), F.sum("parker").alias("s")).first()
    assert rows["n"] == 2_000_000 and T.regions(seqs).count() % 100 == 0 and time.time() - began < 12


def test_tables_of_residues_are_written_compressed(spark):
    from pathlib import Path

    from immunoscan.sources import files

    seqs = spark.createDataFrame([(1, "doc_1", "ACDEFGHIKLMNPQRSTVWY" * 40, 800)], "seq_id long, name string, seq string, n long")
    for path in (files.write_scores(T.aligned(seqs)), files.write_predictions(seqs, ["kolaskar-tongaonkar", "emini"])):
        parts = list(Path(path.removeprefix("file://")).glob("part-*"))
        assert parts and all(p.name.endswith(".gz") for p in parts) and sum(p.stat().st_size for p in parts) < 12_000


def test_window_jobs_of_two_million_letters_take_seconds(spark):
    """Helix windows, summaries, binding windows and contexts of so many took more than a minute as interpreted array functions."""
    from immunoscan.functions import matrices as M
    from immunoscan.operators import innate, learning, tcell

    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20_000))
    seqs = spark.range(100, numPartitions=8).select(F.col("id").alias("seq_id"), F.lit(text).alias("seq"), F.lit(len(text)).cast("long").alias("n"))
    learning.scale_context(seqs.limit(1)).count()
    began = time.time()
    jobs = [innate.helices(seqs), innate.summary(seqs), innate.consensus(seqs), tcell.windows(seqs, nine=M.transport(9), ten=M.transport(10)), tcell.top_windows(seqs, list(M.CLASS_ONE)), learning.scale_context(seqs)]
    assert all(j.groupBy("seq_id").count().groupBy("count").count().count() == 1 for j in jobs) and time.time() - began < 30
