"""Score tables as CSV: written and parsed in blocks by the tasks that make the rows."""

import gzip
import random
from pathlib import Path

from pyspark.sql import functions as F

from immunoscan.operators import tracks as T
from immunoscan.sources import files

rng = random.Random(31)


def _seqs(spark, sizes):
    rows = [(i, f"doc_{i}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)), n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "seq_id long, name string, seq string, n long").repartition(3)


def test_scores_come_back_from_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(files, "SCORE_ROWS", 100)
    monkeypatch.setattr(files._scores_writer, "__defaults__", (100,))
    seqs = _seqs(spark, [1, 5, 7, 90, 100, 101, 450])
    wide = T.aligned(seqs)
    want = sorted((tuple(r) for r in wide.select("seq_id", "pos", "aa", *[F.round(c, 4) for c in wide.columns[3:]]).collect()), key=str)
    for path in (files.write_aligned(seqs), files.write_scores(wide)):
        parts = sorted(Path(path.removeprefix("file://")).iterdir())
        texts = [gzip.decompress(p.read_bytes()).decode().split("\n") for p in parts]
        assert len(parts) >= 8 and all(p.name.startswith("part-") and len(t) <= 102 and t[0] == "seq_id,pos,aa," + ",".join(wide.columns[3:]) for p, t in zip(parts, texts, strict=True))
        got = files.read_scores(spark, path)
        assert got.columns == wide.columns and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_numbers_are_rounded_as_spark_does(spark):
    values = [0.0, 0.00005, 0.00015, -0.00005, 9.99995, 10.00005, -10.00005, 12.34565, 9.9999, 123456.654321, 1.0, None]
    rows = [(1, i + 1, "A", v, None, 0.5, v, -1.25) for i, v in enumerate(values)]
    wide = spark.createDataFrame(rows, "seq_id long, pos long, aa string, " + ", ".join(f"{m.replace('-', '_')} double" for m in T.ALL))
    want = sorted((tuple(r) for r in wide.select("seq_id", "pos", "aa", *[F.round(c, 4) for c in wide.columns[3:]]).collect()), key=str)
    assert sorted((tuple(r) for r in files.read_scores(spark, files.write_scores(wide)).collect()), key=str) == want


def test_a_task_that_runs_again_replaces_its_files(spark, tmp_path):
    wide = T.aligned(_seqs(spark, [40, 60])).coalesce(1)
    write = lambda: wide.mapInArrow(files._scores_writer(f"file://{tmp_path}"), files.WRITTEN).agg(F.sum("rows")).first()[0]
    assert write() == write() == 100 and files.read_scores(spark, f"file://{tmp_path}").count() == 100


def test_no_sequences_give_no_scores(spark):
    none = _seqs(spark, [9]).where("n < 0")
    assert files.read_scores(spark, files.write_aligned(none)).isEmpty()
