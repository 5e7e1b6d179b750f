"""FASTA files that arrive in several micro-batches, with a failure in the middle."""

import pytest
from pyspark.sql import functions as F

from immunoscan.operators import tracks as T
from immunoscan.sources import files
from immunoscan.streaming.arriving import score_fasta

BODY = "MKTAYIAKQRQISFVKSHFSRQLEEALCLSHLRALQ"


@pytest.fixture(scope="module")
def arriving(tmp_path_factory):
    where = tmp_path_factory.mktemp("fasta")
    for i in range(7):
        (where / f"f{i}.fasta").write_text(f">a{i} with a > in its text\n{BODY[:20]}\n{BODY[20:]}{'DE' * i}\n\n>b{i}\r\n{BODY * 2}\r\n")
    (where / "bare.fasta").write_text(BODY)
    (where / "bad.fasta").write_text(f">\n{BODY}\n>empty\n\n>last\nMK TAY\tI\n")
    (where / "void.fasta").write_text("")
    return str(where)


def _job(batch):
    return T.regions(batch.withColumnRenamed("name", "seq_id"), ["parker"]).select("seq_id", "start", "end", "peptide")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_records(spark, arriving):
    got = {(r["name"], r["seq"], r["reason"]) for r in files.read_fasta(spark, arriving).collect()}
    assert ("a3", BODY + "DE" * 3, None) in got and ("b0", BODY * 2, None) in got and ("Sequence_1", BODY, None) in got
    assert ("", BODY, "no name") in got and ("empty", "", "no letters") in got and ("last", "MKTAYI", None) in got and len(got) == 18


def test_batches_and_a_restart_equal_the_batch_job(spark, arriving, tmp_path):
    found = files.read_fasta(spark, arriving)
    want = _rows(_job(found.where("reason is null").select("name", "seq", F.length("seq").cast("long").alias("n"))))
    calls = []

    def breaks(batch):
        calls.append(1)
        if len(calls) == 3:
            _job(batch).collect()
            raise RuntimeError("executor lost")
        return _job(batch)

    where = {"out": str(tmp_path / "out"), "marks": str(tmp_path / "marks")}
    with pytest.raises(Exception, match="executor lost"):
        score_fasta(spark, arriving, breaks, 2, **where)
    done, aside = score_fasta(spark, arriving, breaks, 2, **where)
    assert len(calls) == 6 and _rows(done) == want  # five batches, one of them twice
    assert {(r["name"], r["reason"]) for r in aside.collect()} == {("", "no name"), ("empty", "no letters")}
    again, _ = score_fasta(spark, arriving, breaks, 2, **where)
    assert len(calls) == 6 and _rows(again) == want  # nothing new has arrived
