"""An index that a second call takes up, vectors that share an id, and the pipeline's stages on rows that are easily lost."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from immunoscan.llm import embedding_dedup, substring_dedup

rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def test_two_calls_over_one_index_report_what_one_does(spark):
    batches = [[rng.randrange(60) for _ in range(30)] for _ in range(6)]
    frame = lambda b: spark.createDataFrame([(c,) for c in b], "c long")
    one = substring_dedup.FingerprintIndex(spark, fanout=2)
    want = [{r["c"] for r in one.ingest(frame(b)).collect()} for b in batches]
    one.close()
    first = substring_dedup.FingerprintIndex(spark, fanout=2)
    got = [{r["c"] for r in first.ingest(frame(b)).collect()} for b in batches[:3]]
    assert len(first.names) == 1  # compacted: what comes next is joined with the compacted run
    second = substring_dedup.FingerprintIndex(spark, fanout=2, names=first.names, buckets=first.buckets)
    got += [{r["c"] for r in second.ingest(frame(b)).collect()} for b in batches[3:]]
    second.close()
    assert got == want


def test_a_vec_id_of_two_vectors_links_nothing(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (1, a, 1), (9, a, 1)]
    got = embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (1, 1, 1), (9, 1, 1)])
    far = [(5, a, 0), (5, b, 0), (6, [1.0, 0.01, 0.0], 0), (7, [0.01, 1.0, 0.0], 0)]
    got = {(r["vec_id"], r["component_id"], r["n_links"]) for r in embedding_dedup.near_dedup(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(5, 5, 1), (6, 5, 1), (7, 5, 1)}


def _text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, _text(40), "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(1, rows[1][1], "en", "s")] * 2 + [(None, _text(30), None, None), (None, None, "en", "s"), (60, None, None, "s"), (61, "", "en", "s"), (62, "   ", "en", None), (63, "1234 !?", "en", "s"), (64, _text(30_000), "en", "s")]
    rows += [(70, "password = hunter2hunter2 " + rows[3][1], "en", "s")]
    frame = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, r1_key_ string")
    return frame.withColumn("n_chars", F.length("text").cast("long")).repartition(4)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language_stage(spark, docs):
    plain = docs.drop("r1_key_")
    got = corpus_pipeline.identify(spark, plain, "")
    assert got.columns == plain.columns and not got.where("text is null or trim(text) = '' or doc_id = 63").count()
    assert got.where("doc_id = 1").count() in (0, 3)  # rows that repeat share their fate
    assert set(_rows(got)) <= set(_rows(plain))
    assert corpus_pipeline.identify(spark, plain.where("doc_id < 0"), "").isEmpty()


def test_secret_stage(spark, docs):
    plain = docs.drop("r1_key_")
    got = corpus_pipeline.mask_secrets(spark, plain, "")
    assert got.columns == plain.columns and got.count() == plain.count()
    assert got.where("doc_id = 70").first()["text"].startswith("<SECRET> ") and got.where("text is null").count() == 2
    assert _rows(got.where("doc_id <> 70 or doc_id is null")) == _rows(plain.where("doc_id <> 70 or doc_id is null"))
    assert corpus_pipeline.mask_secrets(spark, plain.where("doc_id < 0"), "").isEmpty()


def test_token_stage(spark, docs):
    got = corpus_pipeline.tokenize(spark, docs, "")
    assert got.count() == docs.count() and got.where("doc_id in (60, 61)").agg(F.sum("n_tokens")).first()[0] == 0
    assert got.where("doc_id = 1").select("ids_sha256").distinct().count() == 1
    assert corpus_pipeline.tokenize(spark, docs.where("doc_id < 0"), "").isEmpty()


def test_near_dedup_and_decontamination_stages_of_nothing(spark, docs):
    none = docs.drop("r1_key_").where("doc_id < 0")
    assert corpus_pipeline.near_dedup(spark, none, "").isEmpty() and corpus_pipeline.near_dedup(spark, none, "").columns == none.columns
    assert corpus_pipeline.decontaminate(spark, none, "/root/testdata/sf0.001").isEmpty()
