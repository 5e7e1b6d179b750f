"""Filtering stages of the pipeline on null and repeated ids with different texts."""

import random

import corpus_pipeline

rng = random.Random(5)


def prose(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, r1 string"


def test_near_dedup_keeps_unlike_rows_of_an_id(spark):
    unlike = [(None, prose(60)) for _ in range(5)] + [(7, prose(60)) for _ in range(4)] + [(8, prose(60))]
    near = [(None, unlike[0][1] + " end"), (3, unlike[1][1] + " end"), (2, unlike[1][1] + " end"), (7, unlike[9][1] + " end"), (9, unlike[5][1] + " end")]
    rows = unlike + near + [unlike[6]] * 3 + [(1, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "x") for r in rows], SCHEMA).repartition(4)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    free = [r for r in unlike if r not in (unlike[0], unlike[1], unlike[9])]
    group = [r for r in got if r[1] in (unlike[0][1], near[0][1])]
    assert len(group) == 1
    assert got == sorted(free + group + [near[2], near[3], (1, None)], key=str)


def test_decontamination_takes_only_the_rows_hit(spark, tmp_path):
    items = [prose(60) for _ in range(3)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, prose(60)), (None, None), (4, prose(80)), (4, prose(60)), (5, prose(60))]
    # windows at the same place of different texts
    hit = [(k, items[x]) for k in (None, 4) for x in range(3)] + [(5, items[0] + " " + prose(20)), (None, prose(9) + " " + items[2])]
    docs = spark.createDataFrame([(*r, "en", "x") for r in clean + hit + hit], SCHEMA).repartition(4)
    out = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(clean, key=str)
