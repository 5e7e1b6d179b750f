"""Vectors in many chunks: links as by brute force, and scratch tables that hold no copies of vectors."""

from pathlib import Path

import numpy as np

from immunoscan.llm import embedding_dedup, shared


def _brute(x, same, n):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (same[:, None] == same)
    np.fill_diagonal(link, False)
    root = np.arange(n)
    while True:
        low = np.where(link, root[None], n).min(1)
        new = np.minimum(root, low)
        if (new == root).all():
            return link.sum(1), root
        root = new


def test_links_within_and_between_chunks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "UNIT", 64)
    monkeypatch.setattr(embedding_dedup, "TILE", 24)
    random_ = np.random.default_rng(8)
    centre = random_.standard_normal((40, 24))
    x = (centre[np.arange(700) % 40] + 0.2 * random_.standard_normal((700, 24))).astype(np.float32)
    x[650:] = x[:50]
    same = np.where(np.arange(700) % 7 == 0, np.arange(700) % 60, 1000)  # a label of ten chunks, others of a few rows
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], int(same[k])) for k in range(700)], "vec_id long, embedding array<float>, label int")
    links, root = _brute(x.astype(float), same, 700)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_dedup(df).collect()}
    assert got == {k: (int(links[k]), int(root[k]), int(root[k]) == k) for k in range(700)} and links.sum() > 1000


def test_zeros_of_either_sign_are_equal(spark):
    rows = [(1, [0.0, 1.0, 0.2], 0), (2, [-0.0, 1.0, 0.2], 0), (3, [1.0, 0.0, -0.0], 0), (4, [1.0, -0.0, 0.0], 0)]
    for kind in ("float", "double"):
        got = embedding_dedup.near_dedup(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()
        assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)}


def test_scratch_tables_hold_no_copies_of_vectors(spark, tmp_path, monkeypatch):
    for module in (embedding_dedup, shared):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}", raising=False)
    x = np.random.default_rng(3).standard_normal((2000, 64)).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], k % 2) for k in range(2000)], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_dedup(df).where("kept").count() == 2000
    assert 0 < sum(f.stat().st_size for f in Path(tmp_path).rglob("*") if f.is_file()) < 2 * x.nbytes  # 8 copies and more before
