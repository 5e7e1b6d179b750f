"""Rows of places in parts: the same rows, in an order in which files take less."""

import random
from pathlib import Path

from immunoscan.functions.dims import AA, LINEAR
from immunoscan.operators import arrays as R
from immunoscan.operators import learning as L
from immunoscan.operators import tracks as T
from immunoscan.plans.catalogue import QUERIES

rng = random.Random(41)


def test_parts_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(R, "GROUP", 3000)
    monkeypatch.setattr(R, "BLOCK", 700)
    monkeypatch.setattr(R, "PART", 64)
    texts = [None, "", "A", "ACDEFG", "ACDEFGH", "é" * 20, *["".join(rng.choice(AA) for _ in range(n)) for n in (8, 14, 15, 70, 70, 71, 500, 2999, 3001, 9000)]]
    texts += texts[-4:]
    seqs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "seq_id long, seq string, n long").repartition(2)
    got = [tuple(r) for r in T.scored_places(seqs, LINEAR).collect()]
    assert sorted(got) == sorted(tuple(r) for r in T.track(seqs, LINEAR).select("seq_id", "method", "pos", "score").collect()) and len(got) > 50_000


def test_the_rows_of_the_linear_track_take_few_bytes(spark, tmp_path):
    QUERIES["b3_linear_track"](spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "b3"))
    rows = spark.read.parquet(str(tmp_path / "b3")).count()
    size = sum(f.stat().st_size for f in Path(tmp_path, "b3").glob("part-*"))
    assert size < 2.4 * rows


def test_pieces_come_by_score_within_a_group(spark):
    texts = ["".join(rng.choice("ACD") for _ in range(n)) for n in (5, 9, 40, 400, 900, 900)]
    seqs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "seq_id long, seq string, n long").coalesce(1)
    got = L.piece_scores(seqs, lambda codes: codes[:9].sum(0) % 7 / 4, 9).collect()
    place = {(r["seq_id"], r["start"]): (r["y"], r["percentile"]) for r in got}
    assert [r["y"] for r in got] == sorted(r["y"] for r in got) and len(place) == len(got) == sum(max(0, len(t) - 8) for t in texts)
    for i, t in enumerate(texts):
        y = [sum(1 + AA.index(c) for c in t[s : s + 9]) % 7 / 4 for s in range(len(t) - 8)]
        for rank, s in enumerate(sorted(range(len(y)), key=lambda s: (y[s], s)), 1):  # noqa: B023
            assert place[i, s + 1] == (y[s], 100 * (rank / len(y)))
