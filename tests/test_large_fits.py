"""Fits and scores whose work must stay with the sequence, and in step with the rows."""

import contextlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from immunoscan.operators import context_forest as CF
from immunoscan.operators import fold_forest as FF
from immunoscan.operators import grove as GR
from immunoscan.operators import innate as I
from immunoscan.operators import learning as L
from immunoscan.operators import peptides as P

SEQS = ["MKTAYIAKQRQISFVKSHFSRQ", "ACDEFGHIK", "AC", "GGGGGGGGGGGGGG", "WYWYWYWYWYWYVLIVTSK" * 300]


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_pieces_are_scored_within_the_sequence(spark):
    seqs = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(SEQS)], "seq_id long, seq string, n long")
    taught = P.kmers(seqs, 9).select(F.lit("x").alias("group"), (F.col("seq_id") * 100000 + F.col("start")).alias("id"), L.padded_codes(F.col("peptide")).alias("codes"), (F.crc32("peptide") % 1000 / 250).alias("y"))
    spec = L.padded_spec(12, L.alike())
    forest = GR.fit(taught, spec, 3, 6).toPandas()
    pieces = P.kmers(seqs, 9).select("seq_id", "start", F.lit("x").alias("group"), L.padded_codes(F.col("peptide")).alias("codes"))
    want = P.model_rows(GR.predict(pieces, spark.createDataFrame(forest, GR.NODES)).withColumnRenamed("predicted", "y"), ["seq_id"], "y", "start")
    done = L.piece_scores(seqs, GR.walker(forest, spec.codes), 9)
    columns = ["seq_id", "start", "y", "percentile"]
    got, want = (sorted(map(tuple, d.select(columns).collect())) for d in (done, want))
    assert got == want and len(got) == sum(max(0, len(s) - 8) for s in SEQS)
    assert "Exchange" not in _plan(done) and "Sort" not in _plan(done)


def test_residue_forest_takes_its_bins_from_the_letters(spark):
    """The bins order residues as the numbers of ``residue_context`` do, across gaps and blocks, and the splits part the classes."""
    seqs = [s[:400] for s in SEQS] + ["K"]
    df = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(seqs)], "seq_id long, seq string, n long")
    space = L.context_space()
    space.grid = np.tile(np.arange(CF.GRID) * CF.BINS // CF.GRID, (2, len(space.scales), 1)).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({"seq": seqs, "spots": [[1]] * len(seqs), "hash": list(range(len(seqs)))})
    got = {}
    for codes, before, after, first, y, which, _ in CF._blocks(batch, space.reach):
        bins = space.bins(codes, before, np.maximum(0, after), first, len(y))
        got |= {(int(s), int(b) + 1): (bins[:, i], y[i]) for i, (s, b, a) in enumerate(zip(which, before, after)) if a >= 0}
    rows = L.residue_context(df).collect()
    assert len(rows) == len(got) == sum(map(len, seqs))
    want = np.array([[*r["centre"], *r["left"], *r["right"], r["relative"], r["distance"]] for r in rows])
    bins = np.array([got[r["seq_id"], r["pos"]][0] for r in rows]).astype(int)
    assert bins.shape[1] == want.shape[1] == len(L.context_names())
    for c in range(want.shape[1]):
        order = np.lexsort((bins[:, c], want[:, c].round(9)))
        assert (np.diff(bins[order, c]) >= 0).all()
        exact = c < space.width or (c % space.width >= len(space.scales) and c < 3 * space.width)
        assert not exact or len(set(zip(bins[:, c], want[:, c].round(9)))) == len(set(bins[:, c]))
    assert all(y == (r[1] == 1) for r, (_, y) in got.items())


def test_residue_forest_learns_and_is_the_same_for_all_partitions(spark):
    gen = np.random.default_rng(5)
    seqs = ["".join(gen.choice(list("ACDEFGHIKLMNPQRSTVWY"), 300)) for _ in range(40)]
    spots = [[i + 1 for i in range(len(s)) if "K" in s[i - 1 if i else 0 : i] or s[i] == "W"] for s in seqs]  # behind a K, or a W
    df = spark.createDataFrame([(i, s, p, i * 977) for i, (s, p) in enumerate(zip(seqs, spots))], "seq_id long, seq string, spots array<int>, hash long")
    one, more = (CF.fit(df.repartition(k), L.context_space(), 20, 5) for k in (1, 7))
    assert all((one[k] == more[k]).all() for k in ("column", "cut", "value", "gain"))
    worth = dict(zip(L.context_names(), CF.importances(one)))
    assert abs(sum(worth.values()) - 1) < 1e-9 and worth["is_W"] > 0.1 and worth["left_is_K"] > 0.1
    runs = [tuple(r) for r in CF.runs(df, one, 1).collect()]
    marked = {(i, k) for i, first, last, n, p in runs for k in range(first, last + 1) if p >= 0.5 and n == last - first + 1}
    truth = {(i, k) for i, p in enumerate(spots) for k in p}
    assert len(marked & truth) > 0.9 * len(truth)
    assert CF.importances(CF.fit(df.where("seq_id < 0"), L.context_space(), 2, 3)).sum() == 0 and not CF.runs(df.where("seq_id < 0"), one, 1).count()


def test_signal_jobs_need_the_first_letters_only(spark):
    gen = np.random.default_rng(8)
    seqs = ["".join(gen.choice(list("AGLVKRSTDE"), n)) for n in (1, 14, 15, 16, 30, 31, 36, 69, 70, 71, 400)] + ["MKKLLLLLLLLLLLLLLLAGAQAAAAAA" + "K" * 500]
    df = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(seqs)], "seq_id long, seq string, n long")
    for job in (I.signal_rules, L.signal_features, L.cut_windows):
        whole, cut = (sorted(map(str, job(x).collect())) for x in (df, I.first_letters(df)))
        assert whole == cut and whole


def test_left_out_forests_take_as_many_passes_for_many_folds(spark, monkeypatch):
    gen = np.random.default_rng(9)
    df = spark.createDataFrame([(f"g{k % 300}", k, int(gen.random() < 0.4 or k < 600 and k >= 300), float(gen.normal())) for k in range(3000)], "g string, i long, y int, a double").repartition(3)
    passes, count = [], FF._totals
    monkeypatch.setattr(FF, "_totals", lambda *a: passes.append(1) or count(*a))
    how = {"trees": 2, "depth": 2, "leaf": 5, "cuts": [np.array([-1.0, 0.0, 1.0])]}
    whole = {tuple(r) for r in FF.scores(df, "g", "i", "y", ["a"], **how).select("id_", "p_").collect()}
    assert len(passes) <= 2 and len(whole) > 2000
    assert whole == {tuple(r) for r in FF.scores(df, "g", "i", "y", ["a"], block=200, **how).select("id_", "p_").collect()} and len(passes) > 2
