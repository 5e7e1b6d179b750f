"""Dense tracks and processing scores: worked out in the tasks, the same as plain Python on short and long sequences."""

import random

from immunoscan.functions import matrices as MX
from immunoscan.functions.dims import AA
from immunoscan.operators import innate, tcell

rng = random.Random(17)
TEXTS = ["A", "ACDEFGHI", "ACDEFGHIK", "ACDEFGHIKLMN", "ACDEFGHIKLMNP", "AAAAAAAAAAAAAAAAAAAA", "MKRLLLLLLLLLLLLLALAASAQAPSTNGT" * 2, *["".join(rng.choice(AA) for _ in range(n)) for n in (14, 60, 500)]]


def _seqs(spark):
    return spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(TEXTS)], "seq_id long, seq string, n long").repartition(4)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _windows(text, matrix):
    return [sum(p[1 + AA.index(c)] for p, c in zip(matrix, text[i:], strict=False)) for i in range(len(text) - len(matrix) + 1)]


def _unit(values):
    low, high = min(values), max(values)
    return [(v - low) / (high - low) if high > low else 0.5 for v in values]


def test_processing_is_that_of_plain_python(spark):
    allele = next(iter(MX.CLASS_ONE))
    df = tcell.processing(_seqs(spark), allele)
    assert "MapInArrow" in _plan(df) and "posexplode" not in _plan(df)
    got = {(r["seq_id"], r["start"]): (r["combined"], r["called"]) for r in df.collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        if len(t) >= 9:
            cuts = _windows(t, MX.sparse(MX.CLEAVAGE, -6, 6))
            ends = [cuts[s + 2] if s + 2 < len(cuts) else 0 for s in range(len(t) - 8)]
            for s, (m, b, c) in enumerate(zip(_unit(_windows(t, MX.anchored(MX.CLASS_ONE[allele]))), _unit(_windows(t, MX.transport(9))), _unit(ends), strict=True)):
                want[i, s + 1] = 0.6 * m + 0.2 * b + 0.2 * c
    assert set(got) == set(want) and all(abs(got[k][0] - v) < 6e-7 and got[k][1] == (round(v, 9) >= 0.5) for k, v in want.items())


def test_dense_tracks_agree_with_the_single_ones(spark):
    seqs = _seqs(spark)
    df = innate.dense(seqs)
    assert "MapInArrow" in _plan(df)
    got = {(r["seq_id"], r["pos"]): (r["n_glyco"], r["o_glyco"], r["receptor"], r["signal"]) for r in df.collect()}
    assert set(got) == {(i, p + 1) for i, t in enumerate(TEXTS) for p in range(len(t))}
    o = {(r["seq_id"], r["pos"]): r["score"] for r in innate.o_glycosylation(seqs).collect()}
    signal = {r["seq_id"]: (r["cleavage_position"] or 0, r["confidence"]) for r in innate.signal_rules(seqs).collect()}
    assert any(upto for upto, _ in signal.values())
    assert all(v[1] == o.get(k, 0.0) and v[3] == (signal[k[0]][1] if k[1] <= signal[k[0]][0] else 0.0) for k, v in got.items())
