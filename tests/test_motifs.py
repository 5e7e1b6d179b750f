"""Motif places, merges and laid-out layers against plain Python, on texts of 100,000 letters too."""

import math
import random
import re
import time

import pytest

from immunoscan.functions import dims as D
from immunoscan.operators import innate as I
from immunoscan.operators import motifs as M
from immunoscan.plans.spatial import CPG

rng = random.Random(6)
LONG = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYKRKRLLL") for _ in range(100_000))
SEQS = [(1, LONG), (2, "RGDSRGDKGDSRGNF"), (3, "KRKRKR"), (4, "KK"), (5, "A"), (6, "KKKKKKKKKKKK" * 50), (7, "".join(rng.choice("AILKR") for _ in range(500)))]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(i, s, len(s)) for i, s in SEQS], "seq_id long, seq string, n long").repartition(4)


def _hits(pattern, s):
    return [(m.start() + 1, m.end(), m.group()) for m in re.finditer(pattern, s)]


def test_places_of_all_patterns(seqs):
    began = time.time()
    got = M.receptor_motifs(seqs).collect()
    assert time.time() - began < 60
    want = sorted((i, n, *h) for i, s in SEQS for n, p in M.PATTERNS.items() for h in _hits(p, s))
    assert sorted((r["seq_id"], r["name"], r["start"], r["end"], r["motif"]) for r in got) == want


def test_receptor_motifs_carry_their_notes(seqs):
    got = {(r["name"], r["annotation"]) for r in M.receptor_motifs(seqs).select("name", "annotation").distinct().collect()}
    assert len(got) >= 4 and got <= set(M.NOTES.items())


def test_cut_log_odds_of_sequences_that_end_at_the_cut(spark):
    """Places of the odds that lie beyond the last letter count 0."""
    rows = [(1, "A" * 15), (2, "W" * 15), (3, "G" * 16), (4, "L" * 40)]
    out = {r["seq_id"]: r for r in I.cut_log_odds(spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_id long, seq string, n long").repartition(2)).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert (out[1]["cut"], out[1]["log_odds"]) == (20, round(sum(math.log(v.get("A", 0.01) / 0.05) for o, v in D.CUT_SHARES.items() if 20 + o < 15), 6))


def test_variants_where_rgd_stands_are_left_out(seqs):
    got = {(r["seq_id"], r["name"], r["start"]) for r in M.stimulating_motifs(seqs).collect()}
    want = set()
    for i, s in SEQS:
        rgd = {h[0] for h in _hits(M.STIMULATING["rgd"], s)}
        want |= {(i, n, h[0]) for n, p in M.STIMULATING.items() for h in _hits(p, s) if not (n == "rgd_variant" and h[0] in rgd)}
    assert got == want


def test_suppressed_starts(spark):
    rows = [(1, "".join(rng.choice("ACGT") for _ in range(3000))), (2, "GTCGTT" * 30), (3, "CG"), (4, "AAA")]
    out = M.with_hits(spark.createDataFrame(rows, "seq_id long, seq string"), {"best": CPG, "plain": "CG"})
    got = {r["seq_id"]: sorted(r["s"]) for r in out.select("seq_id", M.suppressed(out["h_plain"], out["h_best"]).alias("s")).collect()}
    for i, s in rows:
        inside = {p for a, b, _ in _hits(CPG, s) for p in range(a, b + 1)}
        assert got[i] == sorted(a for a, _, _ in _hits("CG", s) if a not in inside)


def _fold(spans):
    now, out = None, []
    for x in spans:
        if now is None or x[0] > now[1]:
            if now is not None:
                out.append(now)
            now = x
        elif x[2] > now[2]:
            now = x
    return out + ([now] if now is not None else [])


def test_merge_equals_the_plain_fold(spark):
    lists = [[], [(1, 11, 5)], *[sorted((a, a + rng.randrange(1, 30), rng.randrange(9)) for a in rng.sample(range(5 * k), k)) for k in (2, 7, 40, 999, 5000)]]
    df = spark.createDataFrame([(i, [list(map(int, x)) for x in v]) for i, v in enumerate(lists)], "i int, raw array<array<int>>")
    df = df.selectExpr("i", "transform(raw, x -> named_struct('start', x[0], 'end', x[1], 'points', x[2])) as spans")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", I.merged("spans").alias("m")).collect()}
    assert got == {i: _fold(v) for i, v in enumerate(lists)}


def test_layers_sum_what_covers_a_residue(seqs):
    some = seqs.where("seq_id in (2, 6, 7)")
    n = {(r["seq_id"], r["pos"]): r["score"] for r in M.n_glycosylation(some).collect()}
    o = {(r["seq_id"], r["pos"]): r["score"] for r in I.o_glycosylation(some).collect()}
    cover = {}
    for r in M.receptor_motifs(some).collect():
        for p in range(r["start"], r["end"] + 1):
            cover.setdefault((r["seq_id"], p), []).append(r["score"])
    got = {(r["seq_id"], r["pos"]): r["score"] for r in I.consensus(some).collect()}
    assert len(got) == sum(len(s) for i, s in SEQS if i in (2, 6, 7))
    assert all(abs(v - 0.3 * (n.get(k, 0) + o.get(k, 0)) - 0.4 * sum(cover.get(k, []))) < 1e-9 for k, v in got.items())
    top = {(r["seq_id"], r["pos"]): r["receptor"] for r in I.dense(some).collect()}
    assert all(v == max(cover.get(k, [0.0])) for k, v in top.items())
