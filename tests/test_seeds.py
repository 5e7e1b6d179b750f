"""The seed index and the arrays of found and true places, against plain Python."""

import random

from pyspark.sql import functions as F

from immunoscan.operators import evaluation as E
from immunoscan.operators import seeds as SD
from immunoscan.operators import tracks as T

rng = random.Random(3)
SEQS = [(i, "".join(rng.choice("ACDK") for _ in range(rng.randint(1, 400)))) for i in range(40)] + [(90, "A" * 300), (91, "ACDKACDK" * 40), (92, "A"), (93, None)]
PATTERNS = [(i, s[a : a + k]) for i, (s, a, k) in enumerate((SEQS[rng.randrange(40)][1], rng.randrange(300), rng.choice([1, 3, 5, 6, 7, 12, 30])) for _ in range(120))]
PATTERNS += [(500, "A" * 12), (501, "ACDKACDKACDK"), (502, "ACDKACDKACDK"), (503, ""), (504, None), (505, "WWWWWWWWWWWW"), (506, "A" * 299 + "C")]


def _places(s, p):
    return [i + 1 for i in range(len(s) - len(p) + 1) if s.startswith(p, i)]


def _tables(spark):
    seqs = spark.createDataFrame([(i, s, len(s) if s else 0) for i, s in SEQS], "seq_id long, seq string, n long").repartition(3)
    return seqs, spark.createDataFrame(PATTERNS, "pep_id long, pattern string")


def test_occurrences(spark):
    seqs, patterns = _tables(spark)
    want = sorted({(i, p, at) for i, s in SEQS if s for _, p in PATTERNS if p for at in _places(s, p)})
    for block in (500_000, 20):
        got = SD.occurrences(seqs, patterns, block=block).select("seq_id", "pattern", "start").collect()
        assert sorted(map(tuple, got)) == want
    assert SD.occurrences(seqs, patterns.where("pattern is null")).isEmpty() and SD.occurrences(seqs.where("seq is null"), patterns).isEmpty()


def test_grams_of_the_corpus_are_not_shuffled(spark):
    seqs, patterns = _tables(spark)
    plan = SD.occurrences(seqs, patterns)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert all("LeftOuter" in line for line in joins)  # the patterns' own grams with their counts; grams of sequences meet seeds by broadcast


def test_validated_and_spots(spark):
    seqs, patterns = _tables(spark)
    found = SD.occurrences(seqs, patterns).join(patterns, "pattern")
    got = SD.validated(found, "pep_id", F.col("first") + F.col("pep_id") % 5)
    want, covered = [], {}
    for i, s in SEQS:
        for k, p in PATTERNS:
            if s and p and p in s:
                first = s.index(p) + 1
                claim = first + k % 5
                exact = s[claim - 1 : claim - 1 + len(p)] == p
                at = claim if exact else first
                want.append((i, k, at, exact))
                covered.setdefault(i, set()).update(range(at, at + len(p)))
    assert sorted(map(tuple, got.select("seq_id", "pep_id", "at", "exact").collect())) == sorted(want)
    assert {r["seq_id"]: r["spots"] for r in SD.spots(got).collect()} == {i: sorted(v) for i, v in covered.items()}


def test_sweep_counts_each_threshold(spark):
    rows = [(1, 6, [0, 1, 2, 2, 0, 5], [2, 3, 6]), (2, 3, [0, 0, 0], [1])]
    got = E.sweep(spark.createDataFrame(rows, "seq_id long, n long, votes array<int>, spots array<int>"), range(1, 4)).collect()
    want = []
    for i, n, votes, spots in rows:
        for t in range(1, 4):
            called, true = {p + 1 for p in range(n) if votes[p] >= t}, set(spots)
            want.append((i, t, len(called & true), len(called - true), len(true - called), n - len(called | true)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_votes_carry_columns(spark):
    seqs = spark.createDataFrame([(1, "ACDEFGHIKLMNPQRSTVWY" * 3, 60, [4])], "seq_id long, seq string, n long, spots array<int>")
    row = T.vote_arrays(seqs, keep=["spots"]).first()
    assert row["spots"] == [4] and len(row["votes"]) == 60
