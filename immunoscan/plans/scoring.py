"""Registered queries of evaluation, controls and roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assays as A
from ..operators import evaluation as E
from ..operators import structure as S
from ..operators import tracks as T
from ..sources import fixtures as X
from ..sources import sinks
from .oracle import CLAIMS, CONTACTS, COUNTS, G, PROTRUSION, VOTES, sql

FEATURES = {"sasa": 1, "protrusion": 1, "contacts": -1}


def a8_epitope_rows(spark: SparkSession, d: str) -> DataFrame:
    """The epitopes written as tab-separated files and read again."""
    return sinks.read_epitopes(spark, sinks.write_epitopes(T.regions(X.sequences(spark, d))))


def f1_residue_rollup(spark: SparkSession, d: str) -> DataFrame:
    res = X.residues3d(spark, d)
    kinds = F.explode(F.array(F.struct(F.lit("CA").alias("atom"), F.lit(0.0).alias("dx"), F.lit(1.0).alias("part")), F.struct(F.lit("CB").alias("atom"), F.lit(1.5).alias("dx"), F.lit(3.0).alias("part"))))
    known = F.when(F.col("k.atom") == "CB", F.col("bfactor") + 10).when(F.col("idx") % 41 != 0, F.col("bfactor"))
    atoms = res.withColumn("k", kinds).select("structure_id", "chain_id", "idx", "k.atom", (F.col("x") + F.col("k.dx")).alias("x"), "y", "z", (F.col("sasa") / F.col("k.part")).alias("area"), known.alias("bfactor"))
    return E.residue_rollup(atoms).select("structure_id", "chain_id", "idx", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "sasa", "bfactor")])


def f20_chain_sequences(spark: SparkSession, d: str) -> DataFrame:
    res = X.residues3d(spark, d)
    return E.chain_sequences(res, res.where("sasa >= 100"))


def g17_z_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.z_scores(X.residues3d(spark, d), "structure_id", ["sasa", "bfactor", "x"]).select("structure_id", "idx", *[F.round(c, 6).alias("z_" + c) for c in ("sasa", "bfactor", "x")])


def i3_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    from .catalogue import with_truth

    return A.rates(E.sweep(T.vote_arrays(with_truth(spark, d), keep=["spots"]))).select("seq_id", "threshold", "tp", "fp", "fn", "tn", "sens", "spec")


def i7_single_features(spark: SparkSession, d: str) -> DataFrame:
    res = S.contact_number(S.protrusion(X.residues3d(spark, d))).withColumn("truth", F.col("chain_id") == "H")
    return E.median_controls(res.withColumn("protrusion", F.round("protrusion", 9)), "truth", FEATURES)


def i9_ranking(spark: SparkSession, d: str) -> DataFrame:
    from .catalogue import QUERIES as ALL

    return E.ranking(ALL["i2_method_rates"](spark, d), "method", "f1")


def i10_histogram(spark: SparkSession, d: str) -> DataFrame:
    from .catalogue import QUERIES as ALL

    return E.histogram(ALL["c4_coverage"](spark, d), "method", "coverage")


QUERIES = {f.__name__: f for f in (a8_epitope_rows, f1_residue_rollup, f20_chain_sequences, g17_z_scores, i3_threshold_sweep, i7_single_features, i9_ranking, i10_histogram)}

COVERAGE = "coverage AS (SELECT method, round(100 * CAST(sum(length) AS DOUBLE) / n, 6) AS v FROM regions r JOIN sequences s ON s.seq_id = r.seq_id GROUP BY r.seq_id, method, n)"


def _z(c: str) -> str:
    return f"round(coalesce(CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END, 0), 6) AS z_{c}"


def _control(f: str, test: str) -> str:
    called = f"coalesce({test} (SELECT median({f}) FROM feats i WHERE i.structure_id = o.structure_id), false)"
    return f"SELECT structure_id, '{f}' AS feature, chain_id = 'H' AS t, {called} AS c FROM feats o"


ORACLES = {
    "a8_epitope_rows": sql('SELECT seq_id, method, "start", "end", peptide AS sequence, CAST(round(CAST(score AS DECIMAL(18, 9)), 3) AS DOUBLE) AS score FROM regions', *G),
    "f1_residue_rollup": sql("SELECT structure_id, chain_id, idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(sasa + sasa / 3e0, 6) AS sasa, round(CASE WHEN idx % 41 = 0 THEN bfactor + 10 ELSE bfactor END, 6) AS bfactor FROM residues3d", "residues3d"),
    "f20_chain_sequences": sql("SELECT structure_id, chain_id, string_agg(aa, '' ORDER BY idx) AS seq, count(*) AS n FROM residues3d GROUP BY structure_id, chain_id HAVING count(*) >= 6 AND max(sasa) >= 100", "residues3d"),
    "g17_z_scores": sql(f"SELECT structure_id, idx, {_z('sasa')}, {_z('bfactor')}, {_z('x')} FROM residues3d WINDOW w AS (PARTITION BY structure_id)", "residues3d"),
    "i3_threshold_sweep": sql(
        """SELECT seq_id, threshold, tp, fp, fn, tn, round(tp / (tp + fn), 6) AS sens, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS spec FROM (
 SELECT v.seq_id, threshold, count(*) FILTER (votes >= threshold AND t.pos IS NOT NULL) AS tp, count(*) FILTER (votes >= threshold AND t.pos IS NULL) AS fp, count(*) FILTER (votes < threshold AND t.pos IS NOT NULL) AS fn, count(*) FILTER (votes < threshold AND t.pos IS NULL) AS tn
 FROM votes v SEMI JOIN known k ON k.seq_id = v.seq_id LEFT JOIN truth t ON t.seq_id = v.seq_id AND t.pos = v.pos CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS threshold) GROUP BY v.seq_id, threshold)""",
        *G, VOTES, "ref_peptides", CLAIMS, COUNTS,
    ),
    "i7_single_features": sql(
        "SELECT structure_id, feature, count(*) FILTER (c AND t) AS tp, count(*) FILTER (NOT c AND t) AS fn, count(*) FILTER (c AND NOT t) AS fp, count(*) FILTER (NOT c AND NOT t) AS tn FROM ("
        + " UNION ALL ".join(_control(f, f"{f} {'>=' if sign > 0 else '<='}") for f, sign in FEATURES.items()) + ") GROUP BY structure_id, feature",
        "residues3d", CONTACTS, PROTRUSION, "feats AS (SELECT p.structure_id, p.idx, chain_id, sasa, round(protrusion, 9) AS protrusion, contacts FROM protruding p JOIN contacts c ON c.structure_id = p.structure_id AND c.idx = p.idx)",
    ),
    "i9_ranking": sql(
        "SELECT method, f1, row_number() OVER (ORDER BY f1 DESC, method) AS rank FROM (SELECT method, round(avg(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)), 4) AS f1 FROM counts GROUP BY method)", *G, "ref_peptides", CLAIMS, COUNTS
    ),
    "i10_histogram": sql(
        """SELECT e.method, mean, median, b.bin, coalesce(n, 0) AS n FROM ends e CROSS JOIN (SELECT unnest(range(0, 16)) AS bin) b LEFT JOIN (
 SELECT c.method, CAST(least(15, floor((v - lo) / (hi - lo) * 16)) AS BIGINT) AS bin, count(*) AS n FROM coverage c JOIN ends e ON e.method = c.method GROUP BY ALL) h ON h.method = e.method AND h.bin = b.bin""",
        *G, COVERAGE, "ends AS (SELECT method, CASE WHEN min(v) = max(v) THEN min(v) - 5e-1 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 5e-1 ELSE max(v) END AS hi, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM coverage GROUP BY method)",
    ),
}
