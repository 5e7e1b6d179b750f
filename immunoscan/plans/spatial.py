"""Registered queries over atoms, chains and nucleic sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import lookup_sql, milli
from ..operators import motifs as M
from ..operators import structure as S
from ..operators.structure import ANTIBODY, NOT_ANTIBODY
from ..sources import fixtures as X
from .oracle import CONTACTS, motif, sql

CPG = "[GAT]TCGTT|G[AT]CGTT|GTCG[AT]T"  # fixed value: optimal hexamers


def e5_cpg_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Optimal hexamers, and CG that doesn't start inside them."""
    out = M.with_hits(X.nucleic(spark, d).where("seq <> ''"), {"best": CPG, "plain": "CG"})
    best = F.transform("h_best", lambda h: F.struct(F.lit("cpg_optimal").alias("name"), h["start"].alias("start"), h["end"].alias("end"), h["motif"].alias("motif"), F.lit(0.9).alias("score")))
    plain = F.transform(M.suppressed(F.col("h_plain"), F.col("h_best")), lambda s: F.struct(F.lit("cpg_basic").alias("name"), s.alias("start"), (s + 1).alias("end"), F.lit("CG").alias("motif"), F.lit(0.4).alias("score")))
    return out.select("seq_id", F.inline(F.concat(best, plain)))


def f5_local_density(spark: SparkSession, d: str) -> DataFrame:
    return S.local_density(X.residues3d(spark, d)).select("structure_id", "idx", F.round("density", 9).alias("density"))


def f6_residue_depth(spark: SparkSession, d: str) -> DataFrame:
    return S.residue_depth(X.residues3d(spark, d)).select("structure_id", "idx", F.round("depth", 6).alias("depth"))


def f9_percentile_cut(spark: SparkSession, d: str) -> DataFrame:
    scored = S.surface_propensity(X.residues3d(spark, d))
    return scored.groupBy("structure_id").agg(F.round(F.coalesce(F.expr("percentile(score, 0.85)"), F.lit(float("inf"))), 6).alias("cut"))


def f13_gap_regions(spark: SparkSession, d: str) -> DataFrame:
    scored = S.surface_propensity(X.residues3d(spark, d)).withColumn("called", F.round("score", 9) >= F.round("cut", 9))
    return S.gap_regions(scored).select("structure_id", "start", "end", "above", *[F.round(c, 6).alias(c) for c in ("score", "x", "y", "z")])


def f18_chain_split(spark: SparkSession, d: str) -> DataFrame:
    return S.chain_split(X.chains(spark, d))


def f19_interface(spark: SparkSession, d: str) -> DataFrame:
    return S.interface(X.atoms(spark, d))


QUERIES = {f.__name__: f for f in (e5_cpg_motifs, f5_local_density, f6_residue_depth, f9_percentile_cut, f13_gap_regions, f18_chain_split, f19_interface)}

GAP2 = "(r.x-o.x)*(r.x-o.x)+(r.y-o.y)*(r.y-o.y)+(r.z-o.z)*(r.z-o.z)"
SCORED = f"scored AS (SELECT r.*, {lookup_sql('aa', milli('propensity'), 0)} / 1000e0 - 2e-2 * contacts + 35e-2 * ln(sasa + 1) AS score FROM residues3d r JOIN contacts c ON c.structure_id = r.structure_id AND c.idx = r.idx)"
IS_ANTIBODY = "(" + " OR ".join(f"contains(lower(description), '{w}')" for w in ANTIBODY) + ")" + "".join(f" AND NOT contains(lower(description), '{w}')" for w in NOT_ANTIBODY)


def _centre(c: str) -> str:
    return f"round(CASE WHEN count({c}) = count(*) THEN avg({c}) END, 6) AS {c}"


ORACLES = {
    "e5_cpg_motifs": f"""WITH sequences AS (SELECT doc_id AS seq_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g') AS seq FROM documents),
best AS ({motif('cpg_optimal', CPG)}), plain AS ({motif('cpg_basic', 'CG')}), covered AS (SELECT DISTINCT seq_id, unnest(range("start", "end" + 1)) AS pos FROM best)
SELECT seq_id, name, "start", "end", motif, 9e-1 AS score FROM best UNION ALL SELECT p.seq_id, name, "start", "end", motif, 4e-1 FROM plain p ANTI JOIN covered c ON c.seq_id = p.seq_id AND c.pos = p."start" """,
    "f5_local_density": sql(f"SELECT r.structure_id, r.idx, round((count(o.idx) + 1) / (4e0 / 3 * pi() * 1000), 9) AS density FROM residues3d r LEFT JOIN residues3d o ON r.structure_id = o.structure_id AND {GAP2} > 0 AND sqrt({GAP2}) < 10 GROUP BY r.structure_id, r.idx", "residues3d"),
    "f6_residue_depth": sql(f"SELECT r.structure_id, r.idx, round(sqrt(min({GAP2})), 6) AS depth FROM residues3d r JOIN residues3d o ON r.structure_id = o.structure_id AND o.sasa >= 60 AND o.x IS NOT NULL WHERE r.x IS NOT NULL GROUP BY r.structure_id, r.idx", "residues3d"),
    "f9_percentile_cut": sql("SELECT structure_id, round(quantile_cont(score, 0.85), 6) AS cut FROM scored GROUP BY structure_id", "residues3d", CONTACTS, SCORED),
    "f13_gap_regions": sql(
        f"""SELECT structure_id, "start", "end", above, round(avg(score), 6) AS score, {_centre('x')}, {_centre('y')}, {_centre('z')} FROM (
 SELECT g.*, s.score, s.x, s.y, s.z FROM (SELECT structure_id, min(idx) AS "start", max(idx) AS "end", count(*) AS above FROM (
 SELECT *, sum(CASE WHEN idx - before > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY structure_id ORDER BY idx) AS run FROM (
 SELECT structure_id, idx, lag(idx) OVER (PARTITION BY structure_id ORDER BY idx) AS before FROM (SELECT *, quantile_cont(score, 0.85) OVER (PARTITION BY structure_id) AS cut FROM scored) WHERE round(score, 9) >= round(cut, 9)))
 GROUP BY structure_id, run HAVING count(*) >= 3) g JOIN scored s ON s.structure_id = g.structure_id AND s.idx BETWEEN g."start" AND g."end") GROUP BY structure_id, "start", "end", above""",
        "residues3d", CONTACTS, SCORED,
    ),
    "f18_chain_split": sql(f"""SELECT structure_id, antibodies, best.chain_id AS antigen_id, best.length AS length FROM (SELECT structure_id, string_agg(chain_id, ',' ORDER BY chain_id) FILTER ({IS_ANTIBODY}) AS antibodies,
 max(CASE WHEN NOT ({IS_ANTIBODY}) AND length >= 50 THEN {{'length': length, 'chain_id': chain_id}} END) AS best FROM chains GROUP BY structure_id) WHERE antibodies IS NOT NULL AND best IS NOT NULL""", "chains"),
    "f19_interface": sql(
        f"SELECT structure_id, idx FROM (SELECT *, count(*) OVER (PARTITION BY structure_id) AS k FROM (SELECT DISTINCT r.structure_id, r.idx FROM atoms r JOIN atoms o ON r.structure_id = o.structure_id AND r.chain_id = 'A' AND o.chain_id = 'H' AND sqrt({GAP2}) <= 4)) WHERE k >= 4", "residues3d", "atoms"
    ),
}
