"""Registered queries of glycosylation, motifs and signal peptides, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions.dims import lookup_sql
from ..operators import innate as I
from ..operators import motifs as M
from ..sources import fixtures as X
from .oracle import GLYCO, R, motif, sql


def e2_o_glycosylation(spark: SparkSession, d: str) -> DataFrame:
    return I.o_glycosylation(X.sequences(spark, d))


def e3_signal_rules(spark: SparkSession, d: str) -> DataFrame:
    return I.signal_rules(X.sequences(spark, d)).withColumn("cleavage_position", F.col("cleavage_position").cast("double"))


def e4_motifs(spark: SparkSession, d: str) -> DataFrame:
    return M.receptor_motifs(X.sequences(spark, d))


def e6_stimulating_motifs(spark: SparkSession, d: str) -> DataFrame:
    return M.stimulating_motifs(X.sequences(spark, d))


def e7_helix_windows(spark: SparkSession, d: str) -> DataFrame:
    return I.helices(X.sequences(spark, d), merge=False).select("seq_id", "start", "end", "score")


def e8_merged_helices(spark: SparkSession, d: str) -> DataFrame:
    return I.helices(X.sequences(spark, d))


def e9_innate_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.summary(X.sequences(spark, d))


def e10_innate_consensus(spark: SparkSession, d: str) -> DataFrame:
    return I.consensus(X.sequences(spark, d)).select("seq_id", "pos", F.round("score", 6).alias("score"))


def e11_dense_tracks(spark: SparkSession, d: str) -> DataFrame:
    return I.dense(X.sequences(spark, d))


def e12_cut_sites(spark: SparkSession, d: str) -> DataFrame:
    return I.cut_sites(X.sequences(spark, d).where("n >= 16")).select("seq_id", F.col("cut").cast("long").alias("cut"), "cut_score")


def e13_axa(spark: SparkSession, d: str) -> DataFrame:
    return I.axa(X.sequences(spark, d))


def e14_stretches(spark: SparkSession, d: str) -> DataFrame:
    return I.stretches(X.sequences(spark, d))


def e15_segments(spark: SparkSession, d: str) -> DataFrame:
    return I.segments(X.sequences(spark, d))


def e16_cut_log_odds(spark: SparkSession, d: str) -> DataFrame:
    return I.cut_log_odds(X.sequences(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        e2_o_glycosylation, e3_signal_rules, e4_motifs, e6_stimulating_motifs, e7_helix_windows, e8_merged_helices, e9_innate_summary,
        e10_innate_consensus, e11_dense_tracks, e12_cut_sites, e13_axa, e14_stretches, e15_segments, e16_cut_log_odds,
    )
}


def _in(letter: str, kinds: str) -> str:
    return f"coalesce({letter} IN ({', '.join(repr(k) for k in kinds)}), false)"


def _three(c: str) -> str:
    return f"CAST(round(CAST({c} AS DECIMAL(18, 9)), 3) AS DOUBLE)"


_o = [D.O_GLYCO.get(a, 0) for a in D.AA]
O_SITES = f"""near_o AS (SELECT *, sum({lookup_sql('aa', _o, 0)}) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) - {lookup_sql('aa', _o, 0)} AS around, lag(aa) OVER w AS p1, lead(aa, 3) OVER w AS n3,
 concat(coalesce(lag(aa, 2) OVER w, ''), coalesce(lag(aa) OVER w, ''), aa, coalesce(lead(aa) OVER w, ''), coalesce(lead(aa, 2) OVER w, '')) AS motif FROM residues WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
points_o AS (SELECT *, CAST(greatest(0, least(10000, (500 + around + CASE WHEN p1 = 'P' THEN 250 ELSE 0 END + CASE WHEN n3 = 'P' THEN 200 ELSE 0 END) * CASE aa WHEN 'T' THEN 11 ELSE 10 END)) AS BIGINT) AS points FROM near_o WHERE aa IN ('S', 'T')),
o_sites AS (SELECT seq_id, pos, CAST((points + 5) // 10 AS DOUBLE) / 1000 AS score, motif, CASE WHEN points >= 7000 THEN 'high' WHEN points >= 5000 THEN 'medium' ELSE 'low' END AS site_type FROM points_o WHERE (points + 5) // 10 >= 400)"""
_ch = lambda p: f"substr(seq, {p}, 1)"
SIGNAL = f"""head32 AS (SELECT seq_id, n, substr(seq, 1, 32) AS seq FROM sequences),
cand AS (SELECT seq_id, max(struct_pack(c := c, p := -p)) AS b FROM (SELECT seq_id, p, CASE WHEN {_ch('p')} = 'A' THEN 40 WHEN {_in(_ch('p'), D.CLEAVABLE)} THEN 25 ELSE 0 END + CASE WHEN {_ch('p - 2')} = 'A' THEN 30 WHEN {_in(_ch('p - 2'), D.CLEAVABLE)} THEN 20 ELSE 0 END
 - CASE WHEN {_in(_ch('p'), D.BASIC + D.ACIDIC)} THEN 30 ELSE 0 END + CASE WHEN {_in(_ch('p - 1'), 'GP')} THEN 10 ELSE 0 END AS c FROM (SELECT seq_id, seq, unnest(range(15, least(30, n - 1) + 1)) AS p FROM head32)) WHERE c > 0 GROUP BY seq_id),
scores3 AS (SELECT h.seq_id, n, b, least(10, least(10, 4 * (SELECT count(*) FROM (SELECT unnest(range(1, 6)) AS q) WHERE {_in(_ch('q'), D.BASIC)})) + CASE WHEN {_in(_ch('2'), D.BASIC)} THEN 2 ELSE 0 END) / 10e0 AS ns,
 greatest(0e0, least(1e0, (CAST(list_sum(list_transform(range(6, least(n, 20) + 1), lambda q: {lookup_sql(_ch('q'), D.HYDROPATHY, 0)})) AS DOUBLE) / (10 * (least(n, 20) - 5)) + 1) / 4)) AS hs, least(1e0, coalesce(b.c, 0) / 100e0) AS cs FROM head32 h LEFT JOIN cand ON cand.seq_id = h.seq_id),
judged AS (SELECT *, ns * 2e-1 + hs * 5e-1 + cs * 3e-1 AS conf FROM scores3),
signal AS (SELECT seq_id, n, n >= 15 AND round(conf, 9) >= 5e-1 AND round(hs, 9) >= 3e-1 AND b IS NOT NULL AS is_signal, CASE WHEN n >= 15 AND round(conf, 9) >= 5e-1 AND round(hs, 9) >= 3e-1 AND b IS NOT NULL THEN CAST(1 - b.p AS BIGINT) END AS cleavage_position,
 CASE WHEN n >= 15 THEN {_three('conf')} ELSE 0 END AS confidence, CASE WHEN n >= 15 THEN {_three('ns')} ELSE 0 END AS n_score, CASE WHEN n >= 15 THEN {_three('hs')} ELSE 0 END AS h_score, CASE WHEN n >= 15 THEN {_three('cs')} ELSE 0 END AS c_score FROM judged)"""


def _scored(name: str, pattern: str, score: str, more: str = "") -> str:
    return f"SELECT *, {score} AS score{more} FROM ({motif(name, pattern)})"


RECEPTOR = "receptor AS (" + " UNION ALL ".join(_scored(n, p, str(M.SCORES[n]) + "::DOUBLE" if n in M.SCORES else "round(5e-1 + 1e-1 * least(length(motif) - 3, 3), 6)", f", '{M.NOTES[n]}' AS annotation") for n, p in M.PATTERNS.items()) + ")"
_stim = {"rgd": "CASE WHEN length(motif) > 3 THEN 8e-1 ELSE 7e-1 END", "basic_patch": "round(least(9e-1, 5e-1 + 1e-1 * length(motif)), 6)"}
STIMULATING = "stimulating AS (" + " UNION ALL ".join(_scored(n, p, _stim.get(n, f"{M.STIMULATING_SCORES.get(n)}::DOUBLE")) + (""" o WHERE NOT EXISTS (SELECT 1 FROM rgds g WHERE g.seq_id = o.seq_id AND g."start" = o."start")""" if n == "rgd_variant" else "") for n, p in M.STIMULATING.items()) + ")"
RGDS = f"rgds AS ({motif('rgd', M.STIMULATING['rgd'])})"
_face = lambda kinds, places: " + ".join(f"CAST({_in(f'substr(seq, i + {p}, 1)', kinds)} AS INT)" for p in places)
HELICES = f"""helices AS (SELECT seq_id, "start", "start" + 10 AS "end", substr(seq, "start", 11) AS motif, points FROM (SELECT seq_id, seq, i AS "start", 6 * ({_face(D.HYDROPHOBIC, (0, 3, 4, 7, 8))}) + 5 * ({_face(D.POLAR + D.BASIC + D.ACIDIC, (1, 2, 5, 6, 9, 10))}) AS points
 FROM (SELECT seq_id, seq, unnest(range(1, n - 9)) AS i FROM sequences)) WHERE points >= 36)"""
# a fold over each sequence's windows: the window at hand, and those that stay
MERGED = """folded AS (SELECT seq_id, list_reduce(list(struct_pack(s := "start", p := points, kept := []::BIGINT[][]) ORDER BY "start"), lambda a, x: CASE WHEN x.s > a.s + 10 THEN struct_pack(s := x.s, p := x.p, kept := list_append(a.kept, [a.s, a.p]))
 WHEN x.p > a.p THEN struct_pack(s := x.s, p := x.p, kept := a.kept) ELSE a END) AS f FROM helices GROUP BY seq_id),
merged_helices AS (SELECT seq_id, m[1] AS "start", m[1] + 10 AS "end", m[2] AS points FROM (SELECT seq_id, unnest(list_append(f.kept, [f.s, f.p])) AS m FROM folded))"""
HEADS = "heads AS (SELECT seq_id, substr(seq, 1, 70) AS seq, least(n, 70) AS n FROM sequences)"
_hydro = lambda a, b: f"coalesce(list_sum(list_transform(range({a}, {b}), lambda q: {lookup_sql(_ch('q'), D.HYDROPATHY, 0)})), 0)"
CUTS = f"""cut_points AS (SELECT seq_id, p, CASE WHEN {_ch('p')} = 'A' THEN 20 WHEN {_in(_ch('p'), 'GSC')} THEN 15 WHEN {_in(_ch('p'), 'TV')} THEN 5 ELSE 0 END + CASE WHEN {_ch('p - 2')} = 'A' THEN 15 WHEN {_in(_ch('p - 2'), 'GSCVLI')} THEN 10 WHEN {_in(_ch('p - 2'), 'TF')} THEN 3 ELSE 0 END
 - CASE WHEN {_in(_ch('p - 1'), 'PG')} THEN 5 ELSE 0 END + CASE WHEN p >= 10 AND p < n - 5 AND {_hydro('p - 9', 'p - 2')} > 105 AND 7 * {_hydro('p + 1', 'p + 6')} < 5 * {_hydro('p - 9', 'p - 2')} THEN 10 ELSE 0 END AS c FROM (SELECT seq_id, seq, n, unnest(range(15, least(35, n - 1) + 1)) AS p FROM heads)),
cuts AS (SELECT h.seq_id, seq, n, coalesce(-b.p, 20) AS cut, b.c / 10e0 AS cut_score FROM heads h LEFT JOIN (SELECT seq_id, max(struct_pack(c := c, p := -p)) AS b FROM cut_points GROUP BY seq_id) m ON m.seq_id = h.seq_id)"""


def _stretch(source: str, limit: str) -> str:
    return f"""stretch AS (SELECT seq_id, max(struct_pack(c := c, w := -w, s := -s)) AS b FROM (SELECT seq_id, w, s, {_hydro('s', 's + w')} AS c FROM (SELECT seq_id, seq, w, unnest(range(1, least(n, {limit}) - w + 2)) AS s FROM {source} CROSS JOIN (SELECT unnest(range(7, 16)) AS w))) WHERE c >= 10 * w GROUP BY seq_id)"""


_axa = f"""CASE WHEN {_ch('i')} = 'A' THEN 10 WHEN {_in(_ch('i'), D.SMALL)} THEN 7 WHEN {_in(_ch('i'), 'VLI')} THEN 3 ELSE 0 END + CASE WHEN {_ch('i + 2')} = 'A' THEN 12 WHEN {_in(_ch('i + 2'), D.SMALL)} THEN 8 ELSE 0 END + CASE WHEN {_ch('i')} = 'A' AND {_ch('i + 2')} = 'A' THEN 5 ELSE 0 END"""
_odds = " + ".join(f"CASE WHEN cut + {o + 1} <= n THEN ([{', '.join(repr(math.log(v / 0.05)) + '::DOUBLE' for v in (0.01, *(shares.get(a, 0.01) for a in D.AA)))}])[instr('{D.AA}', {_ch(f'cut + {o + 1}')}) + 1] ELSE 0 END" for o, shares in D.CUT_SHARES.items())

ORACLES = {
    "e2_o_glycosylation": sql("SELECT seq_id, pos, score, motif, site_type FROM o_sites", *R, O_SITES),
    "e3_signal_rules": sql("SELECT seq_id, is_signal, CAST(cleavage_position AS DOUBLE) AS cleavage_position, confidence, n_score, h_score, c_score FROM signal", "sequences", SIGNAL),
    "e4_motifs": sql("SELECT * FROM receptor", "sequences", RECEPTOR),
    "e6_stimulating_motifs": sql("SELECT * FROM stimulating", "sequences", RGDS, STIMULATING),
    "e7_helix_windows": sql('SELECT seq_id, "start", "end", round(CAST(points AS DOUBLE) / 60, 3) AS score FROM helices', "sequences", HELICES),
    "e8_merged_helices": sql('SELECT m.seq_id, "start", "end", substr(seq, "start", 11) AS motif, round(CAST(points AS DOUBLE) / 60, 3) AS score FROM merged_helices m JOIN sequences s ON s.seq_id = m.seq_id', "sequences", HELICES, MERGED),
    "e9_innate_summary": sql(
        """SELECT s.seq_id, s.n, is_signal, confidence, coalesce(g.a, 0) AS n_sites, coalesce(g.b, 0) AS canonical, coalesce(o.a, 0) AS o_sites, coalesce(o.b, 0) AS high_o, coalesce(r.a, 0) AS receptor_motifs, coalesce(t.a, 0) AS stimulating_motifs, coalesce(t.b, false) AS has_rgd FROM sequences s JOIN signal i ON i.seq_id = s.seq_id
 LEFT JOIN (SELECT seq_id, count(*) AS a, count(*) FILTER (site_type = 'canonical') AS b FROM glyco GROUP BY seq_id) g ON g.seq_id = s.seq_id LEFT JOIN (SELECT seq_id, count(*) AS a, count(*) FILTER (site_type = 'high') AS b FROM o_sites GROUP BY seq_id) o ON o.seq_id = s.seq_id
 LEFT JOIN (SELECT seq_id, count(*) AS a FROM receptor GROUP BY seq_id) r ON r.seq_id = s.seq_id LEFT JOIN (SELECT seq_id, count(*) AS a, bool_or(contains(motif, 'RGD')) AS b FROM (SELECT seq_id, motif FROM stimulating UNION ALL SELECT m.seq_id, substr(seq, "start", 11) FROM merged_helices m JOIN sequences q ON q.seq_id = m.seq_id) GROUP BY seq_id) t ON t.seq_id = s.seq_id""",
        *R, GLYCO, O_SITES, SIGNAL, RECEPTOR, RGDS, STIMULATING, HELICES, MERGED,
    ),
    "e10_innate_consensus": sql("""SELECT seq_id, pos, round(sum(v), 6) AS score FROM (SELECT seq_id, pos, 3e-1 * score AS v FROM glyco UNION ALL SELECT seq_id, pos, 3e-1 * score FROM o_sites UNION ALL SELECT seq_id, unnest(range("start", "end" + 1)), 4e-1 * score FROM receptor UNION ALL SELECT seq_id, pos, 0 FROM residues) GROUP BY seq_id, pos""", *R, GLYCO, O_SITES, RECEPTOR),
    "e11_dense_tracks": sql(
        """SELECT r.seq_id, r.pos, coalesce(g.score, 0) AS n_glyco, coalesce(o.score, 0) AS o_glyco, coalesce(t.score, 0) AS receptor, CASE WHEN is_signal AND r.pos <= cleavage_position THEN confidence ELSE 0 END AS signal FROM residues r JOIN signal i ON i.seq_id = r.seq_id
 LEFT JOIN glyco g ON g.seq_id = r.seq_id AND g.pos = r.pos LEFT JOIN o_sites o ON o.seq_id = r.seq_id AND o.pos = r.pos LEFT JOIN (SELECT seq_id, pos, max(score) AS score FROM (SELECT seq_id, score, unnest(range("start", "end" + 1)) AS pos FROM receptor) GROUP BY seq_id, pos) t ON t.seq_id = r.seq_id AND t.pos = r.pos""",
        *R, GLYCO, O_SITES, SIGNAL, RECEPTOR,
    ),
    "e12_cut_sites": sql("SELECT seq_id, CAST(cut AS BIGINT) AS cut, cut_score FROM cuts WHERE n >= 16", "sequences", HEADS, CUTS),
    "e13_axa": sql(f"SELECT h.seq_id, round(coalesce(CAST(c AS DOUBLE), 0) / 27, 6) AS axa FROM heads h LEFT JOIN (SELECT seq_id, max({_axa}) AS c FROM (SELECT seq_id, seq, unnest(range(16, least(30, n) - 1)) AS i FROM heads) GROUP BY seq_id) m ON m.seq_id = h.seq_id", "sequences", HEADS),
    "e14_stretches": sql("SELECT h.seq_id, coalesce(-b.s - 1, 0) AS start, coalesce(-b.w, 0) AS length, round(coalesce(CAST(b.c AS DOUBLE) / (-10 * b.w), 0), 6) AS mean FROM heads h LEFT JOIN stretch t ON t.seq_id = h.seq_id", "sequences", HEADS, _stretch("heads", "40")),
    "e15_segments": sql(
        "SELECT c.seq_id, cut, CAST(1 AS BIGINT) AS n_start, n_end, coalesce(-b.s, n_end + 1) AS h_start, coalesce(-b.s - b.w - 1, cut - 5) AS h_end, coalesce(-b.s - b.w - 1, cut - 5) + 1 AS c_start, cut AS c_end FROM (SELECT *, CASE WHEN cut > 15 THEN least(5, cut - 10) ELSE 3 END AS n_end FROM cuts WHERE n >= 15) c LEFT JOIN stretch t ON t.seq_id = c.seq_id", "sequences", HEADS, CUTS, _stretch("cuts", "cut")
    ),
    "e16_cut_log_odds": sql(f"SELECT seq_id, cut, round({_odds}, 6) AS log_odds FROM cuts WHERE n >= 15", "sequences", HEADS, CUTS),
}
