"""Registered queries of binding, cleavage and transport, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..operators import assays as A
from ..operators import evaluation as E
from ..operators import peptides as P
from ..operators import tcell as T
from ..sources import fixtures as X
from .oracle import AFFINITY, CLEAN, R, sql

ONE, TWO = list(M.CLASS_ONE), list(M.CLASS_TWO)
SHORT = {a: a.split("-")[1].replace("*", "").replace(":", "").lower() for a in [*ONE, *M.PREFERENCE]}


def d4_matrix_scores(spark: SparkSession, d: str) -> DataFrame:
    out = T.class_one(X.sequences(spark, d), ONE)
    each = T.exploded(out, **{SHORT[a]: F.col(f"`{a}`") for a in ONE})
    return each.select("seq_id", "start", *[T.milli(SHORT[a]).alias(SHORT[a]) for a in ONE])


def d5_adapted_lengths(spark: SparkSession, d: str) -> DataFrame:
    """All windows of 8, 10 and 11 letters: how many, and the sum and the greatest of their scores."""
    out, parts = X.sequences(spark, d), []
    out = T.letters(out)
    for k in (8, 10, 11):
        out = out.withColumn(f"s{k}", M.window_scores("code", M.anchored(M.CLASS_ONE[ONE[0]], k)))
        s = F.col(f"s{k}")
        parts.append(F.struct(F.lit(k).cast("long").alias("k"), F.size(s).cast("long").alias("windows"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(s).cast("long").alias("best")))
    return out.select("seq_id", F.inline(F.array(*parts))).where("windows > 0")


def d8_binders(spark: SparkSession, d: str) -> DataFrame:
    return T.binders(X.sequences(spark, d), "HLA-A*02:01")


def d9_best_cores(spark: SparkSession, d: str) -> DataFrame:
    out = T.best_cores(X.sequences(spark, d), TWO)
    return out.select("seq_id", "start", *[c for n in range(2) for c in (F.col(f"core_{n}").alias(f"core_{SHORT[TWO[n]]}"), T.milli(f"score_{n}").alias(f"score_{SHORT[TWO[n]]}"))])


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return X.assays(spark, d).select("rec_id", "peptide")


def d10_preferred_cores(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for a in M.PREFERENCE:
        part = T.preferred_core(_pieces(spark, d), a).select("rec_id", F.lit(a).alias("allele"), "core", F.col("core_start").cast("double").alias("core_start"), "score", "flank_n", "flank_c", "error")
        out = part if out is None else out.unionByName(part)
    return out


def d11_preference_levels(spark: SparkSession, d: str) -> DataFrame:
    return T.preferred_core(_pieces(spark, d), "HLA-DRB1*01:01").where("error is null").select("rec_id", "ic50", "level")


def d12_three_anchor_cores(spark: SparkSession, d: str) -> DataFrame:
    pieces = P.kmers(X.sequences(spark, d), 15, P.stride(15, 1)).select("seq_id", "start", "peptide")
    return T.three_anchor_core(pieces, "HLA-DRB1*04:01").select("seq_id", "start", "core", "position")


def _alleles(spark: SparkSession, d: str) -> DataFrame:
    """Clean assay peptides, with alleles brought together to three groups, so that each has enough peptides."""
    return A.clean(X.assays(spark, d)).select("rec_id", "peptide", F.substring("allele", 1, 5).alias("allele"), "quant", "qual")


def d13_log_odds(spark: SparkSession, d: str) -> DataFrame:
    """The odds are learned from the peptides with an affinity below 500."""
    a = _alleles(spark, d)
    odds = T.learned_odds(a.where(A.affinity(F.col("quant"), F.col("qual")) < 500))
    return T.log_odds_affinity(a.select("rec_id", "allele", "peptide"), odds).select("rec_id", "score", "ic50", "log_ic50")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Clean assay peptides of 8 to 11 letters: rec_id, score in thousandths."""
    return A.clean(X.assays(spark, d)).select("rec_id", T.adapted_score(F.col("peptide"), ONE[0]).alias("score")).where("score is not null")


def d15_reference_percentile(spark: SparkSession, d: str) -> DataFrame:
    ref = T.exploded(T.class_one(X.sequences(spark, d), [ONE[0]]), score=F.col(f"`{ONE[0]}`")).select("score")
    return T.reference_percentile(_scored(spark, d), ref).select("rec_id", F.round("percentile", 6).alias("percentile"))


def affinities(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("rec_id", P.ic50_of(T.milli("score")).alias("ic50"))


def d7_affinity_levels(spark: SparkSession, d: str) -> DataFrame:
    ic50 = F.col("ic50")
    return affinities(spark, d).select("rec_id", F.round(ic50, 6).alias("ic50"), F.round(P.percentile_of(ic50), 6).alias("pct_rank"), P.level_of(ic50).alias("level"))


def d16_fallback_percentile(spark: SparkSession, d: str) -> DataFrame:
    return affinities(spark, d).select("rec_id", F.round(E.fallback_percentile(F.col("ic50")), 6).alias("percentile"))


def d19_binders(spark: SparkSession, d: str) -> DataFrame:
    return affinities(spark, d).where("ic50 <= 500").select("rec_id", F.round("ic50", 6).alias("ic50"), (F.col("ic50") < 500).alias("strict")).orderBy("ic50", "rec_id")


def d17_model_output(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over the peptides of a sequence and allele."""
    a = A.clean(X.assays(spark, d)).select("rec_id", "seq_id", "allele", F.log10(A.affinity(F.col("quant"), F.col("qual"))).alias("y"))
    out = P.model_rows(a, ["seq_id", "allele"], "y", "rec_id")
    return out.select("rec_id", F.round("ic50", 6).alias("ic50"), F.round("score", 6).alias("score"), "binding", F.round("percentile", 6).alias("percentile"))


def d18_top_windows(spark: SparkSession, d: str) -> DataFrame:
    return T.top_windows(X.sequences(spark, d), ONE)


def d21_cleavage(spark: SparkSession, d: str) -> DataFrame:
    return T.cut_places(X.sequences(spark, d))


def d22_transport(spark: SparkSession, d: str) -> DataFrame:
    return T.windows(X.sequences(spark, d), nine=M.transport(9), ten=M.transport(10))


def d23_scaled(spark: SparkSession, d: str) -> DataFrame:
    out = T.class_one(X.sequences(spark, d), [ONE[1]])
    return T.exploded(T.scaled(out, ONE[1]), scaled=F.col(f"`{ONE[1]}`")).select("seq_id", "start", F.round("scaled", 6).alias("scaled"))


def d24_processing(spark: SparkSession, d: str) -> DataFrame:
    return T.processing(X.sequences(spark, d), ONE[0])


def d25_spread(spark: SparkSession, d: str) -> DataFrame:
    out = T.class_one(X.sequences(spark, d), [ONE[2]]).withColumnRenamed(ONE[2], "s")
    return T.exploded(out.withColumn("r", T.spread_scores("s", 9)), score=F.col("r")).select("seq_id", F.col("start").alias("pos"), T.milli("score").alias("score"))


def d27_allele_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case user_id % 3 when 0 then concat(char(97 + user_id % 3), lpad(cast(user_id % 100 as string), 2, '0'), ' ', lpad(cast(event_id % 100 as string), 2, '0')) when 1 then concat('HLA-B*', user_id % 100) else concat('drb1*', user_id % 100) end")
    return X.table(spark, d, "events").select("event_id", P.allele_name(raw).alias("allele"))


QUERIES = {
    f.__name__: f
    for f in (
        d4_matrix_scores, d5_adapted_lengths, d7_affinity_levels, d8_binders, d9_best_cores, d10_preferred_cores, d11_preference_levels, d12_three_anchor_cores, d13_log_odds, d15_reference_percentile,
        d16_fallback_percentile, d17_model_output, d18_top_windows, d19_binders, d21_cleavage, d22_transport, d23_scaled, d24_processing, d25_spread, d27_allele_names,
    )
}


def _kmers(k: int) -> str:
    return f'k{k} AS (SELECT seq_id, i AS "start", substr(seq, i, {k}) AS peptide FROM (SELECT seq_id, seq, unnest(range(1, n - {k} + 2)) AS i FROM sequences))'


def _scores(name: str, k: int, matrix: M.Matrix) -> str:
    return f'{name} AS (SELECT seq_id, "start", peptide, {M.score_sql("peptide", matrix)} AS s FROM k{k})'


A1 = [M.anchored(M.CLASS_ONE[a]) for a in ONE]
A2 = [M.anchored(M.CLASS_TWO[a]) for a in TWO]
SCORED = "scored AS (SELECT rec_id, CASE length(peptide) " + " ".join(f"WHEN {k} THEN {M.score_sql('peptide', M.anchored(M.CLASS_ONE[ONE[0]], k))}" for k in (8, 9, 10, 11)) + " END AS score FROM cleaned)"
AFFINE = "affine AS (SELECT rec_id, greatest(1e0, least(5e4, 500 * exp(-5e-1 * (CAST(score AS DOUBLE) / 1000)))) AS ic50 FROM scored WHERE score IS NOT NULL)"
CHAIN = ("sequences", "assays", CLEAN, SCORED, AFFINE)


def _core_sql(n: int) -> str:
    core = ", ".join(f"struct_pack(s := {M.score_sql('peptide', A2[n], 1 + j)}, i := {-j})" for j in range(7))
    name = SHORT[TWO[n]]
    return f"greatest({core}) AS b_{name}"


def _preferred(allele: str) -> str:
    m = M.sparse(M.PREFERENCE[allele], 1, 9)
    return "greatest(" + ", ".join(f"CASE WHEN length(peptide) >= {j + 9} THEN struct_pack(s := {M.score_sql('peptide', m, 1 + j)}, i := {-j}) END" for j in range(17)) + ")"


def _preferred_rows(allele: str) -> str:
    return f"""SELECT rec_id, '{allele}' AS allele, CASE WHEN fits THEN substr(peptide, 1 - b.i, 9) END AS core, CASE WHEN fits THEN CAST(-b.i AS DOUBLE) END AS core_start, CASE WHEN fits THEN CAST(b.s AS DOUBLE) / 1000 END AS score,
 CASE WHEN fits THEN substr(peptide, 1, -b.i) END AS flank_n, CASE WHEN fits THEN substr(peptide, 10 - b.i) END AS flank_c, CASE WHEN NOT fits THEN 'length' END AS error
 FROM (SELECT rec_id, peptide, length(peptide) BETWEEN 13 AND 25 AS fits, {_preferred(allele)} AS b FROM assays)"""


P1, P4, P9 = M.THREE_ANCHORS["HLA-DRB1*04:01"]
POINTS = ", ".join(f"struct_pack(s := CAST(contains('{P1}', substr(peptide, {j + 1}, 1)) AS INT) + CAST(contains('{P4}', substr(peptide, {j + 4}, 1)) AS INT) + CAST(contains('{P9}', substr(peptide, {j + 9}, 1)) AS INT), i := {-j})" for j in range(7))
LEVEL = "CASE WHEN ic50 < 50 THEN 'Strong' WHEN ic50 < 500 THEN 'Moderate' WHEN ic50 < 5000 THEN 'Weak' ELSE 'Non-binder' END AS level"
RANK = "CASE WHEN ic50 < 50 THEN 1e-1 WHEN ic50 < 500 THEN 1 + (ic50 - 50) / 450 * 4 WHEN ic50 < 5000 THEN 5 + (ic50 - 500) / 4500 * 45 ELSE 50 + least(5e1, (ic50 - 5000) / 45000 * 50) END"
SCALED = lambda c: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN CAST({c} - min({c}) OVER w AS DOUBLE) / (max({c}) OVER w - min({c}) OVER w) ELSE 5e-1 END"
ODDS = f"""own AS (SELECT rec_id, peptide, substr(allele, 1, 5) AS allele, {AFFINITY} AS ic50 FROM cleaned),
spots AS (SELECT allele, place, CASE WHEN place = 0 THEN right(peptide, 1) ELSE substr(peptide, place, 1) END AS aa FROM own CROSS JOIN (SELECT unnest([1, 2, 3, 6, 0]) AS place) WHERE ic50 < 500),
counted AS (SELECT allele, place, aa, count(*) AS c FROM spots GROUP BY ALL),
odds AS (SELECT allele, place, aa, round(greatest(-25e-1, least(25e-1, ln((c + 1) / (sum(c) OVER (PARTITION BY allele, place) + 20)) - ln((sum(c) OVER (PARTITION BY place, aa) + 1) / (sum(c) OVER (PARTITION BY place) + 20)))), 3) AS value FROM counted)"""
_at = lambda p, default: f"coalesce((SELECT value FROM odds q WHERE q.allele = o.allele AND q.place = {p} AND q.aa = {'right(peptide, 1)' if p == 0 else f'substr(peptide, {p}, 1)'}), {default})"
ODD_SCORE = f"2 * {_at(2, '-5e-1')} + 2 * {_at(0, '-5e-1')} + 5e-1 * (" + " + ".join(_at(p, "0") for p in (1, 3, 6)) + ")"

ORACLES = {
    "d4_matrix_scores": sql('SELECT seq_id, "start", ' + ", ".join(f"CAST({M.score_sql('peptide', m)} AS DOUBLE) / 1000 AS {SHORT[a]}" for a, m in zip(ONE, A1, strict=True)) + " FROM k9", "sequences", _kmers(9)),
    "d5_adapted_lengths": sql(" UNION ALL ".join(f"SELECT seq_id, CAST({k} AS BIGINT) AS k, count(*) AS windows, CAST(sum(s) AS BIGINT) AS total, CAST(max(s) AS BIGINT) AS best FROM s{k} GROUP BY seq_id" for k in (8, 10, 11)), "sequences", *[x for k in (8, 10, 11) for x in (_kmers(k), _scores(f"s{k}", k, M.anchored(M.CLASS_ONE[ONE[0]], k)))]),
    "d7_affinity_levels": sql(f"SELECT rec_id, round(ic50, 6) AS ic50, round({RANK}, 6) AS pct_rank, {LEVEL} FROM affine", *CHAIN),
    "d8_binders": sql(f'SELECT seq_id, "start", "start" + 8 AS "end", peptide, score, round(ic50, 6) AS ic50, round({RANK}, 6) AS pct_rank FROM (SELECT *, greatest(1e0, least(5e4, 500 * exp(-5e-1 * score))) AS ic50 FROM (SELECT *, CAST(s AS DOUBLE) / 1000 AS score FROM s9 WHERE s >= 500))', "sequences", _kmers(9), _scores("s9", 9, A1[0])),
    "d9_best_cores": sql('SELECT seq_id, "start", ' + ", ".join(f"CAST(1 - b_{SHORT[a]}.i AS BIGINT) AS core_{SHORT[a]}, CAST(b_{SHORT[a]}.s AS DOUBLE) / 1000 AS score_{SHORT[a]}" for a in TWO) + f' FROM (SELECT seq_id, "start", {_core_sql(0)}, {_core_sql(1)} FROM k15)', "sequences", _kmers(15)),
    "d10_preferred_cores": sql(" UNION ALL ".join(_preferred_rows(a) for a in M.PREFERENCE), "sequences", "assays"),
    "d11_preference_levels": sql(f"SELECT rec_id, round(ic50, 6) AS ic50, {LEVEL} FROM (SELECT rec_id, greatest(1e0, least(5e4, 500 * exp(-6e-1 * (CAST({_preferred('HLA-DRB1*01:01')}.s AS DOUBLE) / 1000)))) AS ic50 FROM assays WHERE length(peptide) BETWEEN 13 AND 25)", "sequences", "assays"),
    "d12_three_anchor_cores": sql(f'SELECT seq_id, "start", substr(peptide, 1 - b.i, 9) AS core, CAST(-b.i AS BIGINT) AS position FROM (SELECT *, greatest({POINTS}) AS b FROM k15 WHERE ("start" - 1) % 15 = 0)', "sequences", _kmers(15)),
    "d13_log_odds": sql(f"SELECT rec_id, round(score, 6) AS score, round(ic50, 6) AS ic50, round(log10(ic50), 6) AS log_ic50 FROM (SELECT rec_id, score, greatest(1e0, least(5e4, 1000 * exp(-5e-1 * score))) AS ic50 FROM (SELECT rec_id, {ODD_SCORE} AS score FROM own o WHERE allele IN (SELECT allele FROM odds)))", "sequences", "assays", CLEAN, ODDS),
    "d15_reference_percentile": sql("SELECT rec_id, round(100 * CAST((SELECT count(*) FROM s9 r WHERE r.s > p.score) AS DOUBLE) / (SELECT count(*) FROM s9), 6) AS percentile FROM scored p WHERE score IS NOT NULL", "sequences", "assays", CLEAN, SCORED, _kmers(9), _scores("s9", 9, A1[0])),
    "d16_fallback_percentile": sql("SELECT rec_id, round(CASE WHEN ic50 < 50 THEN 1e-1 WHEN ic50 < 500 THEN 5e-1 + (ic50 - 50) / 450 * 15e-1 WHEN ic50 < 5000 THEN 2 + (ic50 - 500) / 4500 * 8 ELSE least(1e2, 10 + (ic50 - 5000) / 45000 * 90) END, 6) AS percentile FROM affine", *CHAIN),
    "d17_model_output": sql(f"SELECT rec_id, round(pow(1e1, y), 6) AS ic50, round(greatest(0, 1 - y / 5), 6) AS score, CASE WHEN pow(1e1, y) < 50 THEN 'strong' WHEN pow(1e1, y) < 500 THEN 'weak' ELSE 'none' END AS binding, round(100e0 * row_number() OVER (PARTITION BY seq_id, allele ORDER BY y, rec_id) / count(*) OVER (PARTITION BY seq_id, allele), 6) AS percentile FROM (SELECT rec_id, seq_id, allele, log10({AFFINITY}) AS y FROM cleaned)", "sequences", "assays", CLEAN),
    "d18_top_windows": sql(" UNION ALL ".join(f"""SELECT seq_id, '{a}' AS allele, rank, "start", CAST(s AS DOUBLE) / 1000 AS score FROM (SELECT seq_id, "start", {M.score_sql('peptide', m)} AS s, row_number() OVER (PARTITION BY seq_id ORDER BY {M.score_sql('peptide', m)} DESC, "start") AS rank FROM k9) WHERE rank <= 100""" for a, m in zip(ONE, A1, strict=True)), "sequences", _kmers(9)),
    "d19_binders": sql("SELECT rec_id, round(ic50, 6) AS ic50, ic50 < 500 AS strict FROM affine WHERE ic50 <= 500", *CHAIN),
    "d21_cleavage": sql(f"""SELECT seq_id, "start" + 6 AS pos, CAST({M.score_sql('peptide', M.sparse(M.CLEAVAGE, -6, 6))} AS DOUBLE) / 1000 AS score, substr(peptide, 4, 3) || '|' || substr(peptide, 7, 4) AS context FROM k13""", "sequences", _kmers(13)),
    "d22_transport": sql(f"""SELECT seq_id, "start", CAST({M.score_sql('peptide', M.transport(9))} AS DOUBLE) / 1000 AS nine, CASE WHEN length(wide) = 10 THEN CAST({M.score_sql('wide', M.transport(10))} AS DOUBLE) / 1000 END AS ten FROM (SELECT k.*, substr(seq, "start", 10) AS wide FROM k9 k JOIN sequences s ON s.seq_id = k.seq_id)""", "sequences", _kmers(9)),
    "d23_scaled": sql(f'SELECT seq_id, "start", round({SCALED("s")}, 6) AS scaled FROM s9 WINDOW w AS (PARTITION BY seq_id)', "sequences", _kmers(9), _scores("s9", 9, A1[1])),
    "d24_processing": sql(
        f"""SELECT seq_id, "start", round(combined, 6) AS combined, round(combined, 9) >= 5e-1 AS called FROM (SELECT seq_id, "start", 6e-1 * {SCALED('m')} + 2e-1 * {SCALED('t')} + 2e-1 * {SCALED('c')} AS combined FROM (
 SELECT a.seq_id, a."start", a.s AS m, b.s AS t, coalesce(c.s, 0) AS c FROM s9 a JOIN t9 b ON b.seq_id = a.seq_id AND b."start" = a."start" LEFT JOIN c13 c ON c.seq_id = a.seq_id AND c."start" = a."start" + 2) WINDOW w AS (PARTITION BY seq_id))""",
        "sequences", _kmers(9), _kmers(13), _scores("s9", 9, A1[0]), _scores("t9", 9, M.transport(9)), _scores("c13", 13, M.sparse(M.CLEAVAGE, -6, 6)),
    ),
    "d25_spread": sql("""SELECT seq_id, pos, CAST(greatest(0, coalesce(max(s) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0)) AS DOUBLE) / 1000 AS score FROM (SELECT r.seq_id, r.pos, s FROM residues r LEFT JOIN s9 k ON k.seq_id = r.seq_id AND k."start" = r.pos)""", *R, _kmers(9), _scores("s9", 9, A1[2])),
    "d27_allele_names": """SELECT event_id, CASE WHEN starts_with(bare, 'HLA-') THEN bare ELSE 'HLA-' || bare END AS allele FROM (SELECT event_id, regexp_replace(upper(replace(raw, ' ', '')), '^([A-C])([0-9]{2})([0-9]{2})$', '\\1*\\2:\\3') AS bare FROM (
 SELECT event_id, CASE user_id % 3 WHEN 0 THEN chr(CAST(97 + user_id % 3 AS INT)) || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') WHEN 1 THEN 'HLA-B*' || (user_id % 100) ELSE 'drb1*' || (user_id % 100) END AS raw FROM events))""",
}
