"""Registered queries of patches, composite scores, mining, combined evidence, scans and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrices as MX
from ..functions.dims import METHODS, lookup_sql, milli
from ..operators import assays as A
from ..operators import evaluation as E
from ..operators import mining
from ..operators import patches as P
from ..operators import tcell
from ..operators import tracks as T
from ..sources import files
from ..sources import fixtures as X
from .oracle import CLAIMS, CONTACTS, COUNTS, G, PROTRUSION, R, TRACKS, VOTES, rates_sql, sql
from .spatial import GAP2, SCORED


def r6(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


def a1_fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    """The sequences written as FASTA text and scanned again."""
    path = files.write_fasta(X.sequences(spark, d))
    return files.read_fasta(spark, path).where("reason is null").select("name", "seq")


def a3_positional_assays(spark: SparkSession, d: str) -> DataFrame:
    """Assay records written as positional CSV with two header rows, every 17th too short, and scanned again."""
    path = files.write_positional(X.assays(spark, d))
    return files.read_positional(spark, path).select(F.col("assay").cast("long").alias("rec_id"), "peptide", "allele", "quant", "qual")


def a4_keyed_assays(spark: SparkSession, d: str) -> DataFrame:
    path = files.write_keyed(X.assays(spark, d))
    return files.read_keyed(spark, path).select("peptide", "allele", F.round("ic50", 6).alias("ic50"))


def a6_csv_scores(spark: SparkSession, d: str) -> DataFrame:
    """Wide scores of one method set written as CSV with four decimals and scanned again."""
    return files.read_scores(spark, files.write_aligned(X.sequences(spark, d)))


def a7_json_predictions(spark: SparkSession, d: str) -> DataFrame:
    """One nested JSON object a sequence, written and read again: a row an epitope."""
    path = files.write_predictions(X.sequences(spark, d), ["kolaskar-tongaonkar", "emini"])
    found = files.read_predictions(spark, path).select("seq_id", F.inline("methods"))
    return found.select("seq_id", "method", "threshold", F.size("positions").cast("long").alias("positions"), F.inline("epitopes")).select("seq_id", "method", "threshold", "positions", "start", "end", "sequence", F.round("score", 6).alias("score"))


def c2_mixed_votes(spark: SparkSession, d: str) -> DataFrame:
    return P.mixed_votes(X.residues3d(spark, d))


def f2_standard_residues(spark: SparkSession, d: str) -> DataFrame:
    return P.standard_residues(X.named_atoms(spark, d))


def f7_surface_patches(spark: SparkSession, d: str) -> DataFrame:
    return P.patches(X.residues3d(spark, d))


def f8_strict_patches(spark: SparkSession, d: str) -> DataFrame:
    res = X.residues3d(spark, d)
    out = P.patch_table(res, P.patches(res, distance=8.0, inclusive=False, least=1), "sasa")
    return out.select("structure_id", "patch", "size", F.round("score", 6).alias("score"))


def f12_patch_propensity(spark: SparkSession, d: str) -> DataFrame:
    return P.patch_propensity(X.residues3d(spark, d))[0].select("structure_id", "idx", F.round("score", 6).alias("score"))


def f14_all_conformational(spark: SparkSession, d: str) -> DataFrame:
    return P.all_methods(X.residues3d(spark, d)).select("structure_id", "method", "start", "end", "size", F.round("score", 6).alias("score"))


def f16_accessibility(spark: SparkSession, d: str) -> DataFrame:
    ss = F.expr("substr('CTSGHEBI -X', cast(1 + vec_id % 11 as int), 1)")
    return X.residues3d(spark, d).select("structure_id", "idx", P.accessibility(ss).alias("accessibility"))


def f17_composite(spark: SparkSession, d: str) -> DataFrame:
    return P.composite(X.residues3d(spark, d)).select("structure_id", "idx", F.round("score", 6).alias("score"))


def h1_candidates(spark: SparkSession, d: str) -> DataFrame:
    return mining.candidates(X.mined_assays(spark, d))


def h2_richest(spark: SparkSession, d: str) -> DataFrame:
    return mining.richest(h1_candidates(spark, d)).select("accession", "source_mol", "positives")


def h3_named(spark: SparkSession, d: str) -> DataFrame:
    return mining.named(mining.richest(h1_candidates(spark, d))).select("accession", "source_mol", "positives")


def i4_combined_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Residues with three votes, or within a window that binds below 500: each position once, then the rates."""
    from .catalogue import with_truth

    votes = T.vote_arrays(with_truth(spark, d), keep=["seq", "spots"])
    binds = tcell.class_one(votes, ["HLA-A*02:01"]).withColumn("i", F.filter(T.upto(F.col("n") - 8), lambda i: F.col("`HLA-A*02:01`")[i - 1] > 0))
    voted = F.filter(T.upto(F.col("n")), lambda i: F.col("votes")[i - 1] >= 3)
    found = T.held(binds.withColumn("found", F.array_distinct(F.concat(voted, F.flatten(F.transform("i", lambda i: F.sequence(i, i + 8)))))).select("seq_id", "n", "found", "spots"))
    return A.rates(found.select("seq_id", *E.counts(F.col("found"), F.col("spots"), F.col("n")))).select("seq_id", "tp", "fp", "fn", "tn", "sens", "spec", "mcc")


def i8_cross_domain(spark: SparkSession, d: str) -> DataFrame:
    """The five tracks of a structure's sequence against contact labels: AUC, with residues outside a track at its least score."""
    res = X.residues3d(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "aa"))), lambda r: r["aa"]), "")
    seqs = res.groupBy("structure_id").agg(text.alias("seq")).withColumn("n", F.length("seq").cast("long")).withColumnRenamed("structure_id", "seq_id")
    tracks = T.track(seqs).select(F.col("seq_id").alias("structure_id"), "method", (F.col("pos") - 1).alias("idx"), "score")
    spine = res.select("structure_id", "idx", (F.col("chain_id") == "H").alias("truth"), F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))
    low = tracks.groupBy("structure_id", "method").agg(F.min("score").alias("low"))
    rows = spine.join(tracks, ["structure_id", "method", "idx"], "left").join(low, ["structure_id", "method"]).select(F.concat_ws("|", "structure_id", "method").alias("key"), F.coalesce("score", "low").alias("score"), "truth")
    return A.auc(rows, "key", "score", "truth")


QUERIES = {
    f.__name__: f
    for f in (
        a1_fasta_scan, a3_positional_assays, a4_keyed_assays, a6_csv_scores, a7_json_predictions, c2_mixed_votes, f2_standard_residues, f7_surface_patches, f8_strict_patches,
        f12_patch_propensity, f14_all_conformational, f16_accessibility, f17_composite, h1_candidates, h2_richest, h3_named, i4_combined_evidence, i8_cross_domain,
    )
}


def _patches(name: str, test: str) -> str:
    return f"""e_{name} AS (SELECT r.structure_id, r.idx AS a, o.idx AS b FROM residues3d r JOIN residues3d o ON r.structure_id = o.structure_id AND r.idx <> o.idx AND r.sasa >= 20 AND o.sasa >= 20 AND sqrt({GAP2}) {test}),
w_{name} AS (SELECT structure_id, idx, idx AS seen FROM residues3d WHERE sasa >= 20 UNION SELECT w.structure_id, w.idx, e.b FROM w_{name} w JOIN e_{name} e ON e.structure_id = w.structure_id AND e.a = w.seen),
g_{name} AS (SELECT *, count(*) OVER (PARTITION BY structure_id, patch) AS size FROM (SELECT structure_id, idx, min(seen) AS patch FROM w_{name} GROUP BY structure_id, idx))"""


_prop = f"({lookup_sql('aa', milli('propensity'), 0)} / 1000e0)"
WIDE, TIGHT = _patches("wide", "<= 10"), _patches("tight", "< 8")
SEPPA = f"""own AS (SELECT g.structure_id, patch, min(g.idx) AS "start", max(g.idx) AS "end", count(*) AS size, avg({_prop}) AS score FROM g_wide g JOIN residues3d r ON r.structure_id = g.structure_id AND r.idx = g.idx WHERE size >= 3 GROUP BY g.structure_id, patch)"""


def _gaps(name: str, source: str, called: str) -> str:
    return f"""hot_{name} AS (SELECT structure_id, idx, sum(CASE WHEN idx - before > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY structure_id ORDER BY idx) AS run FROM (SELECT structure_id, idx, lag(idx) OVER (PARTITION BY structure_id ORDER BY idx) AS before FROM {source} WHERE {called})),
gap_{name} AS (SELECT r.structure_id, "start", "end", avg(score) AS score FROM (SELECT structure_id, min(idx) AS "start", max(idx) AS "end" FROM hot_{name} GROUP BY structure_id, run HAVING count(*) >= 3) r JOIN {source} s ON s.structure_id = r.structure_id AND s.idx BETWEEN "start" AND "end" GROUP BY ALL)"""


TWO_SCORES = f"""one_ AS (SELECT *, quantile_cont(score, 0.85) OVER (PARTITION BY structure_id) AS cut FROM scored),
two_ AS (SELECT structure_id, idx, CASE WHEN protrusion IS NOT NULL THEN CASE WHEN sasa < 5 OR top <= 0 THEN 0 ELSE protrusion * sasa / top END END AS score FROM protruding),
{_gaps('one', 'one_', 'round(score, 9) >= round(cut, 9)')},
{_gaps('two', 'two_', 'round(score, 9) >= 5e-1')}"""
SHAPES = ("residues3d", CONTACTS, SCORED, PROTRUSION, TWO_SCORES)
STRUCTURE_SEQS = "sequences AS (SELECT structure_id AS seq_id, string_agg(aa, '' ORDER BY idx) AS seq, count(*) AS n FROM residues3d GROUP BY structure_id)"
DEPTH = f"depths AS (SELECT r.structure_id, r.idx, sqrt(min({GAP2})) AS depth FROM residues3d r JOIN residues3d o ON r.structure_id = o.structure_id AND r.x IS NOT NULL AND o.x IS NOT NULL AND o.sasa >= 60 GROUP BY r.structure_id, r.idx)"
_scaled = lambda f: f"CASE WHEN {f} IS NOT NULL THEN CASE WHEN max({f}) OVER w - min({f}) OVER w < 1e-10 THEN 5e-1 ELSE ({f} - min({f}) OVER w) / (max({f}) OVER w - min({f}) OVER w) END END"
MINED = """mined AS (SELECT rec_id, CASE WHEN rec_id % 19 = 0 THEN lower(peptide) ELSE peptide END AS peptide, CASE WHEN rec_id % 13 <> 0 THEN CAST(start AS VARCHAR) ELSE '' END AS start, CASE seq_id % 50 WHEN 0 THEN '' WHEN 1 THEN 'Genome polyprotein ' || (seq_id % 7) WHEN 2 THEN 'Unknown ' || (seq_id % 7) ELSE source_mol END AS source_mol,
 CASE WHEN seq_id % 11 = 0 THEN 'http://example.org/none' ELSE 'http://www.ncbi.nlm.nih.gov/protein/AC_' || (seq_id % 40) || '.1' END AS source_iri, CASE seq_id % 9 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'Mus musculus' ELSE organism END AS organism, CASE WHEN rec_id % 17 = 0 THEN '' ELSE qual END AS qual FROM assays),
usable AS (SELECT *, regexp_extract(source_iri, 'ncbi\\.nlm\\.nih\\.gov/protein/([A-Za-z0-9_.]+)', 1) AS accession, contains(lower(qual), 'positive') OR qual = '' AS positive FROM mined WHERE regexp_full_match(peptide, '[A-Z]{8,25}') AND start <> '' AND trim(source_mol) <> '' AND lower(organism) NOT IN (""" + ", ".join(f"'{o}'" for o in mining.ORGANISMS) + """)),
found AS (SELECT substr(trim(source_mol), 1, 60) AS source_mol, arg_max(accession, rec_id) AS accession, arg_max(substr(organism, 1, 40), rec_id) AS organism, count(*) FILTER (positive) AS positives, count(DISTINCT peptide) FILTER (positive) AS peptides FROM usable WHERE accession <> '' GROUP BY 1),
rich AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY positives DESC, source_mol) AS rank FROM found WHERE positives >= 5) WHERE rank = 1)"""
MINING = ("sequences", "assays", MINED)

ORACLES = {
    "a1_fasta_scan": sql("SELECT name, seq FROM sequences", "sequences"),
    "a3_positional_assays": sql("SELECT rec_id, peptide, allele, nullif(quant, '') AS quant, qual FROM assays WHERE rec_id % 17 <> 0 AND peptide <> ''", "sequences", "assays"),
    "a4_keyed_assays": sql("SELECT peptide, allele, round(try_cast(quant AS DOUBLE), 6) AS ic50 FROM assays WHERE try_cast(quant AS DOUBLE) IS NOT NULL AND length(peptide) BETWEEN 8 AND 11", "sequences", "assays"),
    "a6_csv_scores": sql("SELECT r.seq_id, r.pos, r.aa, " + ", ".join(f"CAST(round(CAST(max(CASE WHEN method = '{m}' THEN score END) AS DECIMAL(18, 6)), 4) AS DOUBLE) AS {m.replace('-', '_')}" for m in METHODS) + " FROM residues r LEFT JOIN tracks t ON t.seq_id = r.seq_id AND t.pos = r.pos GROUP BY r.seq_id, r.pos, r.aa", *R, TRACKS),
    "a7_json_predictions": sql("""SELECT r.seq_id, method, 1e0 AS threshold, CASE method WHEN 'emini' THEN n - 5 ELSE n - 6 END AS positions, "start", "end", peptide AS sequence, round(score, 6) AS score FROM regions r JOIN sequences s ON s.seq_id = r.seq_id WHERE method IN ('kolaskar-tongaonkar', 'emini')""", *G),
    "c2_mixed_votes": sql(
        """SELECT structure_id, idx, CAST(sum(v) AS BIGINT) AS votes FROM (SELECT seq_id AS structure_id, pos - 1 AS idx, votes AS v FROM votes UNION ALL SELECT structure_id, unnest(range("start", "end" + 1)), 1 FROM gap_one UNION ALL SELECT structure_id, unnest(range("start", "end" + 1)), 1 FROM gap_two) GROUP BY structure_id, idx""",
        *SHAPES, STRUCTURE_SEQS, *G[1:], VOTES,
    ),
    "f2_standard_residues": sql(f"SELECT structure_id, chain_id, idx, aa FROM residues3d WHERE idx % 29 <> 0 AND idx % 31 <> 0", "residues3d"),
    "f7_surface_patches": sql("SELECT structure_id, idx, patch FROM g_wide WHERE size >= 3", "residues3d", WIDE).replace("WITH ", "WITH RECURSIVE ", 1),
    "f8_strict_patches": sql("SELECT g.structure_id, patch, count(*) AS size, round(avg(sasa), 6) AS score FROM g_tight g JOIN residues3d r ON r.structure_id = g.structure_id AND r.idx = g.idx GROUP BY g.structure_id, patch", "residues3d", TIGHT).replace("WITH ", "WITH RECURSIVE ", 1),
    "f12_patch_propensity": sql("SELECT r.structure_id, r.idx, round(coalesce(o.score, coalesce(low, -1) - 5e-1), 6) AS score FROM residues3d r LEFT JOIN g_wide g ON g.structure_id = r.structure_id AND g.idx = r.idx AND g.size >= 3 LEFT JOIN own o ON o.structure_id = g.structure_id AND o.patch = g.patch LEFT JOIN (SELECT structure_id, min(score) AS low FROM own GROUP BY structure_id) l ON l.structure_id = r.structure_id", "residues3d", WIDE, SEPPA).replace("WITH ", "WITH RECURSIVE ", 1),
    "f14_all_conformational": sql("""SELECT structure_id, 'propensity' AS method, "start", "end", "end" - "start" + 1 AS size, round(score, 6) AS score FROM gap_one UNION ALL SELECT structure_id, 'protrusion', "start", "end", "end" - "start" + 1, round(score, 6) FROM gap_two UNION ALL SELECT structure_id, 'patch', "start", "end", size, round(score, 6) FROM own WHERE score >= 0""", *SHAPES, WIDE, SEPPA).replace("WITH ", "WITH RECURSIVE ", 1),
    "f16_accessibility": sql("SELECT structure_id, idx, CASE substr('CTSGHEBI -X', 1 + CAST(vec_id % 11 AS INT), 1) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in P.ACCESSIBILITY.items()) + " ELSE 1e0 END AS accessibility FROM residues3d", "residues3d"),
    "f17_composite": sql(f"SELECT structure_id, idx, round(greatest(0e0, least(1e0, (35e-2 * a + 25e-2 * (1 - b) + 25e-2 * c + 15e-2 * (1 - d)) / 1e0)), 6) AS score FROM (SELECT r.structure_id, r.idx, {_scaled('sasa')} AS a, {_scaled('contacts')} AS b, {_scaled('bfactor')} AS c, {_scaled('depth')} AS d FROM residues3d r JOIN contacts c ON c.structure_id = r.structure_id AND c.idx = r.idx LEFT JOIN depths p ON p.structure_id = r.structure_id AND p.idx = r.idx WINDOW w AS (PARTITION BY r.structure_id))", "residues3d", CONTACTS, DEPTH),
    "h1_candidates": sql("SELECT * FROM found", *MINING),
    "h2_richest": sql("SELECT accession, source_mol, positives FROM rich", *MINING),
    "h3_named": sql("SELECT accession, source_mol, positives FROM rich WHERE " + " AND ".join(f"NOT contains(lower(source_mol), '{t}')" for t in mining.TERMS) + " ORDER BY positives DESC, accession LIMIT 120", *MINING),
    "i4_combined_evidence": sql(
        "SELECT seq_id, tp, fp, fn, tn, " + rates_sql("sens", "spec", "mcc") + f""" FROM (SELECT r.seq_id, count(*) FILTER (p.pos IS NOT NULL AND t.pos IS NOT NULL) AS tp, count(*) FILTER (p.pos IS NOT NULL AND t.pos IS NULL) AS fp, count(*) FILTER (p.pos IS NULL AND t.pos IS NOT NULL) AS fn, count(*) FILTER (p.pos IS NULL AND t.pos IS NULL) AS tn
 FROM residues r SEMI JOIN known k ON k.seq_id = r.seq_id LEFT JOIN truth t ON t.seq_id = r.seq_id AND t.pos = r.pos LEFT JOIN (SELECT seq_id, pos FROM votes WHERE votes >= 3 UNION SELECT seq_id, unnest(range(s, s + 9)) FROM (SELECT seq_id, i AS s FROM (SELECT seq_id, i, substr(seq, i, 9) AS peptide FROM (SELECT q.seq_id, seq, unnest(range(1, q.n - 7)) AS i FROM sequences q SEMI JOIN known k ON k.seq_id = q.seq_id))
 WHERE {MX.score_sql('peptide', MX.anchored(MX.CLASS_ONE['HLA-A*02:01']))} > 0)) p ON p.seq_id = r.seq_id AND p.pos = r.pos GROUP BY r.seq_id)""",
        *G, VOTES, "ref_peptides", CLAIMS, COUNTS,
    ),
    "i8_cross_domain": sql(
        f"""SELECT key, pos, neg, round(CASE WHEN pos > 0 AND neg > 0 THEN (rs - pos * (pos + 1) / 2e0) / (pos * neg) END, 6) AS auc FROM (SELECT key, sum(CASE WHEN truth THEN r END) AS rs, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY score) + (count(*) OVER (PARTITION BY key, score) - 1) / 2e0 AS r FROM (
 SELECT r.structure_id || '|' || l.method AS key, coalesce(t.score, low) AS score, chain_id = 'H' AS truth FROM residues3d r JOIN (SELECT seq_id, method, min(score) AS low FROM tracks GROUP BY seq_id, method) l ON l.seq_id = r.structure_id LEFT JOIN tracks t ON t.seq_id = r.structure_id AND t.method = l.method AND t.pos = r.idx + 1)) GROUP BY key)""",
        "residues3d", STRUCTURE_SEQS, R[1], TRACKS,
    ),
}
