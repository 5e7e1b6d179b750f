"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from ..functions.dims import AA, LINEAR, METHODS, lookup_sql, milli
from ..sources.fixtures import SQL

RESIDUES = "residues AS (SELECT seq_id, n, i AS pos, substr(seq, i, 1) AS aa FROM (SELECT seq_id, n, seq, unnest(range(1, n + 1)) AS i FROM sequences))"
FRAME = "OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
LINEAR_TRACK = " UNION ALL ".join(
    f"SELECT seq_id, '{m}' AS method, pos, aa, CAST(total AS DOUBLE) AS total, round(CAST(total AS DOUBLE) / 7000, 6) AS score FROM (SELECT seq_id, n, pos, aa, CAST(sum({lookup_sql('aa', milli(m), 0)}) {FRAME} AS BIGINT) AS total FROM residues) WHERE pos BETWEEN 4 AND n - 3" for m in LINEAR
)
PRODUCT_TRACK = f"""SELECT seq_id, 'emini' AS method, pos, aa, total, round(total, 6) AS score FROM (SELECT seq_id, pos, aa, CASE WHEN mean > 0 THEN raw / mean ELSE raw END AS total FROM (SELECT *, avg(raw) OVER (PARTITION BY seq_id) AS mean FROM (
 SELECT seq_id, n, pos, aa, product({lookup_sql('aa', milli('emini'), 1000)} / 1000e0) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS raw FROM residues) WHERE pos BETWEEN 4 AND n - 2))"""
TRACKS = f"tracks AS ({LINEAR_TRACK} UNION ALL {PRODUCT_TRACK})"
FIXED = "CASE method " + " ".join(f"WHEN '{m}' THEN {f * METHODS[m][1]}" for m in METHODS if METHODS[m][1] for f in [1 if m == "emini" else 7000]) + " END"
SCALE = "CASE method WHEN 'emini' THEN 1 ELSE 7000 END"
REGIONS = f"""called AS (SELECT *, {FIXED} AS fixed, count(*) OVER (PARTITION BY seq_id, method) AS cnt, sum(total) OVER (PARTITION BY seq_id, method) AS tot FROM tracks),
hot AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, method ORDER BY pos) AS run FROM called WHERE CASE WHEN fixed IS NOT NULL THEN round(total, 9) >= fixed ELSE total * cnt >= tot END),
runs AS (SELECT seq_id, method, min(pos) AS "start", max(pos) AS "end", count(*) AS length, CASE method WHEN 'emini' THEN round(sum(total) / count(*), 6) ELSE sum(total) / (7000 * count(*)) END AS score FROM hot GROUP BY seq_id, method, run HAVING count(*) >= 6),
regions AS (SELECT r.seq_id, method, "start", "end", length, substr(seq, "start", length) AS peptide, score FROM runs r JOIN sequences s ON s.seq_id = r.seq_id)"""
VOTES = """spots AS (SELECT seq_id, unnest(range("start", "end" + 1)) AS pos FROM regions),
votes AS (SELECT r.seq_id, r.pos, coalesce(v.votes, 0) AS votes FROM residues r LEFT JOIN (SELECT seq_id, pos, count(*) AS votes FROM spots GROUP BY seq_id, pos) v ON v.seq_id = r.seq_id AND v.pos = r.pos)"""
GLYCO = """near AS (SELECT seq_id, n, pos, aa, lag(aa) OVER w AS p1, lead(aa, 1) OVER w AS n1, lead(aa, 2) OVER w AS n2, lead(aa, 3) OVER w AS n3 FROM residues WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
kinds AS (SELECT *, CASE WHEN n1 <> 'P' AND n2 IN ('S', 'T') THEN 'canonical' WHEN n1 <> 'P' AND n2 = 'C' THEN 'cysteine' WHEN n1 = 'P' AND n2 IN ('S', 'T') THEN 'proline' END AS site_type FROM near WHERE aa = 'N' AND n2 IS NOT NULL),
glyco AS (SELECT seq_id, n, pos, site_type, round(CASE site_type WHEN 'canonical' THEN least(1e0, (CASE WHEN n2 = 'T' THEN 105e-2 ELSE 1e0 END) * (CASE WHEN p1 IN ('D', 'E', 'P') THEN 8e-1 ELSE 1e0 END) * (CASE WHEN n3 IN ('D', 'E', 'P') THEN 9e-1 ELSE 1e0 END)) WHEN 'cysteine' THEN 3e-1 ELSE 1e-1 END, 6) AS score FROM kinds WHERE site_type IS NOT NULL)"""
CLEAN = "cleaned AS (SELECT * FROM assays WHERE regexp_full_match(peptide, '[A-Z]{8,15}') AND (contains(allele, 'HLA') OR contains(allele, 'H-2')))"
AFFINITY = "greatest(1e0, least(1e5, coalesce(try_cast(quant AS DOUBLE), CASE WHEN contains(lower(qual), 'positive-high') THEN 50 WHEN contains(lower(qual), 'positive-intermediate') THEN 200 WHEN contains(lower(qual), 'positive-low') THEN 1000 WHEN contains(lower(qual), 'positive') THEN 500 WHEN contains(lower(qual), 'negative') THEN 20000 END, 500)))"
CLAIMS = """claims AS (SELECT s.seq_id, s.n, seq, p.pep_id, p.peptide, instr(seq, peptide) + CASE WHEN p.pep_id % 3 = 0 THEN 1 ELSE 0 END AS start FROM sequences s JOIN ref_peptides p ON contains(seq, peptide)),
valid AS (SELECT seq_id, n, pep_id, CASE WHEN substr(seq, start, 12) = peptide THEN start ELSE instr(seq, peptide) END AS hit FROM claims),
spots12 AS (SELECT seq_id, n, pep_id, unnest(range(hit, hit + 12)) AS pos FROM valid),
curated AS (SELECT seq_id, n, count(DISTINCT pep_id) AS matched, count(DISTINCT pos) AS positions FROM spots12 WHERE n BETWEEN 60 AND 1800 GROUP BY seq_id, n HAVING count(DISTINCT pep_id) >= 4 AND count(DISTINCT pos) >= 8),
covered AS (SELECT seq_id, n, matched, positions, round(CAST(positions AS DOUBLE) / n, 6) AS coverage FROM curated WHERE positions >= 3e-2 * n AND positions <= 9e-1 * n)"""
SELECTED = """chosen AS (SELECT * FROM (SELECT *, count(*) FILTER (rank <= 6) OVER () AS six FROM (SELECT c.*, organism, row_number() OVER (PARTITION BY organism ORDER BY matched DESC, c.seq_id) AS rank FROM covered c JOIN sequences s ON s.seq_id = c.seq_id)) WHERE rank <= CASE WHEN six >= 50 THEN 6 ELSE 10 END ORDER BY matched DESC, seq_id LIMIT 50)"""
COUNTS = f"""truth AS (SELECT DISTINCT seq_id, n, pos FROM spots12),
known AS (SELECT seq_id, n, count(*) AS known FROM truth GROUP BY seq_id, n),
hits AS (SELECT p.seq_id, method, count(t.pos) AS tp, count(*) - count(t.pos) AS fp FROM (SELECT seq_id, method, unnest(range("start", "end" + 1)) AS pos FROM regions) p LEFT JOIN truth t ON t.seq_id = p.seq_id AND t.pos = p.pos GROUP BY p.seq_id, method),
counts AS (SELECT k.seq_id, m.method, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, known - coalesce(tp, 0) AS fn, n - known - coalesce(fp, 0) AS tn FROM known k CROSS JOIN (SELECT unnest({list(METHODS)}) AS method) m LEFT JOIN hits h ON h.seq_id = k.seq_id AND h.method = m.method)"""
CONTACTS = """contacts AS (SELECT r.structure_id, r.idx, count(o.idx) AS contacts FROM residues3d r LEFT JOIN residues3d o ON r.structure_id = o.structure_id
 AND (r.x-o.x)*(r.x-o.x)+(r.y-o.y)*(r.y-o.y)+(r.z-o.z)*(r.z-o.z) > 0 AND sqrt((r.x-o.x)*(r.x-o.x)+(r.y-o.y)*(r.y-o.y)+(r.z-o.z)*(r.z-o.z)) < 8 GROUP BY r.structure_id, r.idx)"""
PROTRUSION = """away AS (SELECT r.*, sqrt(pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2)) AS away FROM residues3d r JOIN (SELECT structure_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM residues3d GROUP BY structure_id) c ON c.structure_id = r.structure_id),
protruding AS (SELECT *, max(sasa) OVER (PARTITION BY structure_id) AS top, CASE WHEN away IS NOT NULL THEN CASE WHEN max(away) OVER (PARTITION BY structure_id) > 0 THEN away / max(away) OVER (PARTITION BY structure_id) ELSE 0 END END AS protrusion FROM away)"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(SQL.get(p, p) for p in parts) + "\n" + body


S = "sequences"
R = (S, RESIDUES)
K = (*R, TRACKS)
G = (*K, REGIONS)


def rates_sql(*names: str) -> str:
    """The named rates of tp, fp, fn, tn."""
    div = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END, 6)"
    root = "sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))"
    all_ = {"sens": div("tp", "(tp + fn)"), "spec": div("tn", "(tn + fp)"), "mcc": div("(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)", root)}
    return ", ".join(f"{all_[n]} AS {n}" for n in names)


def pick(m: str) -> str:
    return f"max(CASE WHEN method = '{m}' THEN score END)"


def kmers(k: int, step: int = 1) -> str:
    return f'SELECT seq_id, i AS "start", i + {k - 1} AS "end", substr(seq, i, {k}) AS peptide FROM (SELECT seq_id, seq, unnest(range(1, n - {k} + 2, {step})) AS i FROM sequences)'


def motif(name: str, pattern: str) -> str:
    return f"""SELECT seq_id, '{name}' AS name, CAST(before + 1 AS BIGINT) AS "start", CAST(before + length(motif) AS BIGINT) AS "end", motif FROM (SELECT seq_id, m[i] AS motif,
 CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS before
 FROM (SELECT seq_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT seq_id, regexp_extract_all(seq, '{pattern}') AS m, string_split_regex(seq, '{pattern}') AS g FROM sequences)))"""


ORACLES = {
    "a2_normalise": "SELECT seq_id, seq FROM (SELECT doc_id AS seq_id, upper(regexp_replace(regexp_replace(text, '[^A-Za-z \\n]', '', 'g'), '[ \\n]', '', 'g')) AS seq FROM documents) WHERE seq <> ''",
    "a5_record_cap": sql("SELECT seq_id, organism, n FROM sequences ORDER BY seq_id LIMIT 100", S),
    "a6_wide_scores": sql("SELECT seq_id, pos, aa, " + ", ".join(f"{pick(m)} AS {m.replace('-', '_')}" for m in METHODS) + " FROM tracks GROUP BY seq_id, pos, aa", *K),
    "a9_dense_export": sql("SELECT r.seq_id, r.pos, r.aa, " + ", ".join(f"coalesce({pick(m)}, 0) AS {m.replace('-', '_')}" for m in METHODS) + " FROM residues r LEFT JOIN tracks t ON t.seq_id = r.seq_id AND t.pos = r.pos GROUP BY r.seq_id, r.pos, r.aa", *K),
    "b1_residues": sql("SELECT seq_id, pos, aa FROM residues", *R),
    "b3_linear_track": sql("SELECT seq_id, method, pos, score FROM tracks WHERE method <> 'emini'", *K),
    "b4_product_track": sql("SELECT seq_id, pos, score FROM tracks WHERE method = 'emini'", *K),
    "b5_thresholds": sql(f"SELECT seq_id, method, round(coalesce({FIXED} / {SCALE}, sum(total) / ({SCALE} * count(*))), 6) AS threshold FROM tracks GROUP BY seq_id, method", *K),
    "b6_regions": sql("""SELECT seq_id, "start", "end", peptide, score FROM regions WHERE method = 'kolaskar-tongaonkar'""", *G),
    "b6_regions_caller": sql(
        f"""SELECT r.seq_id, "start", "end", substr(seq, "start", length) AS peptide, round(score, 6) AS score FROM (SELECT seq_id, min(pos) AS "start", max(pos) AS "end", count(*) AS length, CAST(sum(total) AS DOUBLE) / (9000 * count(*)) AS score FROM (
 SELECT *, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM (SELECT seq_id, n, pos, sum({lookup_sql('aa', milli('parker'), 0)}) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS total FROM residues) WHERE pos BETWEEN 5 AND n - 4 AND total >= 22500) GROUP BY seq_id, run HAVING count(*) >= 4) r JOIN sequences s ON s.seq_id = r.seq_id""", *R
    ),
    "b7_all_methods": sql("SELECT * FROM regions", *G),
    "b8_score_at": sql("SELECT s.seq_id, a.pos, t.score FROM sequences s CROSS JOIN (SELECT CAST(unnest([1, 4, 30, 60]) AS BIGINT) AS pos) a LEFT JOIN tracks t ON t.seq_id = s.seq_id AND t.pos = a.pos AND t.method = 'parker'", *K),
    "b9_aligned_track": sql("SELECT r.seq_id, r.pos, r.aa, t.score FROM residues r LEFT JOIN tracks t ON t.seq_id = r.seq_id AND t.pos = r.pos AND t.method = 'parker'", *K),
    "b10_rejected": f"SELECT seq_id, CASE WHEN n < 60 THEN 'short' ELSE 'long' END AS reason FROM (SELECT doc_id AS seq_id, length(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{AA}]', '', 'g')) AS n FROM documents) WHERE n NOT BETWEEN 60 AND 1800",
    "b11_track_summary": sql(f"SELECT s.seq_id, m.method, coalesce(top, 0) AS top, coalesce(low, 0) AS low, coalesce(mean, 0) AS mean FROM sequences s CROSS JOIN (SELECT unnest({list(METHODS)}) AS method) m LEFT JOIN (SELECT seq_id, method, max(score) AS top, min(score) AS low, round(sum(total) / ({SCALE} * count(*)), 6) AS mean FROM tracks GROUP BY seq_id, method) t ON t.seq_id = s.seq_id AND t.method = m.method", *K),
    "b12_top_spans": sql(
        """SELECT seq_id, "start", "end", rank FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY mean DESC, "start") AS rank FROM (SELECT seq_id, min(pos) AS "start", max(pos) AS "end", sum(total) * 1000 / count(*) AS mean FROM (
 SELECT *, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM (SELECT t.*, cut FROM tracks t JOIN (SELECT seq_id, quantile_cont(total, 0.8) AS cut FROM tracks WHERE method = 'parker' GROUP BY seq_id) q ON q.seq_id = t.seq_id WHERE method = 'parker') WHERE total >= cut) GROUP BY seq_id, run HAVING count(*) >= 4)) WHERE rank <= 5""",
        *K,
    ),
    "b13_top_sites": sql("SELECT seq_id, rank, pos, greatest(1, pos - 1) AS lo, least(n, pos + 1) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, pos DESC) AS rank FROM glyco WHERE score >= 5e-1) WHERE rank <= 5", *R, GLYCO),
    "c1_votes": sql("SELECT seq_id, pos, votes FROM votes", *G, VOTES),
    "c3_consensus_regions": sql(
        """SELECT seq_id, min(pos) AS "start", max(pos) AS "end", count(*) AS length, max(votes) AS top FROM (SELECT *, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM votes WHERE votes >= 2) GROUP BY seq_id, run HAVING count(*) >= 6""", *G, VOTES
    ),
    "c4_coverage": sql("SELECT r.seq_id, method, CAST(sum(length) AS BIGINT) AS called, round(100 * CAST(sum(length) AS DOUBLE) / n, 6) AS coverage FROM regions r JOIN sequences s ON s.seq_id = r.seq_id GROUP BY r.seq_id, method, n", *G),
    "d1_kmers": sql(kmers(9), S),
    "d2_strided_kmers": sql(kmers(15, 15), S),
    "d3_standard_kmers": f"SELECT seq_id, count(*) AS kept FROM (SELECT seq_id, substr(seq, i, 9) AS peptide FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 7)) AS i FROM (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents))) WHERE regexp_full_match(peptide, '[{AA}]+') GROUP BY seq_id",
    "d20_binder_census": sql(f"SELECT seq_id, allele, count(*) AS total, count(*) FILTER (ic50 < 50) AS strong, count(*) FILTER (ic50 >= 50 AND ic50 < 500) AS weak FROM (SELECT *, {AFFINITY} AS ic50 FROM cleaned) GROUP BY seq_id, allele", S, "assays", CLEAN),
    "e1_n_glycosylation": sql("SELECT seq_id, pos, site_type, score FROM glyco", *R, GLYCO),
    "f3_protrusion": sql("SELECT structure_id, idx, round(protrusion, 6) AS protrusion FROM protruding", "residues3d", PROTRUSION),
    "f4_contacts": sql("SELECT structure_id, idx, contacts FROM contacts", "residues3d", CONTACTS),
    "f10_surface_propensity": sql(
        f"SELECT structure_id, idx, round(score, 6) AS score, round(score, 9) >= round(cut, 9) AS called FROM (SELECT *, quantile_cont(score, 0.85) OVER (PARTITION BY structure_id) AS cut FROM (SELECT r.structure_id, r.idx, {lookup_sql('aa', milli('propensity'), 0)} / 1000e0 - 2e-2 * contacts + 35e-2 * ln(sasa + 1) AS score FROM residues3d r JOIN contacts c ON c.structure_id = r.structure_id AND c.idx = r.idx))", "residues3d", CONTACTS
    ),
    "f11_protrusion_by_area": sql("SELECT structure_id, idx, round(CASE WHEN protrusion IS NOT NULL THEN CASE WHEN sasa < 5 OR top <= 0 THEN 0 ELSE protrusion * sasa / top END END, 6) AS score FROM protruding", "residues3d", PROTRUSION),
    "f15_bfactor": sql("SELECT structure_id, idx, round(CASE WHEN sd > 0 THEN (tanh((bfactor - mean) / sd / 2) + 1) / 2 ELSE 5e-1 END, 6) AS flexibility FROM (SELECT *, stddev_pop(bfactor) OVER (PARTITION BY structure_id) AS sd, avg(bfactor) OVER (PARTITION BY structure_id) AS mean FROM residues3d)", "residues3d"),
    "g1_clean_assays": sql("SELECT rec_id, peptide, allele FROM cleaned", S, "assays", CLEAN),
    "g2_affinity": sql(f"SELECT rec_id, round({AFFINITY}, 6) AS ic50 FROM assays", S, "assays"),
    "g3_top_alleles": sql("SELECT allele, count(*) AS n FROM cleaned GROUP BY allele HAVING count(*) >= 20 ORDER BY n DESC, allele LIMIT 30", S, "assays", CLEAN),
    "g4_mhc_class": sql("SELECT CASE WHEN regexp_matches(allele, 'DRB|DQB|DPB') THEN 'II' ELSE 'I' END AS mhc_class, count(*) AS n FROM assays GROUP BY 1", S, "assays"),
    "h4_validated_positions": sql("SELECT * FROM curated", S, "ref_peptides", CLAIMS),
    "h5_coverage_filter": sql("SELECT seq_id, matched, positions, coverage FROM covered", S, "ref_peptides", CLAIMS),
    "h6_capped_selection": sql("SELECT seq_id, organism, matched FROM chosen", S, "ref_peptides", CLAIMS, SELECTED),
    "h7_set_profile": sql("SELECT count(*) AS sequences, count(DISTINCT organism) AS organisms, CAST(sum(n) AS BIGINT) AS residues, CAST(sum(positions) AS BIGINT) AS positions, min(n) AS shortest, max(n) AS longest, round(min(coverage), 6) AS least_coverage, round(avg(coverage), 6) AS mean_coverage, round(max(coverage), 6) AS most_coverage FROM chosen", S, "ref_peptides", CLAIMS, SELECTED),
    "i2_method_rates": sql(
        """SELECT seq_id, method, tp, fp, fn, tn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS sens, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS spec, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS ppv, round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) AS npv,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END, 6) AS accuracy,
 round(CASE WHEN base > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / base ELSE 0 END, 6) AS mcc FROM (SELECT *, sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS base FROM counts)""",
        *G, "ref_peptides", CLAIMS, COUNTS,
    ),
    "i5_distribution": sql("SELECT method, round(avg(coverage), 4) AS mean, round(stddev_pop(coverage), 4) AS sd, round(median(coverage), 4) AS median, round(min(coverage), 4) AS low, round(max(coverage), 4) AS top FROM (SELECT r.seq_id, method, round(100 * CAST(sum(length) AS DOUBLE) / n, 6) AS coverage FROM regions r JOIN sequences s ON s.seq_id = r.seq_id GROUP BY r.seq_id, method, n) GROUP BY method", *G),
    "i6_auc": sql(
        "SELECT structure_id, pos, neg, round(CASE WHEN pos > 0 AND neg > 0 THEN (rs - pos * (pos + 1) / 2e0) / (pos * neg) END, 6) AS auc FROM (SELECT structure_id, sum(CASE WHEN chain_id = 'H' THEN r END) AS rs, count(*) FILTER (chain_id = 'H') AS pos, count(*) FILTER (chain_id <> 'H') AS neg FROM (SELECT *, rank() OVER (PARTITION BY structure_id ORDER BY sasa) + (count(*) OVER (PARTITION BY structure_id, sasa) - 1) / 2e0 AS r FROM residues3d) GROUP BY structure_id)", "residues3d"
    ),
}
