"""Registered queries over the fixture views; their SQL is in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import LINEAR, METHODS
from ..operators import assays as A
from ..operators import motifs as M
from ..operators import peptides as P
from ..operators import seeds as SD
from ..operators import structure as S
from ..operators import tracks as T
from ..sources import fixtures as X
from . import innate, learning, scoring, spatial, surfaces, tcell
from .oracle import ORACLES as TRACK_SQL

QUERIES: dict = {**spatial.QUERIES, **scoring.QUERIES, **tcell.QUERIES, **innate.QUERIES, **surfaces.QUERIES, **learning.QUERIES, **learning.FITTED}
ORACLES = TRACK_SQL | spatial.ORACLES | scoring.ORACLES | tcell.ORACLES | innate.ORACLES | surfaces.ORACLES | learning.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def a2_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = X.table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace("text", "[^A-Za-z \n]", "").alias("t"))
    return raw.select("seq_id", F.upper(F.regexp_replace("t", "[ \n]", "")).alias("seq")).where("seq <> ''")


@query
def a5_record_cap(spark: SparkSession, d: str) -> DataFrame:
    return X.sequences(spark, d).select("seq_id", "organism", "n").orderBy("seq_id").limit(100)


@query
def a6_wide_scores(spark: SparkSession, d: str) -> DataFrame:
    wide = T.aligned(X.sequences(spark, d))
    return wide.where(F.coalesce(*[F.col(m.replace("-", "_")) for m in METHODS]).isNotNull())


@query
def a9_dense_export(spark: SparkSession, d: str) -> DataFrame:
    return T.aligned(X.sequences(spark, d)).na.fill(0.0)


@query
def b1_residues(spark: SparkSession, d: str) -> DataFrame:
    return T.residues(X.sequences(spark, d)).select("seq_id", "pos", "aa")


@query
def b3_linear_track(spark: SparkSession, d: str) -> DataFrame:
    return T.scored_places(X.sequences(spark, d), LINEAR)


@query
def b4_product_track(spark: SparkSession, d: str) -> DataFrame:
    return T.track(X.sequences(spark, d), ["emini"]).select("seq_id", "pos", "score")


@query
def b5_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return T.thresholds(X.sequences(spark, d))


@query
def b6_regions(spark: SparkSession, d: str) -> DataFrame:
    return T.regions(X.sequences(spark, d), ["kolaskar-tongaonkar"]).select("seq_id", "start", "end", "peptide", "score")


@query
def b6_regions_caller(spark: SparkSession, d: str) -> DataFrame:
    """The caller's window, threshold and least length instead of the defaults."""
    return T.regions(X.sequences(spark, d), ["parker"], least=4, window=9, threshold=2.5).select("seq_id", "start", "end", "peptide", F.round("score", 6).alias("score"))


@query
def b7_all_methods(spark: SparkSession, d: str) -> DataFrame:
    return T.regions(X.sequences(spark, d))


@query
def b8_score_at(spark: SparkSession, d: str) -> DataFrame:
    at = F.transform(F.array(*[F.lit(x).cast("long") for x in (1, 4, 30, 60)]), lambda p: F.struct(p.alias("pos"), T.score(F.get("t_parker", (p - 4).cast("int")), "parker").alias("score")))
    return T.tracked(X.sequences(spark, d), ["parker"]).select("seq_id", F.inline(at))


@query
def b9_aligned_track(spark: SparkSession, d: str) -> DataFrame:
    return T.aligned(X.sequences(spark, d), ["parker"]).withColumnRenamed("parker", "score")


@query
def b10_rejected(spark: SparkSession, d: str) -> DataFrame:
    return X.all_sequences(spark, d).where("n not between 60 and 1800").select("seq_id", F.expr("case when n < 60 then 'short' else 'long' end").alias("reason"))


@query
def b11_track_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.summaries(X.sequences(spark, d))


@query
def b12_top_spans(spark: SparkSession, d: str) -> DataFrame:
    return T.top_spans(X.sequences(spark, d), "parker")


@query
def b13_top_sites(spark: SparkSession, d: str) -> DataFrame:
    """The five best sites of each sequence, of equal ones the later, with a letter on either side."""
    best = F.filter(M.n_sites(), lambda x: x["score"] >= 0.5)
    order = F.sort_array(F.transform(best, lambda x: F.struct((-x["score"]).alias("s"), (-x["pos"]).alias("p"))))
    top = T.held(T.held(T.letters(X.sequences(spark, d))).select("seq_id", "n", F.slice(order, 1, 5).alias("top_")))
    each = top.select("seq_id", "n", F.posexplode("top_").alias("i", "x")).select("seq_id", "n", (F.col("i") + 1).cast("long").alias("rank"), (-F.col("x.p")).alias("pos"))
    return each.select("seq_id", "rank", "pos", F.greatest(F.lit(1).cast("long"), F.col("pos") - 1).alias("lo"), F.least("n", F.col("pos") + 1).alias("hi"))


@query
def c1_votes(spark: SparkSession, d: str) -> DataFrame:
    return T.votes(X.sequences(spark, d))


@query
def c3_consensus_regions(spark: SparkSession, d: str) -> DataFrame:
    return T.consensus(X.sequences(spark, d)).select("seq_id", "start", "end", "length", "top")


@query
def c4_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = X.sequences(spark, d)
    return T.regions(s.withColumn("seq_id", F.struct("seq_id", "n"))).groupBy("seq_id", "method").agg(F.sum("length").alias("called")).select("seq_id.seq_id", "method", "called", F.round(100 * F.col("called").cast("double") / F.col("seq_id.n"), 6).alias("coverage"))


@query
def d1_kmers(spark: SparkSession, d: str) -> DataFrame:
    return P.kmers(X.sequences(spark, d), 9)


@query
def d2_strided_kmers(spark: SparkSession, d: str) -> DataFrame:
    return P.kmers(X.sequences(spark, d), 15, P.stride(15, 1))


@query
def d3_standard_kmers(spark: SparkSession, d: str) -> DataFrame:
    raw = X.table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")).withColumn("n", F.length("seq").cast("long"))
    return P.kmers(raw, 9).where(P.standard(F.col("peptide"))).groupBy("seq_id").agg(F.count("*").alias("kept"))


@query
def d20_binder_census(spark: SparkSession, d: str) -> DataFrame:
    a = A.clean(X.assays(spark, d)).withColumn("ic50", A.affinity(F.col("quant"), F.col("qual")))
    return a.groupBy("seq_id", "allele").agg(F.count("*").alias("total"), F.count_if(F.col("ic50") < 50).alias("strong"), F.count_if((F.col("ic50") >= 50) & (F.col("ic50") < 500)).alias("weak"))


@query
def e1_n_glycosylation(spark: SparkSession, d: str) -> DataFrame:
    return M.n_glycosylation(X.sequences(spark, d))


@query
def f3_protrusion(spark: SparkSession, d: str) -> DataFrame:
    return S.protrusion(X.residues3d(spark, d)).select("structure_id", "idx", F.round("protrusion", 6).alias("protrusion"))


@query
def f4_contacts(spark: SparkSession, d: str) -> DataFrame:
    return S.contact_number(X.residues3d(spark, d)).select("structure_id", "idx", "contacts")


@query
def f10_surface_propensity(spark: SparkSession, d: str) -> DataFrame:
    return S.surface_propensity(X.residues3d(spark, d)).select("structure_id", "idx", F.round("score", 6).alias("score"), (F.round("score", 9) >= F.round("cut", 9)).alias("called"))


@query
def f11_protrusion_by_area(spark: SparkSession, d: str) -> DataFrame:
    return S.protrusion_by_area(X.residues3d(spark, d)).select("structure_id", "idx", F.round("score", 6).alias("score"))


@query
def f15_bfactor(spark: SparkSession, d: str) -> DataFrame:
    return S.bfactor_norm(X.residues3d(spark, d)).select("structure_id", "idx", F.round("flexibility", 6).alias("flexibility"))


@query
def g1_clean_assays(spark: SparkSession, d: str) -> DataFrame:
    return A.clean(X.assays(spark, d)).select("rec_id", "peptide", "allele")


@query
def g2_affinity(spark: SparkSession, d: str) -> DataFrame:
    return X.assays(spark, d).select("rec_id", F.round(A.affinity(F.col("quant"), F.col("qual")), 6).alias("ic50"))


@query
def g3_top_alleles(spark: SparkSession, d: str) -> DataFrame:
    return A.allele_counts(A.clean(X.assays(spark, d)), 20, 30)


@query
def g4_mhc_class(spark: SparkSession, d: str) -> DataFrame:
    return X.assays(spark, d).groupBy(A.mhc_class(F.col("allele")).alias("mhc_class")).agg(F.count("*").alias("n"))


def claimed(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """seq_id, n, pep_id, pattern, at, exact: the reference peptides in the sequences. Every third is claimed a place too far."""
    peptides = X.ref_peptides(spark, d).select("pep_id", F.col("peptide").alias("pattern"))
    found = SD.occurrences(s.select("seq_id", "n", "seq"), peptides).join(peptides, "pattern")
    return SD.validated(found, "pep_id", F.col("first") + F.when(F.col("pep_id") % 3 == 0, 1).otherwise(0))


@query
def h4_validated_positions(spark: SparkSession, d: str) -> DataFrame:
    v = claimed(spark, d, X.curated(spark, d))
    out = SD.spots(v, F.count("*").alias("matched")).select("seq_id", "n", "matched", F.size("spots").cast("long").alias("positions"))
    return out.where("matched >= 4 and positions >= 8")


@query
def h5_coverage_filter(spark: SparkSession, d: str) -> DataFrame:
    out = QUERIES["h4_validated_positions"](spark, d).withColumn("coverage", F.round(F.col("positions").cast("double") / F.col("n"), 6))
    return out.where("positions >= 0.03D * n and positions <= 0.9D * n").select("seq_id", "matched", "positions", "coverage")


@query
def h6_capped_selection(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).select("seq_id", "organism", "matched")


def _selected(spark: SparkSession, d: str) -> DataFrame:
    c = QUERIES["h4_validated_positions"](spark, d).withColumn("coverage", F.round(F.col("positions").cast("double") / F.col("n"), 6)).where("positions >= 0.03D * n and positions <= 0.9D * n")
    c = c.join(X.table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("organism")), "seq_id")
    return A.capped(c, "organism", [F.desc("matched"), F.col("seq_id")], 6, 10, 50)


@query
def h7_set_profile(spark: SparkSession, d: str) -> DataFrame:
    """Of the selected set."""
    r = lambda c: F.round(c, 6)
    return _selected(spark, d).agg(
        F.count("*").alias("sequences"), F.count_distinct("organism").alias("organisms"), F.sum("n").alias("residues"), F.sum("positions").alias("positions"), F.min("n").alias("shortest"), F.max("n").alias("longest"),
        r(F.min("coverage")).alias("least_coverage"), r(F.avg("coverage")).alias("mean_coverage"), r(F.max("coverage")).alias("most_coverage"),
    )


@query
def i2_method_rates(spark: SparkSession, d: str) -> DataFrame:
    """Covered and true places of a sequence are compared as arrays; only sequences with truth are scored."""
    out, parts, found = T.with_runs(with_truth(spark, d)), [], []
    for k, (m, (w, _)) in enumerate(METHODS.items()):
        found.append(F.flatten(F.transform(F.col(f"`r_{m}`"), lambda r: F.sequence(r["s"] + w // 2, r["e"] + w // 2))).alias(f"c_{k}"))
    out = T.held(out.select("seq_id", "n", "spots", *found))  # once, not for each of the counts
    out = T.held(out.select("*", *[F.size(F.array_intersect(f"c_{k}", "spots")).cast("long").alias(f"tp_{k}") for k in range(len(METHODS))]))
    for k, m in enumerate(METHODS):
        tp = F.col(f"tp_{k}")
        fp, fn = F.size(f"c_{k}").cast("long") - tp, F.size("spots").cast("long") - tp
        parts.append(F.struct(F.lit(m).alias("method"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (F.col("n") - tp - fp - fn).alias("tn")))
    return A.rates(out.select("seq_id", F.inline(F.array(*parts))))


def with_truth(spark: SparkSession, d: str) -> DataFrame:
    """The sequences that hold reference peptides, with ``spots``, the peptides' places."""
    s = X.sequences(spark, d)
    return s.join(SD.spots(claimed(spark, d, s)).drop("n"), "seq_id")


@query
def i5_distribution(spark: SparkSession, d: str) -> DataFrame:
    m = QUERIES["c4_coverage"](spark, d)
    r = lambda c: F.round(c, 4)
    return m.groupBy("method").agg(r(F.avg("coverage")).alias("mean"), r(F.stddev_pop("coverage")).alias("sd"), r(F.median("coverage")).alias("median"), r(F.min("coverage")).alias("low"), r(F.max("coverage")).alias("top"))


@query
def i6_auc(spark: SparkSession, d: str) -> DataFrame:
    res = X.residues3d(spark, d).withColumn("truth", F.col("chain_id") == "H")
    return A.auc(res, "structure_id", "sasa", "truth")
