"""Binding, cleavage and transport scores of the windows of sequences, and of single peptides.

Scores stay in the sequence's own arrays until the last step, in thousandths, so the jobs need no exchange.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrices as M
from . import arrays as R
from .arrays import codes_of, pieces_of, rounded, window_sums
from .peptides import ic50_of, percentile_of
from .tracks import held, letters, upto

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def class_one(seqs: DataFrame, alleles: list[str], k: int = 9) -> DataFrame:
    """``letters`` with an array of window scores for each allele, named by it."""
    out = letters(seqs)
    return held(out.withColumns({a: M.window_scores("code", M.anchored(M.CLASS_ONE[a], k)) for a in alleles}))


def exploded(df: DataFrame, **arrays: Column) -> DataFrame:
    """seq_id, start and one column an array of equal length, one row a place."""
    named = df.withColumns({f"z_{n}": a for n, a in arrays.items()})
    each = named.select("seq_id", F.posexplode(F.arrays_zip(*[f"z_{n}" for n in arrays])).alias("p", "x"))
    return each.select("seq_id", (F.col("p") + 1).cast("long").alias("start"), *[F.col("x")[f"z_{n}"].alias(n) for n in arrays])


def milli(c) -> Column:
    return F.col(c).cast("double") / 1000 if isinstance(c, str) else c.cast("double") / 1000


def binders(seqs: DataFrame, allele: str, least: float = 0.5, k: int = 9) -> DataFrame:
    """seq_id, start, end, peptide, score, ic50, pct_rank of windows that score at least this."""
    out, s = class_one(seqs, [allele], k), F.col(f"`{allele}`")
    hits = F.filter(upto(F.size(s)), lambda i: s[i - 1] >= round(1000 * least))
    each = out.select("seq_id", F.inline(F.transform(hits, lambda i: F.struct(i.cast("long").alias("start"), F.array_join(F.slice("aa", i, k), "").alias("peptide"), milli(s[i - 1]).alias("score")))))
    ic50 = ic50_of(F.col("score"))
    return each.select("seq_id", "start", (F.col("start") + k - 1).alias("end"), "peptide", "score", F.round(ic50, 6).alias("ic50"), F.round(percentile_of(ic50), 6).alias("pct_rank"))


def windows(seqs: DataFrame, **matrices: M.Matrix) -> DataFrame:
    """seq_id, start and one column a matrix: the scores of the windows that start there; null where only others have one."""

    def rows(seq):
        codes = codes_of(seq)
        scores = [window_sums(codes, m) / 1000 for m in matrices.values()]
        size = max(map(len, scores))
        return [np.arange(1, size + 1), *[np.concatenate((s, np.full(size - len(s), np.nan))) for s in scores]]

    return R.exploded(seqs, ["seq_id"], "start long, " + ", ".join(f"{n} double" for n in matrices), rows)


def best_cores(seqs: DataFrame, alleles: list[str], k: int = 15) -> DataFrame:
    """seq_id, start, and for the n-th allele core_n (from 1, the first of equals) and score_n of its best 9-mer core in each k-mer."""
    matrices = [M.anchored(M.CLASS_TWO[a]) for a in alleles]

    def rows(seq):
        size, codes = max(0, len(seq) - k + 1), codes_of(seq)
        out = [np.arange(1, size + 1)]
        for m in matrices:
            cores = window_sums(codes, m)
            best, place = cores[:size].copy(), np.ones(size, np.int64)
            for j in range(1, k - 8):
                other = cores[j : j + size]
                place[other > best] = j + 1
                np.maximum(best, other, out=best)
            out += [place, best]
        return out

    return R.exploded(seqs, ["seq_id"], "start long, " + ", ".join(f"core_{n} long, score_{n} int" for n in range(len(alleles))), rows)


def cut_places(seqs: DataFrame) -> DataFrame:
    """seq_id, pos, score, context (the letters around, cut after the third) of the places 7 to n - 6."""
    matrix = M.sparse(M.CLEAVAGE, -6, 6)

    def rows(seq):
        scores = window_sums(codes_of(seq), matrix)
        at = np.arange(len(scores))
        return [at + 7, scores / 1000, pieces_of(seq, at + 3, 7)]

    out = R.exploded(seqs, ["seq_id"], "pos long, score double, context string", rows)
    return out.withColumn("context", F.concat(F.substring("context", 1, 3), F.lit("|"), F.substring("context", 4, 4)))


def cores_of(peptide: Column, values: list[Column]) -> Column:
    """``s, i``: the greatest of the values of a peptide's cores and its place from 0, the first of equals."""
    return F.greatest(*[F.struct(v.alias("s"), F.lit(-j).alias("i")) for j, v in enumerate(values)])


def preferred_core(peptides: DataFrame, allele: str, shortest: int = 13, longest: int = 25) -> DataFrame:
    """Adds core, core_start (from 0), score, ic50, level, flank_n, flank_c, error: the core with the greatest anchor
    preference. Peptides of other lengths get the error."""
    matrix = M.sparse(M.PREFERENCE[allele], 1, 9)
    size = F.length("peptide")
    values = [F.when(size >= j + 9, M.peptide_score(F.substring("peptide", j + 1, 9), matrix)) for j in range(longest - 8)]
    best = F.greatest(*[F.when(v.isNotNull(), F.struct(v.alias("s"), F.lit(-j).alias("i"))) for j, v in enumerate(values)])
    fits = size.between(shortest, longest)
    out = peptides.withColumn("best_", F.when(fits, best))
    at = -F.col("best_.i")
    score = milli("best_.s")
    ic50 = ic50_of(score, 0.6)
    return out.select(
        *peptides.columns, F.when(fits, F.substr("peptide", at + 1, F.lit(9))).alias("core"), at.cast("long").alias("core_start"), score.alias("score"), F.round(ic50, 6).alias("ic50"),
        F.when(~fits, "Error").when(ic50 < 50, "Strong").when(ic50 < 500, "Moderate").when(ic50 < 5000, "Weak").otherwise("Non-binder").alias("level"),
        F.when(fits, F.substr("peptide", F.lit(1), at)).alias("flank_n"), F.when(fits, F.substr("peptide", at + 10)).alias("flank_c"), F.when(~fits, "length").alias("error"),
    )


def three_anchor_core(peptides: DataFrame, allele: str, longest: int = 15) -> DataFrame:
    """Adds core and position (from 0): one point for each of places 1, 4 and 9 with a letter of its set; the first best wins."""
    sets = M.THREE_ANCHORS.get(allele, M.THREE_ANCHORS["other"])
    values = []
    for j in range(longest - 8):
        points = sum((F.instr(F.lit(letters_), F.substring("peptide", j + p, 1)).between(1, 20).cast("int") for p, letters_ in zip((1, 4, 9), sets, strict=True)), F.lit(0))
        values.append(F.when(F.length("peptide") >= j + 9, F.struct(points.alias("s"), F.lit(-j).alias("i"))))
    out = peptides.withColumn("best_", F.greatest(*values))
    return out.select(*peptides.columns, F.substr("peptide", 1 - F.col("best_.i"), F.lit(9)).alias("core"), (-F.col("best_.i")).cast("long").alias("position"))


def log_odds_affinity(peptides: DataFrame, odds: DataFrame) -> DataFrame:
    """Adds score, ic50, log_ic50: twice the log-odds of place 2 and of the last letter (-0.5 where not listed), half those
    of other places. ``odds``: allele, place (0 for the last letter), aa, value; a table of a few hundred rows an allele
    at most, which is brought together to one map an allele."""
    maps = odds.groupBy("allele").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "place", "aa"), "value"))).alias("odds"))
    both = peptides.join(maps, "allele")
    at = lambda place, letter: F.try_element_at("odds", F.concat_ws(":", F.lit(place), letter))
    anchors = 2 * F.coalesce(at(2, F.substring("peptide", 2, 1)), F.lit(-0.5)) + 2 * F.coalesce(at(0, F.right("peptide", F.lit(1))), F.lit(-0.5))
    score = anchors + 0.5 * sum((F.coalesce(at(p, F.substring("peptide", p, 1)), F.lit(0.0)) for p in (1, 3, 4, 5, 6, 7, 8)), F.lit(0.0))
    ic50 = ic50_of(score, 0.5, 1000.0)
    return both.select(*peptides.columns, F.round(score, 6).alias("score"), F.round(ic50, 6).alias("ic50"), F.round(F.log10(ic50), 6).alias("log_ic50"))


def learned_odds(binders: DataFrame) -> DataFrame:
    """allele, place, aa, value of places 1, 2, 3, 6 and the last: the natural logarithm of a letter's share among an allele's
    peptides over its share in all of them, one added to each count; within 2.5."""
    places = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.substring("peptide", p, 1).alias("aa")) for p in (1, 2, 3, 6)], F.struct(F.lit(0).alias("place"), F.right("peptide", F.lit(1)).alias("aa"))))
    each = binders.select("allele", places.alias("x")).select("allele", "x.place", "x.aa").groupBy("allele", "place", "aa").agg(F.count("*").alias("c"))
    own, all_, every = Window.partitionBy("allele", "place"), Window.partitionBy("place", "aa"), Window.partitionBy("place")
    value = F.log((F.col("c") + 1) / (F.sum("c").over(own) + 20)) - F.log((F.sum("c").over(all_) + 1) / (F.sum("c").over(every) + 20))
    return each.select("allele", "place", "aa", F.round(F.greatest(F.lit(-2.5), F.least(F.lit(2.5), value)), 3).alias("value"))


def reference_percentile(peptides: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds percentile: the share of the reference scores that are greater, so bind more strongly. Both tables have ``score``
    in thousandths. What is ordered in one window is a row a distinct score: a few thousand, whatever the tables' sizes."""
    counts = reference.groupBy("score").agg(F.count("*").alias("c"))
    spots = counts.unionByName(peptides.select("score").distinct().withColumn("c", F.lit(0).cast("long"))).groupBy("score").agg(F.sum("c").alias("c"))
    above = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = spots.select("score", (100 * above.cast("double") / F.sum("c").over(Window.partitionBy())).alias("percentile"))
    return peptides.join(share, "score")


def scaled(df: DataFrame, *names: str) -> DataFrame:
    """The named arrays scaled to 0..1 between their least and greatest value; 0.5 where these are equal."""
    ends = {f"{e}_{n}": f(F.col(f"`{n}`")) for n in names for e, f in (("low", F.array_min), ("high", F.array_max))}
    out = held(df.withColumns(ends))  # once an array, not for each value
    step = lambda n: F.transform(F.col(f"`{n}`"), lambda x: F.when(F.col(f"`high_{n}`") > F.col(f"`low_{n}`"), (x - F.col(f"`low_{n}`")).cast("double") / (F.col(f"`high_{n}`") - F.col(f"`low_{n}`"))).otherwise(0.5))
    return out.withColumns({n: step(n) for n in names}).drop(*ends)


def to_unit(scores: np.ndarray) -> np.ndarray:
    """Whole numbers scaled to 0..1 between their least and greatest; 0.5 where these are equal."""
    low, high = (int(scores.min()), int(scores.max())) if len(scores) else (0, 0)
    return (scores - low) / (high - low) if high > low else np.full(len(scores), 0.5)


def processing(seqs: DataFrame, allele: str, k: int = 9, weights: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """seq_id, start, combined of each window to six decimals, and whether it is 0.5 at least: the weighted sum of the scaled scores of binding, transport,
    and cleavage at the window's last letter, 0 before scaling where that has none."""
    binding, tap, cut = M.anchored(M.CLASS_ONE[allele], k), M.transport(k), M.sparse(M.CLEAVAGE, -6, 6)
    m, t, c = weights

    def rows(seq):
        codes, size = codes_of(seq), max(0, len(seq) - k + 1)
        cuts, ends = window_sums(codes, cut), np.zeros(size, np.int64)
        at = np.arange(max(0, 7 - k), min(size, len(cuts) + 7 - k))  # place j of the cuts, from 0, is that of letter j + 7
        ends[at] = cuts[at + k - 7]
        combined = m * to_unit(window_sums(codes, binding)) + t * to_unit(window_sums(codes, tap)) + c * to_unit(ends)
        return [np.arange(1, size + 1), rounded(combined), rounded(combined, 9) >= 0.5]

    return R.exploded(seqs, ["seq_id"], "start long, combined double, called boolean", rows)


def spread_scores(scores: str, k: int, n: str = "n") -> Column:
    """For each residue the greatest score of the windows that cover it, 0 at least."""
    def at(i):
        first = F.greatest(F.lit(1), i - k + 1)
        size = F.least(i, F.size(scores)) - first + 1
        return F.greatest(F.lit(0), F.when(size > 0, F.array_max(F.slice(scores, first, F.greatest(size, F.lit(0))))))

    return F.transform(upto(F.col(n)), at)


def top_windows(seqs: DataFrame, alleles: list[str], k: int = 9, top: int = 100) -> DataFrame:
    """seq_id, allele, rank, start, score of the best windows of each sequence and allele, of equal ones the first."""
    matrices = {a: M.anchored(M.CLASS_ONE[a], k) for a in alleles}

    def rows(seq):
        codes, out = codes_of(seq), []
        for a, m in matrices.items():
            scores = window_sums(codes, m)
            best = np.argsort(-scores, kind="stable")[:top]
            out.append(([a] * len(best), np.arange(1, len(best) + 1), best + 1, scores[best] / 1000))
        names, *numbers = zip(*out, strict=True)
        return [[a for part in names for a in part], *map(np.concatenate, numbers)]

    return R.exploded(seqs, ["seq_id"], "allele string, rank long, start long, score double", rows)


def adapted_score(peptide: Column, allele: str) -> Column:
    """Thousandths, for peptides of 8 to 11 letters; null for others."""
    out = F.lit(None).cast("int")
    for k in (11, 10, 9, 8):
        out = F.when(F.length(peptide) == k, M.peptide_score(peptide, M.anchored(M.CLASS_ONE[allele], k))).otherwise(out)
    return out
