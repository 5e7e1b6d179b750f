"""O-glycosylation, signal peptides, helix windows, and summaries over the innate features of sequences.

Local jobs work on a sequence's own letters; sums are kept in whole numbers, so ties and thresholds are exact.
"""

from __future__ import annotations

import math
import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims as D
from . import arrays as R
from .arrays import codes_of, pieces_of, rounded
from .motifs import PATTERNS, SCORES, STIMULATING
from .tracks import count, held, letters, upto, valued

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

MERGED = "struct<start:int,end:int,points:int>"


def is_in(letter: Column, kinds: str) -> Column:
    return F.coalesce(letter.isin(*kinds), F.lit(False))


def o_sites() -> Column:
    """pos, points (of 10000), motif of the S and T of a row of ``o_ready``."""
    at = lambda i: F.get("aa", i - 1)

    def site(i):
        first = F.greatest(F.lit(1), i - 5)
        around = F.aggregate(F.slice("v_", first, i + 6 - first), F.lit(0), lambda a, x: a + x) - F.get("v_", i - 1)
        points = 500 + around + F.when(at(i - 1) == "P", 250).otherwise(0) + F.when(at(i + 3) == "P", 200).otherwise(0)
        low = F.greatest(F.lit(1), i - 2)
        points = F.greatest(F.lit(0), F.least(F.lit(10000), points * F.when(at(i) == "T", 11).otherwise(10)))
        return F.struct(i.cast("long").alias("pos"), points.alias("points"), F.array_join(F.slice("aa", low, i + 3 - low), "").alias("motif"))

    spots = F.filter(upto(F.col("n")), lambda i: is_in(at(i), "ST"))
    scored = lambda x: (F.floor((x["points"] + 5) / 10).cast("double") / 1000).alias("score")
    kind = lambda x: F.when(x["points"] >= 7000, "high").when(x["points"] >= 5000, "medium").otherwise("low").alias("site_type")
    rows = F.transform(F.transform(spots, site), lambda x: F.struct(x["pos"].alias("pos"), scored(x), x["motif"].alias("motif"), kind(x)))
    return F.filter(rows, lambda x: x["score"] >= 0.4)


def o_ready(seqs: DataFrame) -> DataFrame:
    """``letters`` with what each letter adds to an O-glycosylation site near it."""
    return held(letters(seqs).withColumn("v_", valued("code", [D.O_GLYCO.get(a, 0) for a in D.AA], 0)))


def o_glycosylation(seqs: DataFrame) -> DataFrame:
    """seq_id, pos, score, motif, site_type of S and T that score 0.4 at least."""
    return o_ready(seqs).select("seq_id", F.inline(o_sites()))


def signal_rules(seqs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """seq_id, the columns to keep, is_signal, cleavage_position, confidence, n_score, h_score, c_score by the rules for the three regions; a sequence
    under 15 letters has none. Of equal cleavage candidates the first wins."""
    out = letters(seqs.withColumn("full_", F.col("n")).withColumns({"seq": F.substring("seq", 1, 32), "n": F.least(F.col("n"), F.lit(32).cast("long"))}))
    at = lambda p: F.get("aa", F.lit(p) - 1 if isinstance(p, int) else p - 1)
    basic = sum((is_in(at(p), D.BASIC).cast("int") for p in range(1, 6)), F.lit(0))
    n_score = F.least(F.lit(10), F.least(F.lit(10), 4 * basic) + F.when(is_in(at(2), D.BASIC), 2).otherwise(0)).cast("double") / 10
    core = F.slice(valued("code", D.HYDROPATHY, 0), 6, 15)
    mean = F.aggregate(core, F.lit(0), lambda a, x: a + x).cast("double") / (10 * count(core))
    h_score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean + 1) / 4))

    def points(p):
        one, three, two = at(p), at(p - 2), at(p - 1)
        out = F.when(one == "A", 40).when(is_in(one, D.CLEAVABLE), 25).otherwise(0) + F.when(three == "A", 30).when(is_in(three, D.CLEAVABLE), 20).otherwise(0)
        return out - F.when(is_in(one, D.BASIC + D.ACIDIC), 30).otherwise(0) + F.when(is_in(two, "GP"), 10).otherwise(0)

    spots = F.when(F.least(F.lit(30), F.col("full_") - 1) >= 15, F.sequence(F.lit(15), F.least(F.lit(30), F.col("full_") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.filter(F.transform(spots, lambda p: F.struct(points(p).alias("c"), (-p).alias("p"))), lambda r: r["c"] > 0))
    out = out.withColumns({"n_": n_score, "h_": h_score, "b_": best}).withColumn("c_", F.least(F.lit(1.0), F.coalesce(F.col("b_.c"), F.lit(0)).cast("double") / 100))
    confidence = F.col("n_") * 0.2 + F.col("h_") * 0.5 + F.col("c_") * 0.3
    long = F.col("full_") >= 15
    signal = long & (F.round(confidence, 9) >= 0.5) & (F.round("h_", 9) >= 0.3) & F.col("b_").isNotNull()
    three = lambda c: F.when(long, F.round(F.round(c, 9), 3)).otherwise(0.0)
    return out.select("seq_id", *keep, signal.alias("is_signal"), F.when(signal, 1 - F.col("b_.p")).cast("long").alias("cleavage_position"), three(confidence).alias("confidence"), three("n_").alias("n_score"), three("h_").alias("h_score"), three("c_").alias("c_score"))


FACES = [np.array([0, *(int(a in kinds) for a in D.AA)]) for kinds in (D.HYDROPHOBIC, D.POLAR + D.BASIC + D.ACIDIC)]
O_VALUES = np.array([0, *(D.O_GLYCO.get(a, 0) for a in D.AA)])


def helix_spans(codes: np.ndarray, merge: bool, width: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Starts, from 0, and points (of 60) of the windows with a hydrophobic and a hydrophilic face. Merged, left to right: of overlapping windows the one
    with more points stays; what overlaps is judged by the one that stays."""
    size = max(0, len(codes) - width + 1)
    inner, outer = (face[codes] for face in FACES)
    points = 6 * sum(inner[p : p + size] for p in (0, 3, 4, 7, 8)) + 5 * sum(outer[p : p + size] for p in (1, 2, 5, 6, 9, 10))
    at = np.flatnonzero(points >= 36)
    if not merge or not len(at):
        return at, points[at]
    kept, now, most = [], -width, -1
    for s, p in zip(at.tolist(), points[at].tolist(), strict=True):
        if s >= now + width:
            kept.append(s)
            now, most = s, p
        elif p > most:
            kept[-1] = now = s
            most = p
    at = np.array(kept)
    return at, points[at]


def n_spots(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places from 0 of the N-x-S/T/C sites, whether x is P, and whether the third letter is C."""
    size = max(0, len(text) - 2)
    second, third = text[1 : 1 + size], text[2 : 2 + size]
    fits = (third == ord("S")) | (third == ord("T")) | ((third == ord("C")) & (second != ord("P")))
    at = np.flatnonzero((text[:size] == ord("N")) & fits)
    return at, second[at] == ord("P"), third[at] == ord("C")


def n_scores(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from 0 of these sites and their scores."""
    at, proline, cysteine = n_spots(text)
    padded = np.concatenate(([0], text, [0, 0]))  # a letter's own place is one further here
    poor = lambda x: np.isin(x, [ord(c) for c in "DEP"])
    score = np.where(padded[at + 3] == ord("T"), 1.05, 1.0) * np.where(poor(padded[at]), 0.8, 1.0) * np.where(poor(padded[at + 4]), 0.9, 1.0)
    return at, rounded(np.where(proline, 0.1, np.where(cysteine, 0.3, np.minimum(1.0, score))))


def o_points(text: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from 0 and points (of 10000) of the S and T that score 0.4 at least."""
    at = np.flatnonzero((text == ord("S")) | (text == ord("T")))
    value = O_VALUES[codes]
    added = np.concatenate(([0], np.cumsum(value)))
    around = added[np.minimum(len(text), at + 6)] - added[np.maximum(0, at - 5)] - value[at]
    padded = np.concatenate(([0], text, [0, 0, 0]))
    points = 500 + around + 250 * (padded[at] == ord("P")) + 200 * (padded[at + 4] == ord("P"))
    points = np.clip(points * np.where(text[at] == ord("T"), 11, 10), 0, 10000)
    high = (points + 5) // 10 >= 400
    return at[high], points[high]


def bytes_of(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)


def merged(spans: str) -> Column:
    """Left to right, of overlapping spans the one with more points stays; what overlaps is judged by the span that stays. ``spans`` names an
    array of start, end, points, by start.

    What stays is gathered in blocks of as many spans as the root of their number, so a list of k spans is copied some 2 sqrt(k) times and not k."""
    state = f"struct<now:{MERGED},out:array<{MERGED}>>"
    state_of = lambda now, out: F.struct(now.alias("now"), out.alias("out")).cast(state)
    no_span, empty = F.lit(None).cast(MERGED), F.array().cast(f"array<{MERGED}>")

    def step(a, x):
        now = a["now"]
        apart = state_of(x, F.when(now.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(now))))
        return F.when(now.isNull() | (x["start"] > now["end"]), apart).when(x["points"] > now["points"], state_of(x, a["out"])).otherwise(a)

    size = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(spans))).cast("int"))
    blocks = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), size)).otherwise(F.array().cast("array<int>"))
    block = lambda a, first: F.aggregate(F.slice(spans, first, size), state_of(a["now"], empty), step, lambda r: state_of(r["now"], F.concat(a["out"], r["out"])))
    return F.aggregate(blocks, state_of(no_span, empty), block, lambda a: F.when(a["now"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["now"]))))


def helices(seqs: DataFrame, merge: bool = True) -> DataFrame:
    """seq_id, start, end, motif, score of the helix windows, merged or all."""

    def rows(seq):
        at, points = helix_spans(codes_of(seq), merge)
        return [at + 1, at + 11, pieces_of(seq, at, 11), rounded(points / 60, 3)]

    return R.exploded(seqs, ["seq_id"], "start long, end long, motif string, score double", rows)


def summary(seqs: DataFrame) -> DataFrame:
    """One row a sequence: counts of each kind of site and motif, whether there is a signal peptide or an RGD text. All of it is
    counted in the sequence's own letters."""
    signal = signal_rules(seqs.where("n > 0").select("seq_id", "n", "seq", F.struct("seq", "n").alias("whole_")), ["whole_"]).select("seq_id", "whole_.seq", "whole_.n", "is_signal", "confidence")
    receptor, stimulating = ([re.compile(p) for n, p in patterns.items() if n != "rgd_variant"] for patterns in (PATTERNS, STIMULATING))
    rgd, variant = re.compile(STIMULATING["rgd"]), re.compile(STIMULATING["rgd_variant"])
    many = lambda pattern, seq: sum(1 for _ in pattern.finditer(seq))

    def rows(seq):
        text, codes = bytes_of(seq), codes_of(seq)
        kept = helix_spans(codes, True)[0].tolist()
        at, proline, cysteine = n_spots(text)
        points = o_points(text, codes)[1]
        # an RGD text is a match of the RGD pattern itself, which starts wherever RGD does, so a helix window with one has a match too
        found = sum(many(p, seq) for p in stimulating) + sum(1 for m in variant.finditer(seq) if not m.group().startswith("RGD")) + len(kept)
        numbers = [len(at), int((~proline & ~cysteine).sum()), len(points), int((points >= 7000).sum()), sum(many(p, seq) for p in receptor), found]
        return [*[[v] for v in numbers], [rgd.search(seq) is not None]]

    names = ("n_sites", "canonical", "o_sites", "high_o", "receptor_motifs", "stimulating_motifs")
    return R.exploded(signal, ["seq_id", "n", "is_signal", "confidence"], ", ".join(f"{c} long" for c in names) + ", has_rgd boolean", rows)


def motif_score(m: re.Match, fixed: float | None) -> float:
    """What a receptor motif scores: its pattern's fixed score, else by its length."""
    return round(0.5 + 0.1 * min(m.end() - m.start() - 3, 3), 6) if fixed is None else fixed


def consensus(seqs: DataFrame) -> DataFrame:
    """seq_id, pos, score: 0.3 of each glycosylation score and 0.4 of every receptor motif that covers the residue."""
    patterns = [(re.compile(p), SCORES.get(n)) for n, p in PATTERNS.items()]

    def rows(seq):
        text, (n, o, motifs) = bytes_of(seq), np.zeros((3, len(seq)))
        at, score = n_scores(text)
        n[at] = score
        at, points = o_points(text, codes_of(seq))
        o[at] = (points + 5) // 10 / 1000
        for pattern, fixed in patterns:
            for m in pattern.finditer(seq):
                motifs[m.start() : m.end()] += motif_score(m, fixed)
        return [np.arange(1, len(seq) + 1), 0.3 * n + 0.3 * o + 0.4 * motifs]

    return R.exploded(seqs, ["seq_id"], "pos long, score double", rows)


def dense(seqs: DataFrame) -> DataFrame:
    """seq_id, pos, n_glyco, o_glyco, receptor, signal for every residue: a site's score, the greatest score of the motifs that
    cover it, the confidence within a signal peptide; else 0."""
    signal = signal_rules(seqs.where("n > 0").select("seq_id", "n", "seq", F.struct("seq", "n").alias("whole_")), ["whole_"])
    signal = signal.select("seq_id", "whole_.seq", "whole_.n", F.when(F.col("is_signal"), F.col("cleavage_position")).alias("upto_"), "confidence")
    patterns = [(re.compile(p), SCORES.get(n)) for n, p in PATTERNS.items()]

    def rows(seq, upto_, confidence):
        text, (n, o, motifs, head) = bytes_of(seq), np.zeros((4, len(seq)))
        at, score = n_scores(text)
        n[at] = score
        at, points = o_points(text, codes_of(seq))
        o[at] = (points + 5) // 10 / 1000
        for pattern, fixed in patterns:
            for m in pattern.finditer(seq):
                part = motifs[m.start() : m.end()]
                np.maximum(part, motif_score(m, fixed), out=part)
        head[: upto_ or 0] = confidence
        return [np.arange(1, len(seq) + 1), n, o, motifs, head]

    return R.exploded(signal, ["seq_id"], "pos long, n_glyco double, o_glyco double, receptor double, signal double", rows, given=["upto_", "confidence"])


def first_letters(seqs: DataFrame, size: int = 70) -> DataFrame:
    """seq_id, seq, n of sequences cut to their first letters: all that the signal's rules, features and cuts look at."""
    return seqs.select("seq_id", F.substring("seq", 1, size).alias("seq"), F.least(F.col("n"), F.lit(size).cast("long")).alias("n"))


def heads(seqs: DataFrame, size: int = 70) -> DataFrame:
    """``letters`` of the first letters, with ``hydro``, their hydropathy in tenths."""
    out = letters(seqs.withColumns({"seq": F.substring("seq", 1, size), "n": F.least(F.col("n"), F.lit(size).cast("long"))}))
    return out.withColumn("hydro", valued("code", D.HYDROPATHY, 0))


def add(array: str, first: Column, size: int) -> Column:
    return F.aggregate(F.slice(array, first, size), F.lit(0), lambda a, x: a + x)


def cut_points(p: Column) -> Column:
    """What a cut after letter ``p`` counts by its context, in tenths."""
    at = lambda i: F.get("aa", i - 1)
    one = F.when(at(p) == "A", 20).when(is_in(at(p), "GSC"), 15).when(is_in(at(p), "TV"), 5).otherwise(0)
    three = F.when(at(p - 2) == "A", 15).when(is_in(at(p - 2), "GSCVLI"), 10).when(is_in(at(p - 2), "TF"), 3).otherwise(0)
    two = F.when(is_in(at(p - 1), "PG"), -5).otherwise(0)
    before, after = add("hydro", F.greatest(F.lit(1), p - 9), 7), add("hydro", p + 1, 5)
    context = F.when((p >= 10) & (p < F.col("n") - 5) & (before > 105) & (7 * after < 5 * before), 10).otherwise(0)
    return one + three + two + context


def cut_sites(seqs: DataFrame) -> DataFrame:
    """``heads`` with ``cut``, the best place to cut after (15 to 35, the first of equals, 20 if there is none), and ``cut_score``."""
    out = heads(seqs)
    last = F.least(F.lit(35), F.col("n") - 1).cast("int")
    spots_ = F.when(last >= 15, F.sequence(F.lit(15), last)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("b_", F.array_max(F.transform(spots_, lambda p: F.struct(cut_points(p).alias("c"), (-p).alias("p")))))
    return out.withColumns({"cut": F.coalesce(-F.col("b_.p"), F.lit(20)), "cut_score": F.col("b_.c").cast("double") / 10}).drop("b_")


def best_stretch(limit: Column) -> Column:
    """``c, w, s``: of the windows of 7 to 15 letters within the first ``limit`` whose mean hydropathy is 1 at least, the one with
    the greatest sum; the narrowest, then the first, of equals. w and s are negative."""
    parts = [F.transform(upto(F.least(limit, F.col("n")) - w + 1), lambda s: F.struct(add("hydro", s, w).alias("c"), F.lit(-w).alias("w"), (-s).alias("s"))) for w in range(7, 16)]  # noqa: B023
    return F.array_max(F.filter(F.concat(*parts), lambda r: r["c"] >= -10 * r["w"]))


def stretches(seqs: DataFrame, limit: int = 40) -> DataFrame:
    """seq_id, start (from 0), length, mean of the best hydrophobic stretch; zeros if there is none."""
    out = heads(seqs).withColumn("b_", best_stretch(F.lit(limit)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    mean = F.round(F.coalesce(F.col("b_.c").cast("double") / (-10 * F.col("b_.w")), F.lit(0.0)), 6)
    return out.select("seq_id", zero(-F.col("b_.s") - 1).alias("start"), zero(-F.col("b_.w")).alias("length"), mean.alias("mean"))


def segments(seqs: DataFrame) -> DataFrame:
    """seq_id, cut, and start and end of the n, h and c regions."""
    out = cut_sites(seqs.where("n >= 15")).withColumn("b_", best_stretch(F.col("cut")))
    n_end = F.when(F.col("cut") > 15, F.least(F.lit(5), F.col("cut") - 10)).otherwise(3)
    h_start = F.coalesce(-F.col("b_.s"), n_end + 1)
    h_end = F.coalesce(-F.col("b_.s") - F.col("b_.w") - 1, F.col("cut") - 5)
    named = {"cut": F.col("cut"), "n_start": F.lit(1), "n_end": n_end, "h_start": h_start, "h_end": h_end, "c_start": h_end + 1, "c_end": F.col("cut")}
    return out.select("seq_id", *[c.cast("long").alias(k) for k, c in named.items()])


def axa_points(first: Column, last: Column) -> Column:
    one = F.when(first == "A", 10).when(is_in(first, D.SMALL), 7).when(is_in(first, "VLI"), 3).otherwise(0)
    two = F.when(last == "A", 12).when(is_in(last, D.SMALL), 8).otherwise(0)
    return one + two + F.when((first == "A") & (last == "A"), 5).otherwise(0)


def axa(seqs: DataFrame, first: int = 16, last: int = 30) -> DataFrame:
    """seq_id, axa: the greatest A-x-A credit of the triples of a stretch of letters, over its greatest possible value."""
    out = heads(seqs)
    stop = F.least(F.lit(last), F.col("n")).cast("int") - 2
    triples = F.when(stop >= first, F.sequence(F.lit(first), stop)).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(triples, lambda i: axa_points(F.get("aa", i - 1), F.get("aa", i + 1))))
    return out.select("seq_id", F.round(F.coalesce(best, F.lit(0)).cast("double") / 27, 6).alias("axa"))


def cut_log_odds(seqs: DataFrame) -> DataFrame:
    """seq_id, cut, log_odds: of the letters around the place, which is used as an index from 0."""
    out = cut_sites(seqs.where("n >= 15"))
    score = F.lit(0.0)
    for offset, shares in D.CUT_SHARES.items():
        odds = [math.log(shares.get(a, 0.01) / 0.05) for a in D.AA]
        table = F.array(F.lit(math.log(0.01 / 0.05)), *[F.lit(v) for v in odds])
        score = score + F.coalesce(F.get(table, F.get("code", F.col("cut") + offset)), F.lit(0.0))  # a place beyond the end counts 0; table[null] would fail
    return out.select("seq_id", F.col("cut").cast("long").alias("cut"), F.round(score, 6).alias("log_odds"))
