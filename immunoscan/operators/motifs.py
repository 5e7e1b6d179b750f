"""Motif scans with positions, and glycosylation sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tracks import held, letters, upto

# Named patterns, their scores and notes. A basic patch counts 0.5, and 0.1 for each of up to three letters beyond three.
PATTERNS = {
    "flagellin_n_terminal": "[AILMV]{2,4}[ST][AILMV]{1,3}N",
    "flagellin_c_terminal": "[QN][AILMV]{2,3}[ST][AILMV]{2}",
    "lps_binding": "[KR]{2,}[AILMFVWY]{2,}|[AILMFVWY]{2,}[KR]{2,}",
    "basic_patch": "[KRH]{3,}",
    "hydrophobic_patch": "[AILMFVWY]{4,}",
}
NOTES = {
    "flagellin_n_terminal": "TLR5 ligand - flagellin N-terminal conserved region",
    "flagellin_c_terminal": "TLR5 ligand - flagellin C-terminal conserved region",
    "lps_binding": "Potential LPS-binding region (basic/hydrophobic patch)",
    "basic_patch": "Basic patch - potential LPS/nucleic acid binding",
    "hydrophobic_patch": "Hydrophobic patch - potential membrane interaction",
}
SCORES = {"flagellin_n_terminal": 0.8, "flagellin_c_terminal": 0.8, "lps_binding": 0.6, "hydrophobic_patch": 0.4}
# Immunostimulatory patterns. RGD counts 0.8 with its fourth letter, else 0.7; a basic patch 0.5 and 0.1 a letter, 0.9 at most.
STIMULATING = {"rgd": "RGD[SFWV]?", "rgd_variant": "[KR]GD[SFWV]|RG[DN][SFWV]", "basic_patch": "[KR]{4,}", "cationic_dipeptide": "[KR][KR]", "polyproline": "P{3,}"}
STIMULATING_SCORES = {"rgd_variant": 0.5, "cationic_dipeptide": 0.3, "polyproline": 0.4}


def with_hits(seqs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``seqs`` with h_<name>, an array of (start, end, motif) of the pattern's leftmost non-overlapping matches.

    Each match is put between two marks. The i-th opening mark has 2i marks before it and the i-th closing one 2i + 1, so places
    follow from where the marks are: one pass over the letters a pattern, however many matches there are."""
    names, own = list(patterns), seqs.columns
    letters_ = [F.split(F.regexp_replace("seq", f"({patterns[n]})", "<$1>"), "").alias(f"m_{n}") for n in names]
    out = held(seqs.select(*own, *letters_))
    places = lambda n, mark: F.filter(F.sequence(F.lit(0), F.size(f"m_{n}") - 1), lambda k: F.col(f"m_{n}")[k] == mark)
    marks = [F.transform(places(n, "<"), lambda k, i: (k - 2 * i + 1).cast("long")).alias(f"a_{n}") for n in names] + [F.transform(places(n, ">"), lambda k, i: (k - 2 * i - 1).cast("long")).alias(f"b_{n}") for n in names]
    out = held(out.select(*own, *marks, *[F.regexp_extract_all("seq", F.lit(patterns[n]), F.lit(0)).alias(f"t_{n}") for n in names]))
    rows = lambda n: F.transform(f"a_{n}", lambda a, i: F.struct(a.alias("start"), F.col(f"b_{n}")[i].alias("end"), F.col(f"t_{n}")[i].alias("motif")))
    return out.select(*own, *[rows(n).alias(f"h_{n}") for n in names])


def find(seqs: DataFrame, name: str, pattern: str) -> DataFrame:
    """Leftmost non-overlapping matches: seq_id, name, start, end, motif."""
    return with_hits(seqs.select("seq_id", "seq"), {name: pattern}).select("seq_id", F.lit(name).alias("name"), F.inline(f"h_{name}"))


def suppressed(inner: Column, outer: Column) -> Column:
    """Starts of the matches of ``inner`` that don't start within one of ``outer``."""
    covered = F.flatten(F.transform(outer, lambda h: F.sequence(h["start"], h["end"])))
    return F.array_except(F.transform(inner, lambda h: h["start"]), covered)


def n_sites() -> Column:
    """pos, site_type, score of the N-x-S/T/C sites of a row of ``letters``."""
    at = lambda i: F.get("aa", i)

    def site(i):
        after, third = at(i), at(i + 1)
        score = F.least(F.lit(1.0), F.when(third == "T", 1.05).otherwise(1.0) * F.when(at(i - 2).isin("D", "E", "P"), 0.8).otherwise(1.0) * F.when(at(i + 2).isin("D", "E", "P"), 0.9).otherwise(1.0))
        kind = F.when(after == "P", "proline").when(third == "C", "cysteine").otherwise("canonical")
        value = F.when(after == "P", 0.1).when(third == "C", 0.3).otherwise(score)
        return F.struct(i.cast("long").alias("pos"), kind.alias("site_type"), F.round(value, 6).alias("score"))

    spots = F.filter(upto(F.col("n") - 2), lambda i: (at(i - 1) == "N") & F.when(at(i) == "P", at(i + 1).isin("S", "T")).otherwise(at(i + 1).isin("S", "T", "C")))
    return F.transform(spots, site)


def n_glycosylation(seqs: DataFrame) -> DataFrame:
    """seq_id, pos, site_type, score of N-x-S/T/C sites, from the sequence's own letters."""
    return held(letters(seqs)).select("seq_id", F.inline(n_sites()))


def _patch(size: Column) -> Column:
    return F.round(0.5 + 0.1 * F.least(size - 3, F.lit(3)), 6)


def scored(name: str, score=None) -> Column:
    """name, start, end, motif, score of a pattern's matches, of a row of ``with_hits``; scored as a receptor motif if no score is given."""
    score = SCORES.get(name, _patch) if score is None else score
    return F.transform(F.col(f"h_{name}"), lambda h: F.struct(F.lit(name).alias("name"), h["start"].alias("start"), h["end"].alias("end"), h["motif"].alias("motif"), (F.lit(score) if isinstance(score, float) else score(F.length(h["motif"]))).alias("score")))


def stimulating_hits() -> Column:
    """name, start, end, motif, score of the matches of STIMULATING, of a row of ``with_hits``. A variant that starts where an RGD motif does is left out; an RGD
    motif starts wherever RGD does."""
    scores = STIMULATING_SCORES | {"rgd": lambda size: F.when(size > 3, 0.8).otherwise(0.7), "basic_patch": lambda size: F.round(F.least(F.lit(0.9), 0.5 + 0.1 * size), 6)}
    return F.filter(F.concat(*[scored(n, scores[n]) for n in STIMULATING]), lambda h: (h["name"] != "rgd_variant") | ~F.startswith(h["motif"], F.lit("RGD")))


def receptor_motifs(seqs: DataFrame) -> DataFrame:
    """seq_id, name, start, end, motif, score, annotation of the patterns for TLR5 and TLR4 ligands."""
    rows = with_hits(seqs.select("seq_id", "seq"), PATTERNS).select("seq_id", F.inline(F.concat(*[scored(n) for n in PATTERNS])))
    notes = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    return rows.withColumn("annotation", F.element_at(notes, F.col("name")))


def stimulating_motifs(seqs: DataFrame) -> DataFrame:
    """seq_id, name, start, end, motif, score."""
    return with_hits(seqs.select("seq_id", "seq"), STIMULATING).select("seq_id", F.inline(stimulating_hits()))
