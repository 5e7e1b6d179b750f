"""Position matrices as tables of thousandths, and the functions that score with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.tracks import upto
from .dims import AA, lookup, lookup_sql

# Scores at places that are no anchors; a letter not listed at an anchor; a letter outside AA.
BASE = {"A": 0.05, "C": -0.1, "D": 0.0, "E": 0.0, "F": -0.05, "G": 0.05, "H": 0.0, "I": -0.05, "K": 0.1, "L": -0.05, "M": 0.0, "N": 0.05, "P": 0.0, "Q": 0.05, "R": 0.1, "S": 0.05, "T": 0.05, "V": -0.05, "W": -0.1, "Y": 0.0}
AT_ANCHOR, UNKNOWN = -0.5, -1.0
# Anchors of class I alleles, by place of a 9-mer.
CLASS_ONE = {
    "HLA-A*02:01": {2: {"L": 1.5, "M": 1.2, "I": 0.8, "V": 0.5, "A": 0.2, "T": -0.2, "Q": -0.3}, 9: {"V": 1.8, "L": 1.5, "I": 1.2, "A": 0.3, "T": 0.1, "M": 0.5}},
    "HLA-A*01:01": {2: {"T": 1.4, "S": 1.2, "M": 0.3, "L": -0.2, "I": -0.3, "V": -0.2}, 3: {"D": 0.8, "E": 0.6, "A": 0.2}, 9: {"Y": 1.8, "F": 0.8, "W": 0.5, "L": -0.3, "V": -0.4}},
    "HLA-B*07:02": {2: {"P": 2.0, "A": 0.3, "S": 0.1, "L": -0.3, "V": -0.4}, 9: {"L": 1.6, "I": 1.0, "V": 0.8, "M": 0.6, "F": 0.4, "A": 0.2}},
}
# Anchors of class II alleles, by place of the 9-mer core.
CLASS_TWO = {
    "HLA-DRB1*01:01": {1: {"F": 1.8, "Y": 1.6, "W": 1.4, "L": 1.2, "I": 0.8, "V": 0.5, "M": 0.4}, 4: {"M": 0.8, "L": 0.6, "I": 0.4, "V": 0.3, "T": 0.2}, 6: {"N": 0.6, "Q": 0.5, "S": 0.4, "T": 0.4, "K": 0.3}, 9: {"L": 1.2, "I": 0.9, "V": 0.7, "M": 0.5, "A": 0.2}},
    "HLA-DRB1*04:01": {1: {"Y": 1.8, "F": 1.6, "W": 1.4, "L": 0.8, "I": 0.5, "V": 0.3}, 4: {"T": 0.9, "S": 0.7, "M": 0.5, "L": 0.3, "V": 0.2}, 6: {"K": 0.7, "R": 0.6, "N": 0.5, "Q": 0.4, "H": 0.3}, 9: {"R": 1.0, "K": 0.8, "Q": 0.6, "N": 0.5, "L": 0.3}},
}
# Preferred, tolerated and disfavoured letters of class II alleles, by place of the 9-mer core.
PREFERENCE = {
    "HLA-DRB1*01:01": {
        1: {"Y": 1.8, "F": 1.7, "W": 1.5, "L": 1.3, "I": 1.1, "V": 0.9, "M": 0.8, "A": 0.3, "T": 0.2, "D": -1.0, "E": -1.0, "K": -0.8, "R": -0.8, "P": -1.2, "G": -0.5},
        4: {"A": 1.0, "G": 0.9, "S": 0.8, "T": 0.7, "V": 0.3, "N": 0.3, "Q": 0.2, "W": -0.8, "F": -0.6, "Y": -0.5, "P": -0.7},
        6: {"S": 0.9, "T": 0.8, "N": 0.8, "Q": 0.7, "A": 0.6, "G": 0.4, "K": 0.3, "R": 0.2, "W": -0.6, "F": -0.5, "P": -0.8},
        9: {"L": 1.2, "I": 1.1, "V": 1.0, "M": 0.9, "F": 0.8, "A": 0.5, "Y": 0.4, "W": 0.3, "T": 0.2, "D": -0.8, "E": -0.7, "K": -0.5, "R": -0.5, "P": -1.0, "G": -0.3},
    },
    "HLA-DRB1*04:01": {
        1: {"Y": 1.9, "F": 1.8, "W": 1.6, "L": 1.0, "I": 0.8, "V": 0.4, "M": 0.3, "D": -1.2, "E": -1.1, "K": -0.9, "R": -0.8, "P": -1.3, "G": -0.6},
        4: {"T": 1.0, "S": 0.9, "Q": 0.8, "N": 0.7, "A": 0.6, "G": 0.3, "M": 0.2, "W": -0.7, "F": -0.6, "P": -0.9},
        6: {"K": 1.0, "R": 0.9, "N": 0.8, "Q": 0.7, "H": 0.6, "S": 0.4, "T": 0.3, "W": -0.5, "P": -0.9},
        9: {"R": 1.1, "K": 1.0, "Q": 0.8, "N": 0.7, "L": 0.5, "H": 0.4, "Y": 0.3, "I": 0.3, "D": -0.6, "E": -0.5, "P": -1.0},
    },
    "HLA-DRB1*07:01": {
        1: {"L": 1.5, "I": 1.4, "V": 1.3, "F": 1.2, "Y": 1.1, "W": 1.0, "M": 0.5, "A": 0.3, "D": -1.1, "E": -1.0, "K": -0.7, "R": -0.6, "P": -1.2, "G": -0.5},
        4: {"M": 1.0, "L": 0.9, "I": 0.8, "V": 0.7, "F": 0.6, "A": 0.4, "T": 0.3, "D": -0.6, "E": -0.5, "P": -0.8, "G": -0.4},
        6: {"S": 0.9, "T": 0.8, "A": 0.7, "G": 0.6, "N": 0.5, "Q": 0.3, "V": 0.2, "W": -0.6, "F": -0.5, "P": -0.8},
        9: {"L": 1.2, "I": 1.1, "V": 1.0, "A": 0.8, "M": 0.7, "F": 0.4, "T": 0.3, "D": -0.7, "E": -0.6, "K": -0.4, "R": -0.4, "P": -1.0},
    },
}
# Letters at places 1, 4 and 9 of a core that count one each.
THREE_ANCHORS = {"HLA-DRB1*01:01": ("YFWLIV", "AGST", "LMIVF"), "HLA-DRB1*04:01": ("YFW", "ST", "KR"), "other": ("YFWLIV", "AGST", "LMIVF")}
# Cleavage, by offset from the cut; the residue at 0 is not scored.
CLEAVAGE = {
    -6: {"L": 0.2, "V": 0.1, "I": 0.1, "F": 0.1, "Y": 0.05, "W": 0.05},
    -5: {"E": 0.1, "D": 0.1, "K": 0.1, "R": 0.1},
    -4: {"A": 0.1, "G": 0.05, "S": 0.05, "T": 0.05},
    -3: {"L": 0.15, "V": 0.1, "I": 0.1, "F": 0.1, "M": 0.1},
    -2: {"E": 0.2, "D": 0.15, "Q": 0.1, "N": 0.1, "K": 0.1},
    -1: {"L": 1.2, "Y": 1.0, "F": 0.9, "M": 0.8, "W": 0.7, "K": 0.6, "R": 0.5, "A": 0.4, "V": 0.3, "I": 0.3, "H": 0.2, "Q": 0.1, "N": 0.0, "T": 0.0, "S": -0.1, "C": -0.2, "G": -0.3, "P": -0.8, "E": -0.4, "D": -0.5},
    1: {"A": 0.3, "S": 0.2, "G": 0.2, "T": 0.1, "V": 0.1, "P": -0.5, "E": -0.2, "D": -0.2, "K": 0.1, "R": 0.1},
    2: {"L": 0.1, "V": 0.1, "I": 0.1, "A": 0.05},
    3: {"E": 0.1, "D": 0.1, "K": 0.05, "R": 0.05},
    4: {"A": 0.05, "G": 0.05, "S": 0.05},
    5: {"L": 0.05, "V": 0.05, "I": 0.05},
    6: {"K": 0.05, "R": 0.05, "E": 0.05},
}
# Transport, by place of a peptide; place 9 stands for the C-terminus.
TRANSPORT = {
    1: {"R": 1.0, "K": 0.8, "H": 0.5, "Y": 0.4, "F": 0.3, "W": 0.2, "L": 0.1, "I": 0.1, "V": 0.0, "M": 0.0, "A": -0.1, "G": -0.2, "S": -0.1, "T": -0.1, "C": -0.2, "P": -0.4, "N": -0.1, "Q": -0.1, "E": -0.3, "D": -0.4},
    2: {"L": 0.4, "I": 0.3, "V": 0.2, "M": 0.2, "F": 0.3, "Y": 0.2, "W": 0.2, "A": 0.1, "K": 0.1, "R": 0.1},
    3: {"Y": 0.3, "F": 0.2, "W": 0.2, "L": 0.1, "I": 0.1, "V": 0.1, "K": 0.1, "R": 0.1},
    4: {"L": 0.1, "I": 0.1, "V": 0.1, "F": 0.1, "Y": 0.1},
    5: {"K": 0.1, "R": 0.1, "E": 0.05, "D": 0.05},
    6: {"L": 0.1, "V": 0.1, "I": 0.1},
    7: {"A": 0.05, "G": 0.05, "S": 0.05},
    8: {"L": 0.1, "V": 0.1, "I": 0.1},
    9: {"L": 1.2, "F": 1.0, "Y": 0.9, "M": 0.8, "I": 0.7, "V": 0.5, "A": 0.2, "R": 0.6, "K": 0.5, "W": 0.4, "H": 0.2, "T": 0.0, "S": -0.1, "C": -0.2, "N": -0.1, "Q": -0.1, "G": -0.3, "P": -0.6, "E": -0.4, "D": -0.5},
}

Matrix = list[list[int]]  # for each place: the value of an unknown letter, then of each letter of AA, in thousandths


def place(values: dict[str, float], missing: float = 0.0, unknown: float = 0.0) -> list[int]:
    return [round(1000 * v) for v in (unknown, *(values.get(a, missing) for a in AA))]


def anchored(anchors: dict[int, dict[str, float]], k: int = 9) -> Matrix:
    """Anchors as given, base scores elsewhere; for 8 to 11 letters the middle place is left out or repeated."""
    nine = [place(anchors[p], AT_ANCHOR, UNKNOWN) if p in anchors else place(BASE, 0.0, UNKNOWN) for p in range(1, 10)]
    return nine[:4] + nine[4:5] * (k - 8) + nine[5:]


def sparse(values: dict[int, dict[str, float]], first: int, last: int) -> Matrix:
    """Listed letters only; others count 0."""
    return [place(values.get(p, {})) for p in range(first, last + 1)]


def transport(k: int) -> Matrix:
    """Places to 9, and beyond 9 letters the C-terminus once more."""
    nine = sparse(TRANSPORT, 1, 9)
    return nine[:k] if k <= 9 else nine + [place({})] * (k - 10) + [nine[8]]


def window_scores(code: str, matrix: Matrix, n: str = "n") -> Column:
    """The score of each window of a sequence's letter codes, in thousandths."""
    tables = [F.array(*[F.lit(v) for v in p]) for p in matrix]

    def at(i):
        out = tables[0][F.col(code)[i - 1]]
        for p in range(1, len(tables)):
            if any(matrix[p]):
                out = out + tables[p][F.col(code)[i - 1 + p]]
        return out

    return F.transform(upto(F.col(n) - len(matrix) + 1), at)


def peptide_score(peptide: Column, matrix: Matrix) -> Column:
    """The score of a peptide of as many letters as the matrix has places, in thousandths."""
    return sum((lookup(F.substring(peptide, p + 1, 1), m[1:], m[0]) for p, m in enumerate(matrix) if any(m)), F.lit(0))


def score_sql(peptide: str, matrix: Matrix, at: int = 1) -> str:
    return " + ".join(lookup_sql(f"substr({peptide}, {at + p}, 1)", m[1:], m[0]) for p, m in enumerate(matrix) if any(m))
