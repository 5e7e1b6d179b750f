"""Constant dimensions: amino-acid scales in thousandths, method defaults. One literal each, rendered as
Spark expressions and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AA = "ACDEFGHIKLMNPQRSTVWY"

# The three-letter names of the letters, in the order of AA.
NAMES = "ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split()

# Published scales, in the order of AA.
SCALES = {
    "emini": [0.815, 0.394, 1.283, 1.445, 0.695, 0.714, 1.180, 0.603, 1.545, 0.603, 0.714, 1.296, 1.236, 1.348, 1.475, 1.115, 1.184, 0.606, 0.808, 1.089],
    "parker": [2.1, 1.4, 10.0, 7.8, -9.2, 5.7, 2.1, -8.0, 5.7, -9.2, -4.2, 7.0, 2.1, 6.0, 4.2, 6.5, 5.2, -3.7, -10.0, -1.9],
    "chou-fasman": [0.66, 1.19, 1.46, 0.74, 0.60, 1.56, 0.95, 0.47, 1.01, 0.59, 0.60, 1.56, 1.52, 0.98, 0.95, 1.43, 0.96, 0.50, 0.96, 1.14],
    "kolaskar-tongaonkar": [1.064, 1.412, 0.866, 0.851, 1.091, 0.874, 1.105, 1.152, 0.930, 1.250, 0.826, 0.776, 1.064, 1.015, 0.873, 1.012, 0.909, 1.383, 0.893, 1.161],
    "karplus-schulz": [1.046, 0.906, 1.068, 1.094, 0.915, 1.061, 0.950, 0.927, 1.102, 0.935, 0.893, 1.036, 1.049, 1.037, 1.008, 1.046, 0.997, 0.912, 0.904, 0.929],
}
# Antigen propensity by log-odds, in the order of AA.
PROPENSITY = [-0.02, -0.41, 0.25, 0.21, -0.44, -0.07, 0.10, -0.50, 0.13, -0.55, -0.34, 0.15, 0.02, 0.07, 0.09, 0.10, 0.04, -0.45, -0.20, 0.04]
# Hydropathy in tenths, in the order of AA.
HYDROPATHY = [18, 25, -35, -35, 28, -4, -32, 45, -39, 38, 19, -35, -16, -35, -45, -8, -7, 42, -9, -13]
# Helix and sheet propensities, charge at pH 7 and residue volume, in the order of AA.
HELIX = [1.42, 0.70, 1.01, 1.51, 1.13, 0.57, 1.00, 1.08, 1.16, 1.21, 1.45, 0.67, 0.57, 1.11, 0.98, 0.77, 0.83, 1.06, 1.08, 0.69]
SHEET = [0.83, 1.19, 0.54, 0.37, 1.38, 0.75, 0.87, 1.60, 0.74, 1.30, 1.05, 0.89, 0.55, 1.10, 0.93, 0.75, 1.19, 1.70, 1.37, 1.47]
CHARGE = [0.0, 0.0, -1.0, -1.0, 0.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
RESIDUE_VOLUME = [88.6, 108.5, 111.1, 138.4, 189.9, 60.1, 153.2, 166.7, 168.6, 166.7, 162.9, 114.1, 112.7, 143.8, 173.4, 89.0, 116.1, 140.0, 227.8, 193.6]
# Volume and polarity, scaled to 0..1, in the order of AA.
VOLUME = [0.167, 0.287, 0.313, 0.380, 0.593, 0.000, 0.433, 0.453, 0.487, 0.453, 0.467, 0.320, 0.287, 0.387, 0.547, 0.207, 0.280, 0.380, 0.733, 0.600]
POLARITY = [0.000, 0.128, 1.000, 0.932, 0.068, 0.000, 0.449, 0.000, 0.694, 0.000, 0.068, 0.593, 0.221, 0.559, 0.763, 0.322, 0.322, 0.000, 0.186, 0.373]
# Letter classes.
HYDROPHOBIC, BASIC, POLAR, ACIDIC, CLEAVABLE, SMALL = "AILMFVWPY", "KRH", "STNQ", "DE", "AGSTCVN", "AGSCT"
# What a neighbour adds to an O-glycosylation site, in thousandths: half its propensity, and 50 for S and T.
O_GLYCO = {"P": 150, "T": 150, "S": 150, "A": 50, "V": 50, "E": -100, "D": -100, "K": -50, "R": -50}
# Shares of letters at -3, -1 and +1 of a cut; letters not listed have 0.01, the background is 0.05.
CUT_SHARES = {
    -3: {"A": 0.45, "V": 0.15, "S": 0.10, "G": 0.08, "L": 0.07, "I": 0.05, "T": 0.05, "C": 0.03, "F": 0.02},
    -1: {"A": 0.55, "G": 0.15, "S": 0.12, "C": 0.06, "T": 0.05, "V": 0.04, "L": 0.02, "Q": 0.01},
    1: {"A": 0.20, "Q": 0.12, "S": 0.10, "D": 0.09, "E": 0.08, "G": 0.07, "T": 0.07, "N": 0.06, "K": 0.05},
}
# Default window and threshold (None: the sequence's mean).
METHODS = {"emini": (6, 1.0), "parker": (7, None), "chou-fasman": (7, None), "kolaskar-tongaonkar": (7, 1.0), "karplus-schulz": (7, 1.0)}
LINEAR = [m for m in METHODS if m != "emini"]


def milli(scale: str) -> list[int]:
    return [round(1000 * v) for v in (PROPENSITY if scale == "propensity" else SCALES[scale])]


def lookup(aa: Column, values: list[int], unknown: int) -> Column:
    """Value of a letter from a literal array; slot 0 serves letters that are not listed."""
    return F.array(*[F.lit(v) for v in (unknown, *values)])[F.instr(F.lit(AA), aa)]


def lookup_sql(aa: str, values: list[int], unknown: int) -> str:
    return f"([{', '.join(map(str, (unknown, *values)))}])[instr('{AA}', {aa}) + 1]"
