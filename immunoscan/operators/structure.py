"""Point-cloud jobs over residue tables: contacts by a grid join, protrusion and antigen scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import lookup, milli
from .settle import settled


def _square(own: str = "xyz", other: str = "2"):
    out = None
    for c in own:
        d = F.col(c) - F.col(c + other)
        out = d * d if out is None else out + d * d
    return out


def pairs(res: DataFrame, cutoff: float, inclusive: bool = False) -> DataFrame:
    """Directed pairs of residues of one structure within the distance, coincident ones too: cells as wide as the cutoff, 27 neighbours."""
    cell = lambda c: F.floor(F.col(c) / cutoff)
    at = res.where("x is not null").select("structure_id", "idx", "x", "y", "z", *[cell(c).alias("c" + c) for c in "xyz"])
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    other = at.select("structure_id", F.col("idx").alias("j"), *[F.col(c).alias(c + "2") for c in "xyz"], "cx", "cy", "cz")
    for c in "xyz":
        other = other.withColumn("d", F.explode(near)).withColumn("c" + c, F.col("c" + c) + F.col("d")).drop("d")
    both = at.join(other, ["structure_id", "cx", "cy", "cz"]).withColumn("distance", F.sqrt(_square()))
    within = F.col("distance") <= cutoff if inclusive else F.col("distance") < cutoff
    return both.where(within & (F.col("idx") != F.col("j"))).select("structure_id", "idx", "j", "distance")


def contacts(res: DataFrame, cutoff: float) -> DataFrame:
    """Directed pairs of one structure with 0 < distance < cutoff."""
    return pairs(res, cutoff).where("distance > 0")


def contact_number(res: DataFrame, cutoff: float = 8.0) -> DataFrame:
    count = contacts(res, cutoff).groupBy("structure_id", "idx").agg(F.count("*").alias("contacts"))
    return res.join(count, ["structure_id", "idx"], "left").na.fill(0, ["contacts"])


def protrusion(res: DataFrame) -> DataFrame:
    by = Window.partitionBy("structure_id")
    away = F.sqrt(sum((F.pow(F.col(c) - F.avg(c).over(by), F.lit(2)) for c in "yz"), F.pow(F.col("x") - F.avg("x").over(by), F.lit(2))))
    out = res.withColumn("away", away)
    top = F.max("away").over(by)
    return out.withColumn("protrusion", F.when(F.col("away").isNotNull(), F.when(top > 0, F.col("away") / top).otherwise(0.0))).drop("away")


def surface_propensity(res: DataFrame) -> DataFrame:
    """propensity - 0.02 contacts + 0.35 ln(sasa + 1), with the cut at the structure's 85th percentile."""
    out = contact_number(res).withColumn("score", lookup(F.col("aa"), milli("propensity"), 0) / F.lit(1000.0) - 0.02 * F.col("contacts") + 0.35 * F.log(F.col("sasa") + 1))
    return out.withColumn("cut", F.expr("percentile(score, 0.85) over (partition by structure_id)"))


def protrusion_by_area(res: DataFrame, least: float = 5.0) -> DataFrame:
    by = Window.partitionBy("structure_id")
    out = protrusion(res)
    return out.withColumn("score", F.when(F.col("protrusion").isNotNull(), F.when((F.col("sasa") < least) | (F.max("sasa").over(by) <= 0), 0.0).otherwise(F.col("protrusion") * F.col("sasa") / F.max("sasa").over(by))))


def bfactor_norm(res: DataFrame) -> DataFrame:
    by = Window.partitionBy("structure_id")
    sd = F.stddev_pop("bfactor").over(by)
    return res.withColumn("flexibility", F.when(F.col("bfactor").isNotNull(), F.when(sd > 0, (F.tanh((F.col("bfactor") - F.avg("bfactor").over(by)) / sd / 2) + 1) / 2).otherwise(0.5)))


def local_density(res: DataFrame, radius: float = 10.0) -> DataFrame:
    """Residues within the radius, the residue itself included, over the sphere's volume."""
    return contact_number(res, radius).withColumn("density", (F.col("contacts") + 1) / F.lit(4 / 3 * math.pi * radius**3))


def residue_depth(res: DataFrame, exposed: float = 60.0, step: float = 8.0) -> DataFrame:
    """structure_id, idx, depth: distance to the nearest exposed residue of the structure.

    Most residues have one within ``step``, so they meet only the cells around them. For those whose distance there is greater,
    or that met none, the search starts again with cells of twice the width, until none is left or a cell holds the structure.
    """
    placed = res.where("x is not null").select("structure_id", "idx", "sasa", "x", "y", "z")
    shell = placed.where(F.col("sasa") >= exposed).select("structure_id", *[F.col(c).alias(c + "2") for c in "xyz"])
    by = Window.partitionBy("structure_id")
    width = sum((F.max(c).over(by) - F.min(c).over(by) for c in "xyz"), F.lit(0.0))  # no two residues are further apart
    left = placed.drop("sasa").join(shell.select("structure_id").distinct(), "structure_id", "left_semi").withColumn("width", width)
    widest = left.agg(F.max("width")).first()[0]
    if widest is None:
        return left.select("structure_id", "idx", F.lit(None).cast("double").alias("depth"))
    done = None
    while True:
        last = step > widest
        here = [F.floor(F.col(c) / step).alias("c" + c) for c in "xyz"]
        near = shell.select("*", *[F.floor(F.col(c + "2") / step).alias("c" + c) for c in "xyz"])
        for c in "xyz":
            near = near.withColumn("d", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("c" + c, F.col("c" + c) + F.col("d")).drop("d")
        met = left.select("*", *here).join(near, ["structure_id", "cx", "cy", "cz"], "left").groupBy("structure_id", "idx", "x", "y", "z", "width").agg(F.sqrt(F.min(_square())).alias("depth"))
        found = met.where(F.lit(last) | (F.col("depth") <= step)).select("structure_id", "idx", "depth")
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        left = settled(met.where(F.col("depth").isNull() | (F.col("depth") > step)).drop("depth"))
        step *= 4 if step < 64 else 16


def gap_regions(scored: DataFrame, gap: int = 2, least: int = 3) -> DataFrame:
    """Runs of ``called`` residues that bridge up to ``gap`` others; mean score and centroid over the whole span."""
    by = Window.partitionBy("structure_id").orderBy("idx")
    hot = scored.where("called").select("structure_id", "idx").withColumn("new", (F.col("idx") - F.lag("idx").over(by) > gap + 1).cast("int"))
    runs = hot.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(by)).groupBy("structure_id", "run").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("above"))
    span = runs.where(F.col("above") >= least).select("*", F.explode(F.sequence("start", "end")).alias("idx"))
    centre = [F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in "xyz"]
    return span.join(scored, ["structure_id", "idx"]).groupBy("structure_id", "start", "end", "above").agg(F.avg("score").alias("score"), *centre)


# Words of antibody chain descriptions, and words that rule a description out.
ANTIBODY = ["immunoglobulin", "antibody", "fab ", "fab", "fv ", "scfv", "igg", "ige", "iga", "igm", "heavy chain", "light chain", "kappa", "lambda", "nanobody", "vhh", "single-domain", "hc fragment", "fragment b", "myeloma"]
NOT_ANTIBODY = ["receptor", "binding protein"]


def chain_split(chains: DataFrame, least: int = 50) -> DataFrame:
    """structure_id, antibodies, antigen_id, length: the antigen is the longest other chain, of at least ``least``."""
    low = F.lower("description")
    mark = F.lit(False)
    for word in ANTIBODY:
        mark = mark | F.contains(low, F.lit(word))
    for word in NOT_ANTIBODY:
        mark = mark & ~F.contains(low, F.lit(word))
    rows = chains.withColumn("antibody", F.coalesce(mark, F.lit(False)))
    best = F.max(F.when(~F.col("antibody") & (F.col("length") >= least), F.struct("length", "chain_id"))).alias("best")
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("antibody"), F.col("chain_id")))), ",").alias("antibodies")
    out = rows.groupBy("structure_id").agg(names, best).where("best is not null and antibodies <> ''")
    return out.select("structure_id", "antibodies", F.col("best.chain_id").alias("antigen_id"), F.col("best.length").alias("length"))


def interface(atoms: DataFrame, antigen: str = "A", antibody: str = "H", cutoff: float = 4.0, least: int = 4) -> DataFrame:
    """Antigen residues with an atom within the cutoff of an antibody atom, in structures with enough of them."""
    cell = [F.floor(F.col(c) / cutoff).alias("c" + c) for c in "xyz"]
    placed = atoms.where("x is not null").select("structure_id", "chain_id", "idx", "x", "y", "z", *cell)
    other = placed.where(F.col("chain_id") == antibody).select("structure_id", *[F.col(c).alias(c + "2") for c in "xyz"], "cx", "cy", "cz")
    for c in "xyz":
        other = other.withColumn("d", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("c" + c, F.col("c" + c) + F.col("d")).drop("d")
    square = sum(((F.col(c) - F.col(c + "2")) * (F.col(c) - F.col(c + "2")) for c in "yz"), (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")))
    near = placed.where(F.col("chain_id") == antigen).join(other, ["structure_id", "cx", "cy", "cz"]).where(F.sqrt(square) <= cutoff)
    spots = near.select("structure_id", "idx").distinct()
    return spots.withColumn("n", F.count("*").over(Window.partitionBy("structure_id"))).where(F.col("n") >= least).drop("n")
