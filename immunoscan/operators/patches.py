"""Surface patches, composite scores, and votes of linear and structural methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import AA, NAMES, lookup, milli
from . import structure as S
from . import tracks as T
from .settle import settled

# Accessibility of secondary structures; others count as coil, C.
ACCESSIBILITY = {"C": 1.0, "T": 0.95, "S": 0.90, "G": 0.80, "H": 0.60, "E": 0.55, "B": 0.50, "I": 0.65}
WEIGHTS = {"sasa": 0.35, "contacts": -0.25, "bfactor": 0.25, "depth": -0.15}


def linked_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (structure_id, idx) with ``patch``, the least idx that links (structure_id, idx, j, both ways) lead to.

    Each round takes the least label of a node and its neighbours, then that label's own label, so paths halve."""
    links = settled(edges)
    now = settled(nodes.select("structure_id", "idx", F.col("idx").alias("patch")))
    while True:
        near = links.join(now.select("structure_id", F.col("idx").alias("j"), "patch"), ["structure_id", "j"]).groupBy("structure_id", "idx").agg(F.min("patch").alias("near"))
        step = now.join(near, ["structure_id", "idx"], "left").select("structure_id", "idx", F.least("patch", "near").alias("hop"))
        new = step.join(step.select("structure_id", F.col("idx").alias("hop"), F.col("hop").alias("patch")), ["structure_id", "hop"]).select("structure_id", "idx", "patch")
        new = settled(new)
        if new.exceptAll(now).isEmpty():
            return new
        now = new


def patches(res: DataFrame, area: float = 20.0, distance: float = 10.0, inclusive: bool = True, least: int = 3) -> DataFrame:
    """structure_id, idx, patch: exposed residues by single linkage within the distance; patches of ``least`` residues or more.
    Residues without a place link with none."""
    shell = res.where(F.col("sasa") >= area)
    near = S.pairs(shell, distance, inclusive).select("structure_id", "idx", "j")
    found = linked_groups(shell, near)
    return found.withColumn("n_", F.count("*").over(Window.partitionBy("structure_id", "patch"))).where(F.col("n_") >= least).drop("n_")


def patch_table(res: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """structure_id, patch, size, score (the mean of ``value``), x, y, z of each patch."""
    centre = [F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in "xyz"]
    return members.join(res, ["structure_id", "idx"]).groupBy("structure_id", "patch").agg(F.count("*").alias("size"), F.avg(value).alias("score"), *centre)


def with_propensity(res: DataFrame) -> DataFrame:
    return res.withColumn("propensity", lookup(F.col("aa"), milli("propensity"), 0) / F.lit(1000.0))


def patch_propensity(res: DataFrame) -> tuple[DataFrame, DataFrame]:
    """structure_id, idx, score: the mean propensity of the residue's patch; outside, 0.5 under the structure's least patch, -1.5
    where it has none. And the table of patches."""
    res = with_propensity(res)
    members = settled(patches(res))
    table = patch_table(res, members, "propensity")
    low = table.groupBy("structure_id").agg(F.min("score").alias("low"))
    inside = members.join(table.select("structure_id", "patch", "score"), ["structure_id", "patch"]).select("structure_id", "idx", F.col("score").alias("own"))
    out = res.select("structure_id", "idx").join(inside, ["structure_id", "idx"], "left").join(low, "structure_id", "left")
    return out.select("structure_id", "idx", F.coalesce("own", F.coalesce("low", F.lit(-1.0)) - 0.5).alias("score")), table


def called_regions(res: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gap-tolerant regions of the two residue scores, at their cut-offs."""
    one = S.surface_propensity(res).withColumn("called", F.round("score", 9) >= F.round("cut", 9))
    two = S.protrusion_by_area(res).withColumn("called", F.coalesce(F.round("score", 9) >= 0.5, F.lit(False)))
    return S.gap_regions(one), S.gap_regions(two)


def all_methods(res: DataFrame) -> DataFrame:
    """structure_id, method, start, end, size, score of the epitopes of the three methods; a patch gives its least and greatest idx."""
    one, two = called_regions(res)
    flat = lambda df, name: df.select("structure_id", F.lit(name).alias("method"), "start", "end", (F.col("end") - F.col("start") + 1).alias("size"), "score")
    res = with_propensity(res)
    members = patches(res)
    third = members.join(res, ["structure_id", "idx"]).groupBy("structure_id", "patch").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("size"), F.avg("propensity").alias("score")).where("score >= 0")
    return flat(one, "propensity").unionByName(flat(two, "protrusion")).unionByName(third.select("structure_id", F.lit("patch").alias("method"), "start", "end", "size", "score"))


def mixed_votes(res: DataFrame, least: int = 6) -> DataFrame:
    """structure_id, idx, votes: linear methods whose regions cover the residue of the structure's sequence, and structural ones."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "aa"))), lambda r: r["aa"]), "")
    seqs = res.groupBy("structure_id").agg(text.alias("seq")).withColumn("n", F.length("seq").cast("long")).withColumnRenamed("structure_id", "seq_id")
    linear = T.vote_arrays(seqs, least=least).select(F.col("seq_id").alias("structure_id"), F.posexplode("votes").alias("idx", "votes"))
    rows = linear.select("structure_id", F.col("idx").cast("long").alias("idx"), F.col("votes").cast("long").alias("votes"))
    for spans in called_regions(res):
        rows = rows.unionByName(spans.select("structure_id", F.explode(F.sequence("start", "end")).alias("idx"), F.lit(1).cast("long").alias("votes")))
    return rows.groupBy("structure_id", "idx").agg(F.sum("votes").alias("votes"))


def standard_residues(atoms: DataFrame) -> DataFrame:
    """structure_id, chain_id, idx, aa of residues with a standard name and a CA atom."""
    letter = F.create_map(*[F.lit(x) for name, aa in zip(NAMES, AA, strict=True) for x in (name, aa)])
    ca = atoms.where("atom = 'CA'").select("structure_id", "chain_id", "idx", "res_name").distinct()
    return ca.withColumn("aa", F.try_element_at(letter, "res_name")).where("aa is not null").drop("res_name")


def accessibility(ss: Column) -> Column:
    out = F.lit(1.0)
    for k, v in ACCESSIBILITY.items():
        out = F.when(ss == k, v).otherwise(out)
    return out


def composite(res: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """structure_id, idx, score: features scaled to 0..1 within the structure (0.5 where constant), turned round where the weight
    is negative, weighted and divided by the sum of the weights' sizes. Null where a feature is."""
    full = S.contact_number(res).join(S.residue_depth(res), ["structure_id", "idx"], "left")
    by, score = Window.partitionBy("structure_id"), F.lit(0.0)
    for f, w in weights.items():
        low, high = F.min(f).over(by), F.max(f).over(by)
        scaled = F.when(F.col(f).isNotNull(), F.when(high - low < 1e-10, 0.5).otherwise((F.col(f) - low) / (high - low)))
        score = score + abs(w) * (1 - scaled if w < 0 else scaled)
    return full.select("structure_id", "idx", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / sum(abs(w) for w in weights.values()))).alias("score"))
