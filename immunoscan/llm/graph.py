"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (a, b): label is the least node of its component.

    Each round hangs larger neighbours on the least one, so the number of rounds grows with the
    logarithm of the longest path. A round is a table in the shared folder. A node with very many
    neighbours is met only in a map-side minimum and in a join with one row a key.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now = materialize(edges.where("a <> b").select(lo, hi).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("lo").alias("u"), "hi").join(least, "u").select(F.col("m").alias("lo"), "hi").distinct()
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(own, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        star = own.select(F.col("m").alias("lo"), "hi")
        new = materialize(rest.unionByName(star).distinct(), "edges")
        discard(now)
        now = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a star forest with the components of the edges a, b: at most one an endpoint."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: a.size], at[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    use = label != np.arange(nodes.size)
    return nodes[use], nodes[label[use]]
