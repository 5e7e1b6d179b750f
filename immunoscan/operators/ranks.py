"""Running sums and ranks within groups of any size, without a window over a group.

Rows are dealt into ranges by (group, order), so a large group spans many ranges and a range holds many small groups. Each
task sums up its own part of a group; what the ranges before hold of the same group is added from a table with one row a
range and group. Ties are taken together before: equal values of a group become one row with their number, so a frequent value is one row too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled


def running(df: DataFrame, group: list[str], order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """``df`` with before_<name>, the sum of an amount over the rows of the group that come earlier, and total_<name>. Rows that are
    equal in ``order`` come one after the other in no given order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(amounts)
    rows = df.withColumns({f"a_{n}": a for n, a in amounts.items()})
    # settled: the ranges are drawn by a sample, and both readers below must see the same ones
    rows = settled(rows.repartitionByRange(parts, *group, *order).withColumn("range_", F.spark_partition_id()))
    sums = rows.groupBy(*group, "range_").agg(*[F.sum(f"a_{n}").alias(f"s_{n}") for n in names])
    own = Window.partitionBy(*group)  # a row a range that the group spans
    past = own.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumns({f"c_{n}": F.coalesce(F.sum(f"s_{n}").over(past), F.lit(0)) for n in names} | {f"total_{n}": F.sum(f"s_{n}").over(own) for n in names})
    carry = carry.select(*[F.col(g).alias(f"g_{i}") for i, g in enumerate(group)], F.col("range_").alias("g_range"), *[f"c_{n}" for n in names], *[f"total_{n}" for n in names])
    part = Window.partitionBy(*group, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"l_{n}": F.coalesce(F.sum(f"a_{n}").over(part), F.lit(0)) for n in names})
    same = [F.col(g).eqNullSafe(F.col(f"g_{i}")) for i, g in enumerate(group)]
    out = local.join(carry, [F.col("range_") == F.col("g_range"), *same])
    out = out.withColumns({f"before_{n}": F.col(f"l_{n}") + F.col(f"c_{n}") for n in names})
    return out.select(*df.columns, *[f"before_{n}" for n in names], *[f"total_{n}" for n in names])


def tied(df: DataFrame, group: list[str], value: str, **counts: Column) -> DataFrame:
    """One row a value of a group: n, the counts (sums of the given amounts), and ``rank``, the mean of the ranks the tied rows share."""
    values = df.groupBy(*group, value).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in counts.items()])
    return running(values, group, [value], {"n": F.col("n")}).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with row_number (from 1) and total, the group's size."""
    out = running(df, group, order, {"n": F.lit(1).cast("long")})
    return out.select(*df.columns, (F.col("before_n") + 1).alias("row_number"), F.col("total_n").alias("total"))
