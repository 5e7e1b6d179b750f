"""Operator 2: sharding by balanced label propagation, under the law ``rows``.

Documents with equal texts are linked. Their links form a star around the text, so the state is kept as
counts: how many documents of a text lie in each shard. In a round every text asks that its documents
move to the shard that holds most of them; between two shards as many move each way as both sides ask
for, and beyond that as many as the target has free places (quota). Requests are taken in order of gain.
Rounds are joins over the table of counts, each written to the shared folder. At last the documents
without links fill what is free, so that shard sizes differ by at most one.

Only the 16 x 16 table of requests comes to the driver. Ranks are taken in two levels (within buckets,
then bucket offsets), so that no window holds a shard or a large text as a whole.

Null text counts as the empty text: no bytes, size 1, crc32 0; null and empty are linked. Repeated rows
are linked copies. A very long text counts by its hash only. Of requests with equal gain those of the lesser
hash bucket, then of the lesser hash of the text, come first. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions, table


def ranked(df: DataFrame, by: list[str], order: list[str], weight: str | None = None, name: str = "rank", first: list[str] | None = None) -> DataFrame:
    """Adds a gapless rank from 0 within ``by`` (or the sum of ``weight`` before the row).

    Rows are ordered by ``first`` (columns of few values), then by a hash bucket, then by ``order``. Buckets grow with the
    session's partitions.
    """
    spark, first = df.sparkSession, first or []
    buckets = max(64, 4 * partitions(spark))
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    held = df.withColumn("bucket_", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inner = Window.partitionBy(*by, *first, "bucket_").orderBy(*order)
    sums = held.groupBy(*by, *first, "bucket_").agg(F.sum(w).alias("sum_"))
    held = held.withColumn("inner_", F.sum(w).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - w)
    outer = Window.partitionBy(*by).orderBy(*first, "bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, *first, "bucket_", F.coalesce(F.sum("sum_").over(outer), F.lit(0)).alias("before_"))
    return held.join(sums, [*by, *first, "bucket_"]).withColumn(name, (F.col("inner_") + F.col("before_")).cast("long")).drop("bucket_", "inner_", "before_")


def _pick(value: Column, edges: list[int]) -> Column:
    """Index of the interval of ``edges`` (cumulative sizes) that ``value`` falls in."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in edges]), lambda x: x <= value)).cast("int")


def _quotas(asked: dict, load: list[int], room: list[int]) -> dict:
    """How many may move for each (from, to): swaps first, then free places in order of request size."""
    grant = {(i, j): min(n, asked.get((j, i), 0)) for (i, j), n in asked.items()}
    free = [r - x for r, x in zip(room, load, strict=True)]
    for (i, j), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - grant[i, j], max(0, free[j]))
        grant[i, j] += more
        free[j] -= more
        free[i] += more
    return grant


def propagate(counts: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """counts: (grp, shard, n). Moves linked documents for at most ``rounds`` rounds."""
    shards = len(room)
    for _ in range(rounds):
        load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most ``shards`` rows
        load = [load.get(s, 0) for s in range(shards)]
        open_ = F.array(*[F.lit(load[s] < room[s]) for s in range(shards)])
        # a text's target: the shard with most of its documents; a full one only by swaps
        best = Window.partitionBy("grp")
        aim = counts.withColumn("most", F.max(F.struct("n", open_[F.col("shard")].alias("open"), (-F.col("shard")).alias("shard"))).over(best))
        asks = aim.select("grp", "shard", "n", (-F.col("most.shard")).alias("to"), (F.col("n") - F.col("most.n")).alias("loss")).where("shard <> to")
        asked = {(r["shard"], r["to"]): r["n"] for r in asks.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # at most shards ** 2 rows
        grant = _quotas(asked, load, room)
        if not any(grant.values()):
            break
        limit = F.create_map(*[x for (i, j), n in grant.items() for x in (F.lit(i * shards + j), F.lit(n).cast("long"))])
        order = ranked(asks, ["shard", "to"], ["grp"], "n", "before", ["loss"])  # the greatest gain first
        left = limit[F.col("shard") * shards + F.col("to")] - F.col("before")
        moves = order.withColumn("take", F.greatest(F.lit(0), F.least("n", left))).where("take > 0")
        flow = moves.select("grp", "shard", (-F.col("take")).alias("n")).unionByName(moves.select("grp", F.col("to").alias("shard"), F.col("take").alias("n")))
        counts = materialize(counts.unionByName(flow).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shards")
    return counts


def shard(docs: DataFrame, shards: int = 16, rounds: int = 6, salts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    salts = salts or max(64, 4 * partitions(docs.sparkSession))
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("grp"),
    )
    # copies are dealt over salts by their id, equal ids by size and hash only
    base = materialize(base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")), "rows")
    cells = base.groupBy("grp", "salt").agg(F.count("*").alias("n"))
    groups = materialize(cells.groupBy("grp").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("salt", "n"))).alias("cells")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).first()
    room = [total[0] // shards + (s < total[0] % shards) for s in range(shards)]
    linked = groups.where("n > 1")
    # start: linked documents dealt round robin, whatever their text
    start = ranked(linked.select("grp", "n"), [], ["grp"], "n", "first")
    start = start.select("grp", "n", "first", F.explode(F.sequence(F.lit(0), F.least(F.lit(shards - 1), (F.col("n") - 1).cast("int")))).alias("k"))
    share = F.floor((F.col("n") - 1 - F.col("k")) / shards) + 1
    start = start.select("grp", F.pmod(F.col("first") + F.col("k"), F.lit(shards)).cast("int").alias("shard"), share.cast("long").alias("n"))
    counts = propagate(materialize(start, "shards"), room, rounds)
    # the documents of a text, in rank order, take its shards one after the other
    ranges = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("shares"))
    plan = linked.join(ranges, "grp").select("grp", "shares", F.posexplode("cells").alias("at", "cell"), "cells")
    before = F.aggregate(F.slice("cells", 1, F.col("at")), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    plan = plan.select("grp", F.col("cell.salt").alias("salt"), "shares", before.alias("before"))
    place = Window.partitionBy("grp", "salt").orderBy("doc_id")
    many = base.join(plan, ["grp", "salt"]).withColumn("k", F.row_number().over(place) - 1 + F.col("before"))
    found = F.aggregate(
        "shares",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("shard")),
        lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.when((a["shard"] < 0) & (F.col("k") < a["sum"] + x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard")),
    )["shard"]
    many = many.select("doc_id", "size", "text_crc32", found.alias("shard"))
    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free, edges = 0, []
    for s in range(shards):
        free += room[s] - load.get(s, 0)
        edges.append(free)
    single = ranked(base.join(groups.where("n = 1").select("grp"), "grp", "left_semi"), [], ["grp"], None, "k")
    single = single.select("doc_id", "size", "text_crc32", _pick(F.col("k"), edges).alias("shard"))
    return ranked(many.unionByName(single), ["shard"], ["doc_id", "text_crc32", "size"], None, "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
