"""Operator 1: benchmark decontamination by SimHash over item-sized windows.

Windows are laid first, where one can be similar to any item at all: such a window shares at least
``similarity / (1 + similarity)`` of both sizes of shingles with it, so the item meets only documents that have one of its rarest
shingles (as many that an item without any of them shares too few), and in these the places of all shared shingles give
every start at which a window as long as the item can share enough. Of these the one that shares most is laid, the
first of equals. What is kept of a window is its row, start and length, not the item.

Each laid window and each item has a 64-bit SimHash of its shingles, cut into ``blocks`` blocks. Two fingerprints
within ``radius = blocks * (flips + 1) - 1`` bits differ in at most ``flips`` bits in one block at least, so each item is entered under every
value that is within ``flips`` bits of its own in a block, and an equality join on (length, block, value) finds all windows within the
radius, and nothing else finds any: this join makes all candidates. They are verified exactly: weighted Jaccard similarity of
the shingle multisets, at least ``similarity``.

A pair at a similarity of exactly 0.8 differs in 9.7 of 64 bits in the mean, with a deviation of 2.9; the radius of 23 is 4.8
deviations away (calculated). Brute-force tests over all windows hold the results.

All of it is DataFrame work. Item shingles are broadcast only while there are at most ``BROADCAST_ROWS``;
beyond that the join shuffles, and only documents with a hit are joined with their text again.

Words are maximal runs of non-space characters, lower-cased. An item with fewer than ``shingle`` words has
one shingle, all of them. A document shorter than an item is one window. Null, empty and blank texts match
nothing. A very long text is exploded to a row a word, and costs a pair with an item its shared places. Repeated
rows report once. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, row_keys, table

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, FLIPS = 6, 3  # together a radius of 23 bits
SLACK = 1e-9  # a bound may admit a window too many, but never lose one to rounding
BROADCAST_ROWS = 200_000
SPACES = "[\\x20\\x09-\\x0D]+"


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def _hashes(words: str, k: int) -> Column:
    """Hash of each run of k words; no run, no hash."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.expr("cast(array() as array<long>)"))


def _simhash(hashes: str) -> Column:
    def bit(acc, b):
        ones = F.size(F.filter(hashes, lambda h: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)) == 1))
        return F.when(2 * ones > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def _cuts(blocks: int) -> list[tuple[int, int, int]]:
    """Number, first bit and width of each block of 64 bits."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    return [(b, lo, hi - lo) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def _in_blocks(fp: str, blocks: int) -> Column:
    """block, value of each block of a fingerprint."""
    return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND((1 << size) - 1).alias("value")) for b, lo, size in _cuts(blocks)]))


def _near_values(known: DataFrame, fp: str, blocks: int, flips: int) -> DataFrame:
    """A row of ``known`` for each value within ``flips`` bits of its own in each block."""
    kinds = sorted({size for *_, size in _cuts(blocks)})
    spark = known.sparkSession
    masks = None  # of each width; some hundreds of rows
    for size in kinds:
        part = spark.range(1 << size).where(F.bit_count("id") <= flips).select(F.lit(size).alias("size"), F.col("id").alias("mask"))
        masks = part if masks is None else masks.unionByName(part)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(size).alias("size"), F.shiftrightunsigned(fp, lo).bitwiseAND((1 << size) - 1).alias("own")) for b, lo, size in _cuts(blocks)]))
    rows = known.select("*", each.alias("b")).select("*", "b.block", "b.size", "b.own").drop("b")
    return rows.join(F.broadcast(masks), "size").select(*known.columns, "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def _similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two arrays of shingles; a shingle weighs as often as it occurs."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    each = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(each)  # where one has no repeats, each shared shingle weighs one
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def _strings(words: str, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, blocks: int = BLOCKS, flips: int = FLIPS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each doc_id and item."""
    near = _pairs(docs, benchmark, shingle, similarity, blocks, flips)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words"))
    return near.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", (-F.col("x.s")).alias("start_word"), F.col("x.n_words").alias("n_words"), F.col("x.similarity").alias("similarity"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, blocks: int = BLOCKS, flips: int = FLIPS) -> DataFrame:
    """r1, r2: the ``row_keys`` of each row with a passage of the benchmark, whatever its doc_id."""
    return _pairs(docs, benchmark, shingle, similarity, blocks, flips).select("r1", "r2").distinct()


def _pairs(docs: DataFrame, benchmark: DataFrame, shingle: int, similarity: float, blocks: int, flips: int) -> DataFrame:
    """r1, r2, doc_id, item_id, start, n_words, similarity of the windows that pass."""
    items = benchmark.where("text is not null").select("item_id", _words("text").alias("iw")).where("size(iw) > 0")
    items = items.withColumn("k", F.least(F.size("iw"), F.lit(shingle))).withColumn("item", F.xxhash64("item_id", "iw"))
    items = materialize(items, "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` values
    texts = docs.where("text is not null").select("doc_id", *row_keys(), "text")  # words are cut after joins, for the rows that are left
    wins = None
    for k in sizes:
        part = _windows(texts, items.where(F.col("k") == k), k, similarity)
        wins = part if wins is None else wins.unionByName(part)
    if wins is None:
        return docs.select(*row_keys(), "doc_id").limit(0).selectExpr("r1", "r2", "doc_id", "cast(null as long) item_id", "cast(null as int) start", "cast(null as int) n_words", "cast(null as double) similarity")
    wins = materialize(wins.select("r1", "r2", "start", "len", "k").distinct(), "windows")
    laid = texts.join(wins, ["r1", "r2"]).withColumn("w", _words("text"))
    laid = laid.select("r1", "r2", "doc_id", "start", "len", "k", F.slice("w", F.col("start") + 1, F.col("len")).alias("ww"))
    laid = laid.dropDuplicates(["r1", "r2", "start", "len"])

    def marked(df: DataFrame, words: str) -> DataFrame:
        df = df.withColumn("sh", _strings(words, F.col("k"))).withColumn("hs", F.transform("sh", lambda s: F.xxhash64(s)))
        return df.withColumn("fp", _simhash("hs"))

    mine = materialize(marked(laid, "ww").select("r1", "r2", "doc_id", "start", "len", "fp", "sh", F.size("ww").alias("n_words")), "marked")
    known = materialize(marked(items, "iw").select("item_id", "item", F.size("iw").alias("len"), F.col("fp").alias("ifp"), F.col("sh").alias("ish")), "known")
    a = mine.select("r1", "r2", "start", "len", "fp", _in_blocks("fp", blocks).alias("b")).select("r1", "r2", "start", "len", "fp", "b.block", "b.value")
    b = _near_values(known.select("item", "len", "ifp"), "ifp", blocks, flips)
    radius = blocks * (flips + 1) - 1
    # fingerprints alone meet; shingles are joined to the pairs that are near
    near = a.join(b, ["len", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("r1", "r2", "start", "len", "item").distinct()
    both = near.join(mine.drop("fp"), ["r1", "r2", "start", "len"]).join(known.select("item", "item_id", "ish").distinct(), "item")
    both = both.withColumn("similarity", _similarity("sh", "ish")).where(F.col("similarity") >= similarity)
    return both.select("r1", "r2", "doc_id", "item_id", "start", "n_words", "similarity")


def _windows(texts: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    """r1, r2, item, start, len, k: for each document and item the most similar window, if it is similar enough.

    items: item, iw, all with shingles of k words."""
    each = items.select("item", F.size("iw").alias("len"), (F.size("iw") - k + 1).alias("m"), F.posexplode(_hashes("iw", k)).alias("o", "h")).distinct()
    each = materialize(each, "grams")
    small = each.count() <= BROADCAST_ROWS
    near = F.broadcast if small else lambda df: df
    spread = each.groupBy("h").agg(F.count_distinct("item").alias("items"))
    order = F.row_number().over(Window.partitionBy("item").orderBy("items", "h", "o"))
    probes = each.join(spread, "h").withColumn("nth", order).where(F.col("nth") <= F.col("m") - F.ceil(F.lit(similarity) * F.col("m") - SLACK) + 1).select("h", "item").distinct()
    at = texts.select("r1", "r2", _words("text").alias("w")).select("r1", "r2", F.explode(_hashes("w", k)).alias("h"))
    pairs = materialize(at.join(near(probes), "h").select("r1", "r2", "item").distinct(), "pairs")

    grams = each.groupBy("item", "len", "m", "h").agg(F.count("*").alias("c"))
    met = texts.join(pairs, ["r1", "r2"]).dropDuplicates(["r1", "r2", "item"]).withColumn("w", _words("text")).withColumn("hs", _hashes("w", k))
    spots = met.select("r1", "r2", "item", F.size("hs").alias("nd"), F.posexplode("hs").alias("p", "h")).join(near(grams), ["item", "h"])
    hits = spots.groupBy("r1", "r2", "item", "len", "m", "nd").agg(F.array_sort(F.collect_list(F.struct("p", "h", "c"))).alias("hits"))
    hits = hits.withColumn("mw", F.least("m", "nd"))
    hits = hits.withColumn("least", F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + F.col("mw")) - SLACK).cast("int"))
    p = lambda i: F.get("hits", i)["p"]

    def starts(i):
        """Starts of windows whose first shared shingle is the i-th and that can have enough of them."""
        low = F.greatest(F.lit(0), F.coalesce(p(i - 1) + 1, F.lit(0)), p(i) - F.col("mw") + F.col("least"))
        high = F.least(p(i), F.col("nd") - F.col("mw"))
        enough = (p(i + F.col("least") - 1) <= p(i) + F.col("mw") - 1) & (low <= high)
        return F.when(enough, F.transform(F.sequence(low, high), lambda s: F.struct(s.alias("s"), (i + 1).alias("i")))).otherwise(F.array().cast("array<struct<s:int,i:int>>"))

    def score(x):
        inside = F.filter(F.slice("hits", x["i"], F.col("mw")), lambda hit: hit["p"] < x["s"] + F.col("mw"))
        kinds = F.array_distinct(F.transform(inside, lambda hit: F.struct(hit["h"].alias("h"), hit["c"].alias("c"))))
        common = F.when(F.size(kinds) == F.size(inside), F.size(inside)).otherwise(
            F.aggregate(kinds, F.lit(0), lambda acc, g: acc + F.least(g["c"].cast("int"), F.size(F.filter(inside, lambda hit: hit["h"] == g["h"]))))
        )
        return F.struct((common / (F.col("m") + F.col("mw") - common)).alias("similarity"), (-x["s"]).alias("s"))

    tried = F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - 1), starts))
    best = hits.where(F.size("hits") >= F.col("least")).withColumn("best", F.array_max(F.transform(tried, score)))
    return best.where(F.col("best.similarity") >= similarity - SLACK).select("r1", "r2", "item", (-F.col("best.s")).alias("start"), "len", F.lit(k).alias("k"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
