"""Many patterns against many sequences, by a seed index.

A pattern can stand only where its rarest short gram stands. One pass over the sequences counts the grams that patterns
hold, with counts added up before they travel; each pattern takes the rarest one as its seed. A second pass cuts the
sequences into grams, looks them up among the seeds, which every task has, and compares the whole pattern at the few places that are left.
Grams of the corpus are never shuffled, only counts and matches are.

Seeds are sent to all tasks in blocks of ``block`` patterns, so their size is bounded however many patterns there are; each block has its own passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 6  # letters of a seed; a shorter pattern is its own seed
OFFSETS = 64  # places of a pattern that a seed is chosen from


def _cut(text: str, width: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?=(.{{{width}}}))"), F.lit(1))


def seeds(seqs: DataFrame, patterns: DataFrame, width: int) -> DataFrame:
    """pattern, offset (from 0), gram: the rarest gram of each pattern that occurs at all in the sequences."""
    grams = patterns.select("pattern", F.posexplode(F.slice(_cut("pattern", width), 1, OFFSETS)).alias("offset", "gram"))
    corpus = seqs.select(F.explode(_cut("seq", width)).alias("gram"))
    counts = corpus.join(F.broadcast(grams.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a pattern with a gram that is nowhere can't occur
    found = grams.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram")).alias("s"))
    return found.where("s.n > 0").select("pattern", "s.offset", "s.gram")


def occurrences(seqs: DataFrame, patterns: DataFrame, gram: int = GRAM, block: int = 500_000) -> DataFrame:
    """seq_id, n, pattern, start (from 1): every place of every pattern. ``seqs``: seq_id, n, seq; ``patterns``: pattern, repeats don't
    matter, null and empty ones are nowhere."""
    texts = patterns.where("pattern <> ''").select("pattern").distinct()
    shapes = texts.groupBy(F.least(F.length("pattern"), F.lit(gram)).alias("width")).agg(F.count("*").alias("n")).collect()  # at most ``gram`` rows
    parts = []
    for width, n in sorted((r["width"], r["n"]) for r in shapes):
        own = texts.where(F.least(F.length("pattern"), F.lit(gram)) == width)
        blocks = -(-n // block)
        for b in range(blocks):
            some = own.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b) if blocks > 1 else own
            places = seqs.where(F.col("n") >= width).select("seq_id", "n", "seq", F.posexplode(_cut("seq", width)).alias("p", "gram"))
            hit = places.join(F.broadcast(seeds(seqs, some, width)), "gram").withColumn("start", F.col("p") - F.col("offset") + 1)
            same = F.expr("substring(seq, start, length(pattern)) = pattern")
            parts.append(hit.where((F.col("start") >= 1) & same).select("seq_id", "n", "pattern", F.col("start").cast("long").alias("start")))
    empty = seqs.select("seq_id", "n", F.lit("").alias("pattern"), F.lit(0).cast("long").alias("start")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts) if parts else empty


def validated(found: DataFrame, key: str, claim: Column) -> DataFrame:
    """seq_id, n, key, pattern, at, exact of every claim: the claimed place if the pattern stands there, else its first place. ``claim`` is
    an expression over the columns of ``found`` and ``first``, the pattern's first place in the sequence."""
    own = Window.partitionBy("seq_id", key)  # the places of one pattern in one sequence
    rows = found.withColumn("first", F.min("start").over(own)).withColumn("claim", claim)
    exact = F.bool_or(F.col("start") == F.col("claim"))
    return rows.groupBy("seq_id", key).agg(F.first("n").alias("n"), F.first("pattern").alias("pattern"), F.when(exact, F.first("claim")).otherwise(F.first("first")).alias("at"), exact.alias("exact"))


def spots(claims: DataFrame, *aggs) -> DataFrame:
    """seq_id, n, spots: the distinct places that the validated patterns cover, in order."""
    span = F.sequence(F.col("at").cast("int"), (F.col("at") + F.length("pattern") - 1).cast("int"))
    return claims.groupBy("seq_id", "n").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(span)))).alias("spots"), *aggs)
