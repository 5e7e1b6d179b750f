"""Operator 6: URL filter by the ratio of two character language models.

Rules decide what they fit. Of the distinct URLs they allow and block, those whose hash modulo 5 is not 0 train two
variable-order Markov models over host and path: counts of all grams up to ``order`` characters, smoothed from
order to order. The other fifth calibrates: a URL scores the log-likelihood difference of the longest known
contexts, divided by its length, and the threshold is the one with the least sum of both kinds' error rates on that
fifth (the middle between two scores; the least of equal ones). URLs without a rule are judged by it.

All of it is DataFrame work. The score of a gram is stored as the difference to its suffix's score, so that
a URL's score is a plain sum over its known grams, with map-side aggregation. The model is broadcast only
while it has at most ``BROADCAST_ROWS`` grams; beyond that the join shuffles.

A null url, or one without ``://``, has an empty host and path, fits no rule and scores 0; a score equal to the
threshold is allowed. Without URLs of both kinds in both parts the threshold is 0; without any to train on every
other URL scores 0: allow. A very long url gives a row for each of its grams. Repeated rows get equal verdicts. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

ORDER = 4
WEIGHT = 4.0
BROADCAST_ROWS = 200_000
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), "^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each place and context length: gram = context and character."""
    padded = F.concat(F.lit("\u0002"), F.col("t"))
    at = F.sequence(F.lit(2), F.length("t") + 1)
    each = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.least(i - 1, F.lit(order))), lambda k: F.substring(padded, i - k, k + 1))))
    return urls.where(F.length("t") > 0).select(*keep, F.explode(each).alias("gram"))


def _model(grams: DataFrame, order: int) -> DataFrame:
    """``gram, delta``. grams: gram, a, r with the counts for accepted and rejected URLs."""
    counts = materialize(grams.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")).withColumn("k", F.length("gram") - 1), "grams")
    totals = counts.groupBy("k", "context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    counts = counts.join(totals, ["k", "context"])
    done, lower = None, None
    for k in range(order + 1):
        now = counts.where(F.col("k") == k)
        if lower is None:
            now = now.withColumns({"la": F.lit(1 / 256), "lr": F.lit(1 / 256), "lower": F.lit(0.0)})
        else:
            now = now.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, "suffix")
        pa, pr = ((F.col(n) + WEIGHT * F.col(p)) / (F.col(t) + WEIGHT) for n, p, t in (("a", "la", "ta"), ("r", "lr", "tr")))
        now = now.select("gram", pa.alias("pa"), pr.alias("pr"), "lower").withColumn("ratio", F.log(F.col("pa") / F.col("pr")))
        now = materialize(now.select("gram", "pa", "pr", "ratio", (F.col("ratio") - F.col("lower")).alias("delta")), "model")
        lower = now.select(F.col("gram").alias("suffix"), F.col("pa").alias("la"), F.col("pr").alias("lr"), F.col("ratio").alias("lower"))
        part = now.select("gram", "delta")
        done = part if done is None else done.unionByName(part)
    return done


def _held(text: str = "t") -> Column:
    return F.pmod(F.xxhash64(text, F.lit(6)), F.lit(5)) == 0


def calibrated(scored: DataFrame) -> tuple[float, float, float]:
    """Threshold, and the error rates of accepted and rejected URLs at it. scored: ruled, score, n.

    Scores are counted in steps of a thousandth, so the ordered window holds a few thousand rows, whatever the table's size."""
    step = scored.groupBy(F.floor(F.col("score") * 1000).alias("step")).agg(F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("r"))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wrong = step.select("step", (F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(every)).alias("ea"), (1 - F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every)).alias("er"), F.lag("step").over(Window.orderBy("step")).alias("before"))
    best = wrong.where(F.col("ea").isNotNull() & F.col("er").isNotNull()).orderBy(F.col("ea") + F.col("er"), "step").first()
    if best is None:
        return 0.0, 0.0, 0.0
    low = best["step"] if best["before"] is None else best["before"] + 1
    return (low + best["step"]) / 2000, best["ea"], best["er"]


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score, cut, error_allow, error_block of every page; the last two are the error rates
    of the threshold on the URLs held out."""
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("t"))
    urls = materialize(base.groupBy("t", "ruled").agg(F.count("*").alias("n")), "urls")
    yes, no = (F.when(F.col("ruled") == x, F.col("n")).otherwise(0) for x in ("allow", "block"))
    taught = urls.where(F.col("ruled").isNotNull() & ~_held()).select("t", yes.alias("a"), no.alias("r"))
    kinds = taught.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    none = [F.lit(0.0).alias(c) for c in ("cut", "error_allow", "error_block")]
    if not all(kinds):
        return base.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"), *none)
    grams = _grams(taught, order, "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    model = materialize(_model(grams, order), "deltas")
    small = model.count() <= BROADCAST_ROWS
    asked = urls.where(F.col("ruled").isNull() | _held())
    hits = _grams(asked, order, "t", "ruled", "n").join(F.broadcast(model) if small else model, "gram")
    score = F.round(F.sum("delta") / F.length("t"), 6).alias("score")  # sums of doubles differ in their last digits by their order
    scored = materialize(hits.groupBy("t", "ruled", "n").agg(score), "scores")
    cut, wrong_allow, wrong_block = calibrated(scored.where("ruled is not null"))
    out = base.join(scored.where("ruled is null").select("t", "score"), "t", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    rates = [F.lit(v).alias(c) for c, v in (("cut", cut), ("error_allow", wrong_allow), ("error_block", wrong_block))]
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"), *rates)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
