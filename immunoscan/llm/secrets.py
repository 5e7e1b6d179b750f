"""Operator 10: secret scan with corpus-wide ownership frequency.

Three patterns give base spans. Wider patterns give candidates that these miss: runs of 16 and more token characters with
letters and digits, values behind other key words (pwd, auth, bearer, credential, private key ...), and passwords within
URLs. Values are hashed and counted by distinct repository and owner over all documents, in
two map-side aggregations: a value that few owners hold and that looks live (mixed characters) is theirs,
one that many hold is an example. Candidates that are owner-specific and overlap no base span are added.
The repository is the column source. No column names an owner, so the text itself stands for it: exact copies of
a document have one owner, other documents with the value one more each. So an example that stands in many
documents of one source is told apart from a key that only copies of one document have.

Positions come from the gaps between matches, so no marker can clash with a text. They are code points,
end exclusive, of whole matches. All of it is DataFrame work.

Null text counts as empty; a null source is one unknown repository. A very long text is scanned whole in its row.
Of matches of a kind the leftmost counts; spans that start together are listed in the order of kinds. Repeated rows count as one document
for ownership and get equal results. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, row_keys, table

#: kind, pattern, group of the value, least length of the value; in the order of the kinds
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: the same of the candidates; a value needs letters and digits
WIDE = [
    ("owned", r"[A-Za-z0-9+/_=-]{16,}", 0, 16),
    ("keyed", r"""((?i:pwd|passphrase|auth|authorization|bearer|credentials?|private_?key|access_?key))["']?(?:\x20*[:=]\x20*|\x20+)["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("login", r"""(://[^/\x20\x09-\x0D:@]+):([^/\x20\x09-\x0D:@]+)@""", 2, 6),
]
OWNERS = 2  # owners and repositories a live credential has at most
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:long>>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans are gathered in blocks of as many matches as the root of their number: a list of k is copied some sqrt(k) times, not k times."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as {SPAN})")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def add(acc, x):
        # (gap, match, value) in a row; positions add up from the left
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), F.xxhash64(x["value"]).alias("value"))
        take = F.length(x["value"]) >= least
        if rank >= len(KINDS):
            take = take & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
        return state(stop, F.when(take, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]))

    def all_of(rows):
        size = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(rows))).cast("int"))
        block = lambda acc, first: F.aggregate(F.slice(rows, first, size), state(acc["at"], none), add, lambda r: state(r["at"], F.concat(acc["out"], r["out"])))
        return F.aggregate(F.sequence(F.lit(1), F.size(rows), size), state(F.lit(0), none), block)["out"]

    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))
    # the array of one makes the rows a variable, which is worked out once
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(rows), all_of), 0)).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, repo: str = "source", owner: str | None = None) -> DataFrame:
    """r1, r2, doc_id, base and added: the spans of each document, with value hashes, and live hashes. ``owner``: a column,
    None for the hash of the text."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        *row_keys(),
        "doc_id",
        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"),
        (F.xxhash64("text").cast("string") if owner is None else F.coalesce(F.col(owner).cast("string"), F.lit(""))).alias("owner"),
        F.concat(*[_spans(text, kind, k, rx, group, least) for k, (kind, rx, group, least) in enumerate(KINDS)]).alias("base"),
        F.concat(*[_spans(text, kind, len(KINDS) + k, rx, group, least) for k, (kind, rx, group, least) in enumerate(WIDE)]).alias("wide"),
    )
    found = materialize(found, "spans")
    some = found.where("size(base) > 0 or size(wide) > 0")
    each = some.select("r1", "r2", "repo", "owner", F.explode(F.concat("base", "wide")).alias("s"))
    held = each.select(F.col("s.value").alias("value"), "repo", "owner").groupBy("value", "repo", "owner").agg(F.count("*").alias("n"))
    owners = held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    live = owners.where((F.col("owners") <= OWNERS) & (F.col("repos") <= OWNERS)).select("value")
    kept = each.select("r1", "r2", F.col("s.value").alias("value")).distinct().join(live, "value", "left_semi")
    kept = kept.groupBy("r1", "r2").agg(F.collect_list("value").alias("live"))
    none = F.expr("cast(array() as array<long>)")
    out = found.join(kept, ["r1", "r2"], "left").withColumn("live", F.coalesce("live", none))
    free = F.filter("wide", lambda w: F.array_contains("live", w["value"]) & ~F.exists("base", lambda b: (w["start"] < b["stop"]) & (b["start"] < w["stop"])))
    return out.select("r1", "r2", "doc_id", "base", free.alias("added"), "live")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    mine = F.size(F.filter("base", lambda s: F.array_contains("live", s["value"]))).cast("long")
    return out.select(
        "doc_id",
        *[_count(kind).alias(f"n_{kind}") for kind, *_ in KINDS],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        mine.alias("n_live"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with the same columns; live base spans and added spans are masked in the text."""
    found = scan(docs)
    cut = F.concat(F.filter("base", lambda s: F.array_contains("live", s["value"])), "added")
    found = found.select("r1", "r2", F.array_sort(cut).alias("cut_")).where("size(cut_) > 0").dropDuplicates(["r1", "r2"]).withColumnsRenamed({"r1": "r1_key_", "r2": "r2_key_"})

    def add(acc, s):
        later = s["stop"] > acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        joined = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(F.when(later, s["stop"]).otherwise(acc["at"]).alias("at"), F.when(later, joined).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("cut_", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    masked = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    keyed = docs.select(*docs.columns, *row_keys("_key_")).join(found, ["r1_key_", "r2_key_"], "left")
    new = keyed.withColumn("text", F.when(F.col("cut_").isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("cut_").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)
