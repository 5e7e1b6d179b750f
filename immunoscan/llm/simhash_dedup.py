"""Operator 7: SimHash near-dedup by a binary trie self-join.

Fingerprints are computed in Arrow batches, and only distinct ones go on. The trie over them is cut at
a depth that grows with the logarithm of their number: a subtree is paired with each subtree whose
prefix differs in at most ``radius`` bits, and a task walks its node pairs together, level by level,
charging differing bits and dropping a pair once it is over the error budget. A fingerprint has at
most C(64, 1) + C(64, 2) neighbours within two bits, so the links of a task stay proportional to its
fingerprints; a task returns a star forest of its links. Components follow from graph.components.

Null, empty and blank texts have fingerprint zero and link with each other. Rows that repeat share a
fingerprint. Extra columns are ignored; an empty table gives an empty result. A null doc_id takes part
and gets the component of its fingerprint.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components, forest
from .numtext import SPACE, U8, chunks, flat, words
from .shared import discard, materialize, partitions, row_keys, small_batches, table

LEAF = 256  # fingerprints a subtree, about
BANDS, ROWS = 20, 4  # at similarity 0.8 a pair agrees on no band with probability 3e-5
SPREAD = 1000  # pairs that meet one copy of a set
CHUNK = 20_000  # rows a walk holds at once
SLACK = 1e-9  # a bound may admit a pair too many, but never lose one to rounding


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def _hashed(batch, shingle: int):
    """Shingle hashes of a batch's texts, in parts: (rows, first hash of each row, number of its hashes, hashes).
    Rows without words are left out."""
    import xxhash

    digest, low = xxhash.xxh64_intdigest, _lower()
    data, off = flat(batch.column("text"))
    for i, j in chunks(off, 1 << 20):
        part = low[data[off[i] : off[j]]]
        starts, ends, first = words(part, off[i : j + 1] - off[i])
        if not starts.size:
            continue
        keep = ~SPACE[part]
        after = ends[ends < part.size]
        after = after[SPACE[part[after]]]
        keep[after] = True
        part[after] = 32
        to = np.cumsum(keep) - 1
        raw = part[keep].tobytes()
        s, e = to[starts], to[ends - 1] + 1
        count = np.diff(first)
        some = np.flatnonzero(count)
        # the last shingle - 1 words of a document start no shingle, unless there are no others
        opens = np.ones(starts.size, bool)
        close = np.minimum(np.arange(starts.size) + shingle - 1, starts.size - 1)
        for back in range(1, shingle):
            opens[(first[1:] - back)[count >= back + 1]] = False
        short = some[count[some] < shingle]
        close[first[short]] = first[short + 1] - 1
        at = np.flatnonzero(opens)
        h = np.array([digest(raw[a:b], 42) for a, b in zip(s[at].tolist(), e[close[at]].tolist(), strict=True)], U8)
        begin = np.searchsorted(at, first[some])
        yield i + some, begin, np.diff(np.append(begin, at.size)), h


def _fingerprint(h: np.ndarray) -> int:
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > h.size).view(">u8")[0]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` with fp the SimHash over word shingles as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.zeros(batch.num_rows, U8)
            for rows, begin, n, h in _hashed(batch, shingle):
                for k, b, m in zip(rows.tolist(), begin.tolist(), n.tolist(), strict=True):
                    fps[k] = _fingerprint(h[b : b + m])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, fp long")


def walk(values: np.ndarray, pairs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the budget. values: fingerprints, sorted within each range. pairs: rows of
    (lo, hi, lo, hi, budget), two nodes at ``depth`` as ranges of values; equal ranges pair a node with itself."""
    left, right = [], []
    while pairs.size:
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        own = pairs[:, 0] == pairs[:, 2]
        done = (size <= 8) | (depth == 64)
        end = pairs[done]
        if end.size:
            width = end[:, 3] - end[:, 2]
            count = (end[:, 1] - end[:, 0]) * width
            k = np.repeat(np.arange(len(end)), count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = end[k, 0] + step // width[k], end[k, 2] + step % width[k]
            use = ~((end[k, 0] == end[k, 2]) & (i >= j))
            i, j, k = i[use], j[use], k[use]
            use = np.bitwise_count((values[i] ^ values[j]) << U8(depth) if depth < 64 else np.zeros(i.size, U8)) <= end[k, 4]
            left.append(values[i[use]])
            right.append(values[j[use]])
        pairs, own = pairs[~done], own[~done]
        if not pairs.size:
            break
        zero = np.concatenate([[0], np.cumsum((values >> U8(63 - depth)) & U8(1) == 0)])
        a, b, c, d, budget = pairs.T
        m, n = a + zero[b] - zero[a], c + zero[d] - zero[c]
        same = np.concatenate([np.stack([a, m, c, n, budget], 1), np.stack([m, b, n, d, budget], 1)])
        cross = np.concatenate([np.stack([a, m, n, d, budget - 1], 1), np.stack([m, b, c, n, budget - 1], 1)[~own]])
        pairs = np.concatenate([same, cross[cross[:, 4] >= 0]])
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
        depth += 1
    empty = np.zeros(0, U8)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _subtrees(depth: int, radius: int):
    def links(tree: np.ndarray, fp: np.ndarray):
        own = (fp >> U8(64 - depth) if depth else np.zeros(fp.size, U8)).astype(np.int64)
        order = np.lexsort((fp, own, own != tree, tree))
        tree, own, fp = tree[order], own[order], fp[order]
        new = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (own[1:] != own[:-1])]))
        end = np.append(new[1:], fp.size)
        at_home = own[new] == tree[new]
        home = dict(zip(tree[new[at_home]].tolist(), zip(new[at_home].tolist(), end[at_home].tolist(), strict=True), strict=True))
        rows = []
        for lo, hi, t, o in zip(new.tolist(), end.tolist(), tree[new].tolist(), own[new].tolist(), strict=True):
            if t in home:
                rows.append((*home[t], lo, hi, radius - (t ^ o).bit_count()))
        if not rows:
            return None
        a, b = walk(fp, np.array(rows, np.int64), depth)
        if not a.size:
            return None
        a, b = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        trees, fps, held = [], [], 0
        for batch in batches:
            tree, fp = batch.column("tree").to_numpy(), batch.column("fp").to_numpy().view(U8)
            cut = int(np.searchsorted(tree, tree[-1])) if tree.size else 0
            if held + tree.size > CHUNK and (cut or (trees and tree.size and trees[-1][-1] != tree[0])):
                trees.append(tree[:cut])
                fps.append(fp[:cut])
                if (out := links(np.concatenate(trees), np.concatenate(fps))) is not None:
                    yield out
                trees, fps, held, tree, fp = [], [], 0, tree[cut:], fp[cut:]
            trees.append(tree)
            fps.append(fp)
            held += tree.size
        if held and (out := links(np.concatenate(trees), np.concatenate(fps))) is not None:
            yield out

    return run


def trie_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (fp), as forests of the tasks' links."""
    n = distinct.count()
    depth = min(24, max(0, round(math.log2(max(1, n) / LEAF))))
    masks = [0] + [sum(1 << x for x in c) for k in range(1, radius + 1) for c in combinations(range(depth), k)]
    own = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    trees = F.explode(F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("own").bitwiseXOR(m)), lambda t: t <= F.col("own")))
    met = distinct.select("fp", own.alias("own")).select("fp", trees.alias("tree"))
    dealt = met.repartition(partitions(distinct.sparkSession), "tree").sortWithinPartitions("tree")
    return dealt.mapInArrow(_subtrees(depth, radius), "a long, b long")


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    small_batches(docs.sparkSession)
    marked = materialize(fingerprints(docs, shingle), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    label = materialize(components(trie_links(distinct, radius)), "components")
    member = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = member.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = member.join(named, "label").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(7).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return drawn[0] | U8(1), drawn[1]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, key, key2, node, fp, bands``: the keys stand for the row, node for the set of shingles, bands for groups of its least hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    times, plus = _seeds(BANDS * ROWS)
    at_band = np.arange(1, BANDS + 1, dtype=np.uint64) * U8(0x9E3779B97F4A7C15)

    def run(batches):
        import xxhash

        for batch in batches:
            fps, nodes = np.zeros(batch.num_rows, U8), np.zeros(batch.num_rows, U8)
            bands = np.zeros((batch.num_rows, BANDS), U8)
            some = np.zeros(batch.num_rows, bool)
            for rows, begin, n, h in _hashed(batch, shingle):
                for k, b, m in zip(rows.tolist(), begin.tolist(), n.tolist(), strict=True):
                    own = np.unique(h[b : b + m])
                    fps[k], nodes[k], some[k] = _fingerprint(own), xxhash.xxh64_intdigest(own.tobytes(), 1), True
                    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, U8)
                    for x in range(0, own.size, 4096):
                        mixed = own[x : x + 4096, None] * times + plus
                        least = np.minimum(least, (mixed ^ (mixed >> U8(29))).min(0))
                    key = at_band.copy()
                    for row in least.reshape(BANDS, ROWS).T:
                        key = (key ^ row) * U8(0xBF58476D1CE4E5B9)
                        key ^= key >> U8(31)
                    bands[k] = key
            sizes = np.where(some, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(bands[some].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("key2"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), lists], names=["doc_id", "key", "key2", "node", "fp", "bands"])

    own, other = row_keys()
    keyed = docs.select("doc_id", own.alias("key"), other.alias("key2"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, key long, key2 long, node long, fp long, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``key, sh``: the distinct shingle hashes of each row's text."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for rows, begin, n, h in _hashed(batch, shingle):
                lists = [np.unique(h[b : b + m]).view(np.int64) for b, m in zip(begin.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(lists, pa.list_(pa.int64()))], names=["key", "sh"])

    return docs.mapInArrow(run, "key long, sh array<long>")


def _candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """``node, pick`` of the nodes that share a band of least hashes, or a link of the trie join, with another node."""
    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    met = bands.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    by_fp = materialize(nodes.where("size(bands) > 0").groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    links = trie_links(by_fp.select("fp"), radius)
    near = links.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(by_fp.where("n > 1").select("fp")).distinct()
    found = bands.join(met, "bucket").select("node").unionByName(nodes.join(near, "fp").select("node")).distinct()
    return nodes.join(found, "node").select("node", "pick")


def _rare_first(sets: DataFrame, similarity: float) -> DataFrame:
    """``node, n, sh, rest``: the rows of the prefix index. Shingles are ordered by the number of nodes that have them,
    then by hash; rest counts a node's shingles from this one on. The first shingle that two nodes share has all
    their common shingles behind it, so it has a row in both: rest can't be less than similarity * n."""
    each = sets.select("node", F.size("sh").alias("n"), F.explode("sh").alias("sh"))
    shared = each.groupBy("sh").agg(F.count("*").alias("df")).where("df > 1")
    back = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("df"), F.desc("sh")))
    ranked = each.join(shared, "sh").withColumn("rest", back)
    return ranked.where(F.col("rest") + SLACK >= F.lit(similarity) * F.col("n")).select("node", "n", "sh", "rest")


def _reach(similarity: float, rest: str = "rest", n: str = "n"):
    """The greatest size of another set that still can have this similarity, given the shingles from here on."""
    return F.lit((1 + similarity) / similarity) * F.col(rest) - F.col(n) + SLACK


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose shingle sets have at least this Jaccard similarity. A node may stand in very
    many pairs as b: a copy of its set serves ``SPREAD`` of them."""
    met = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).alias("copies"))
    right = sets.select(F.col("node").alias("b"), F.col("sh").alias("sb")).join(met, "b").select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(met, "b").select("a", "b", F.pmod(F.xxhash64("a"), "copies").alias("copy"))
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), "a").join(right, ["b", "copy"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common + SLACK >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _with_heads(index: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each node of a shingle's rows with one of them, that with the least share of rarer shingles: in a group
    of edited copies it is nearest to what they were copied from, so most of the group links with it."""
    order = (F.col("n") - F.col("rest")) / F.col("n")
    heads = index.groupBy("sh").agg(F.min(F.struct(order.alias("o"), "node", "n", "rest")).alias("h"), F.count("*").alias("m")).where("m > 1")
    met = index.join(heads, "sh").where((F.col("node") != F.col("h.node")) & (F.col("h.n") <= _reach(similarity)) & (F.col("n") <= _reach(similarity, "h.rest", "h.n")))
    return met.select(F.col("node").alias("a"), F.col("h.node").alias("b")).distinct()


def _still_apart(index: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """All pairs that share a row of the index, can be similar by their sizes and places, and have different labels.

    Rows of a shingle's commonest label meet only rows of other labels, and only those whose sizes are near."""
    named = index.join(label, "node", "left").select("node", "n", "sh", "rest", F.coalesce("label", "node").alias("label"))
    named = named.withColumn("reach", _reach(similarity))

    def mixed(rows):
        by_label = rows.groupBy("sh", "label").agg(F.count("*").alias("c"), F.min("n").alias("least"))
        by = by_label.groupBy("sh").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.min("least").alias("least"))
        return rows.join(by.where("labels > 1").select("sh", "main", "least"), "sh").where("reach >= least").drop("least")

    rows = materialize(mixed(mixed(named).drop("main")).withColumn("cls", F.floor(F.log("n") / F.lit(-math.log(similarity)) + SLACK)), "apart")
    few = rows.where("label <> main").select("sh", F.explode(F.sequence(F.col("cls") - 1, F.col("cls") + 1)).alias("cls"), *[F.col(c).alias(c + "_a") for c in ("node", "n", "reach", "label")])
    both = few.join(rows, ["sh", "cls"]).where("label <> label_a and n <= reach_a and n_a <= reach")
    pairs = materialize(both.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct(), "pairs")
    discard(rows)
    return pairs


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """``doc_id, component_id``: groups by links between documents whose shingle sets have this Jaccard similarity.

    Candidates are documents with a link of the trie join, or that agree on a band of least hashes. Among them links are
    found exactly, by a prefix index over their rarest shingles: first each document of an index entry meets one other,
    so a group of near copies costs a link a document; then all pairs that are still apart and can be similar.
    """
    marked, labels = _grouped(docs, shingle, similarity, radius)
    named = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(labels.join(named, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def kept_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """``r1, r2, n``: the ``row_keys`` of the row of each such group that stays, and how often that row repeats.
    It is the row of the least doc_id, and of the least key among rows that share it; a null doc_id comes last."""
    marked, labels = _grouped(docs, shingle, similarity, radius)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "key2")
    first = marked.groupBy("node").agg(F.min(order).alias("first")).join(labels.select("node", "label"), "node").groupBy("label").agg(F.min("first").alias("first"))
    keys = first.select(F.col("first.key").alias("key"), F.col("first.key2").alias("key2"))
    return marked.select("key", "key2").join(keys, ["key", "key2"]).groupBy(F.col("key").alias("r1"), F.col("key2").alias("r2")).agg(F.count("*").alias("n"))


def _grouped(docs: DataFrame, shingle: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs``, and ``node, least, label`` of their nodes."""
    small_batches(docs.sparkSession)
    marked = materialize(sketches(docs, shingle), "sketches")
    nodes = materialize(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("key").alias("pick"), F.min("doc_id").alias("least")), "nodes")
    picks = materialize(_candidates(nodes, radius), "candidates")
    rows = docs.select(row_keys()[0].alias("key"), "text").join(picks.select(F.col("pick").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    sets = materialize(_sets(rows, shingle).join(picks.withColumnRenamed("pick", "key"), "key").select("node", "sh"), "sets")
    index = materialize(_rare_first(sets, similarity), "index")
    links = materialize(_verified(materialize(_with_heads(index, similarity), "pairs"), sets, similarity), "links")
    label = materialize(components(links), "components")
    more = materialize(_verified(_still_apart(index, label, similarity), sets, similarity), "links")
    if not more.isEmpty():
        label = materialize(components(links.unionByName(more)), "components")
    for done in (picks, sets, index, links, more):
        discard(done)
    return marked, nodes.select("node", "least").join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
