"""Operator 13: prefix trie of conversations, by union-find over the LCP edges of sorted neighbours.

Conversations are sorted by their turns (16 bytes of digest a turn, so that byte order is order by turns) into ranges.
The edge between two neighbours weighs their longest common prefix in turns. A task takes the edges of its range in
descending weight: a union at depth d makes a branching node of depth d over both components, or hangs one below the
other where that already has this depth. This gives the range's forest; the nodes of each path without branches are
written out last.

A node may cross ranges only if it holds the first or the last conversation of a range and is no deeper than the prefix
shared with the neighbour beyond. These open nodes are all that is left of a forest after contraction: a few numbers a
depth, for both ends of a range. The driver joins them over the borders, again by union-find in descending depth; it gets at most
two rows a range and turn of the range's end conversations, whatever the number of conversations is. Then the tasks
write their nodes, with open parents looked up among the joined ones.

All sums of a node are sums over its conversations in sorted order, so pieces add up: with the prefix l that a
conversation shares with the one before it, and T the running code points of its turns, it starts the nodes of depth
l + 1 to its length, ends a leaf if the next shares less than its whole length, and saves T(l).

Defined cases: rows without conv_id belong to no conversation. Turns that share a number (or have none) are in the order
of their digest; rows that repeat are turns of their own. A conversation's digests (24 bytes a turn with its length) fit in one row. Extra
columns are ignored. An empty table has no nodes. Very long texts are digested where they are read and don't travel.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, partitions, shared_dir, table

WIDTH = 16  # bytes of a turn's digest
LINE = 1 << 16  # characters of a piece of the ids that end at an open node
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, digest, code points) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).alias("points"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(conversations: DataFrame, share: int = 100, most: int = 6) -> DataFrame:
    """conv_id, seq (digests of all turns), points (array): the first h turns of the conversation at the start of the hundred, then the
    own turns after the first h."""
    own = materialize(sequences(conversations), "turns")
    base = own.where(F.col("conv_id") % share == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("shared"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % share).join(base, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = F.slice(F.coalesce("shared", F.array().cast(own.schema["turns"].dataType)), F.lit(1), h)
    turns = F.concat(first, F.slice("turns", h + 1, F.size("turns")))
    out = both.select("conv_id", turns.alias("turns"))
    return out.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("seq"), F.col("turns.points").alias("points"))


def shared_prefix(a: bytes, b: bytes) -> int:
    """Turns that both start with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int(np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))[0]) // WIDTH


class Forest:
    """The nodes of one range of sorted conversations. ``before`` and ``after``: turns that the first and the last conversation share with the
    neighbours beyond, -1 at the ends of the table."""

    def __init__(self, ids: list[int], seqs: list[bytes], points: list, before: int, after: int):
        k = len(ids)
        self.ids, self.seqs, self.before, self.after = ids, seqs, before, after
        self.size = np.array([len(s) // WIDTH for s in seqs], np.int64)
        self.points = [np.concatenate([[0], np.cumsum(np.array(p, np.int64))]) for p in points]
        lcp = np.array([before, *[shared_prefix(a, b) for a, b in zip(seqs, seqs[1:], strict=False)]], np.int64)
        self.lcp = lcp  # with the conversation before
        following = np.append(lcp[1:], after)
        saved = np.array([self.points[i][max(lcp[i], 0)] for i in range(k)], np.int64)
        self.leaf_sum = np.concatenate([[0], np.cumsum(following < self.size)])
        self.saved_sum = np.concatenate([[0], np.cumsum(saved)])
        self.depth, self.left, self.right, self.least, self.parent = list(self.size), list(range(k)), list(range(k)), list(ids), [-1] * k
        self.alias = list(range(k))
        self._unite()

    def _top(self, node: int) -> int:
        while self.alias[node] != node:
            self.alias[node] = self.alias[self.alias[node]]
            node = self.alias[node]
        return node

    def _unite(self) -> None:
        k = len(self.ids)
        up, top = list(range(k)), list(range(k))  # components of conversations, and the highest node of each

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in np.argsort(-self.lcp[1:], kind="stable").tolist():
            d, a, b = int(self.lcp[i + 1]), find(i), find(i + 1)
            p, q = top[a], top[b]
            if self.depth[p] == d:
                if self.depth[q] == d:
                    self.alias[q] = p  # one node
                else:
                    self.parent[q] = p
                keep = p
            elif self.depth[q] == d:
                self.parent[p] = keep = q
            else:
                keep = len(self.depth)
                self.depth.append(d)
                self.parent.append(-1)
                self.alias.append(keep)
                self.parent[p] = self.parent[q] = keep
                self.left.append(0)
                self.right.append(0)
                self.least.append(0)
            # top is the left one's span joined to the right one's
            left, right, least = self.left[p], self.right[q], min(self.least[p], self.least[q])
            self.left[keep], self.right[keep], self.least[keep] = left, right, least
            up[b] = a
            top[a] = keep
        root = top[find(0)]
        if self.depth[root] > 0:
            self.parent[root] = len(self.depth)
            for rows, x in ((self.depth, 0), (self.left, 0), (self.right, k - 1), (self.least, self.least[root]), (self.parent, -1), (self.alias, len(self.alias))):
                rows.append(x)

    def nodes(self):
        """(depth, left, right, least, children) of each compact node, and of its parent."""
        real = [x for x in range(len(self.depth)) if self.alias[x] == x]
        parents = {x: self._top(self.parent[x]) for x in real if self.parent[x] >= 0}
        children = defaultdict(int)
        for p in parents.values():
            children[p] += 1
        for x in real:
            yield tuple(None if y is None else (self.depth[y], self.left[y], self.right[y], self.least[y], children[y]) for y in (x, parents.get(x)))

    def open_to(self, left: int, right: int) -> int:
        """The greatest depth at which a node over these conversations goes on beyond the range."""
        return max(self.before if left == 0 else -1, self.after if right == len(self.ids) - 1 else -1)

    def sums(self, left: int, right: int, d: int) -> tuple[int, int, int]:
        """Conversations, leaves and saved code points of the nodes of depth d and below, without what a piece further left shares."""
        n = right - left + 1
        held = int(self.points[left][max(d - 1, 0)])
        first = int(self.lcp[left] < d or self.lcp[left] < 0)  # the node's first conversation saves nothing
        saved = int(self.saved_sum[right + 1] - self.saved_sum[left + first]) - held * (n - first)
        return n, int(self.leaf_sum[right + 1] - self.leaf_sum[left]), saved

    def pieces(self):
        """depth, goes on left, goes on right, conversations, least, children, leaves, saved of the open nodes."""
        last = len(self.ids) - 1
        for (depth, left, right, least, children), parent in self.nodes():
            for d in range(parent[0] + 1 if parent else 0, min(depth, self.open_to(left, right)) + 1):
                goes = (left == 0 and d <= self.before, right == last and d <= self.after)
                n, leaves, saved = self.sums(left, right, d)
                below = children if d == depth else 1
                yield d, *goes, n, least, below - int(goes[0] and self.before > d), leaves, saved

    def ends(self, d: int, left: int, right: int) -> range:
        """The conversations that end at a node: they come first in it, by conv_id."""
        stop = left
        while stop <= right and self.size[stop] == d:
            stop += 1
        return range(left, stop)

    def rows(self, merged: dict):
        """The closed nodes, and for open nodes the pieces of their ids: (row of NODE, node, line). ``merged``: (depth, is it the right end) -> (node, least)."""

        def found(left, right, least, d):
            """The joined node of an open piece, or the closed node's own least conversation."""
            return merged[d, not (left == 0 and d <= self.before)] if d <= self.open_to(left, right) else (None, least)

        for (depth, left, right, least, children), above in self.nodes():
            ended = self.ends(depth, left, right)
            node, sha = found(left, right, least, depth)[0], EMPTY
            if node is not None:
                yield from ((None, node, line) for line in lines(self.ids[i] for i in ended))
            elif ended:
                sha = hashlib.sha256(",".join(str(self.ids[i]) for i in ended).encode()).hexdigest()
            top = above[0] if above else -1
            for d in range(max(top, self.open_to(left, right)) + 1, depth + 1):
                parent = None if d == 0 else found(*above[1:4], top)[1] if d - 1 == top else found(left, right, least, d - 1)[1]
                n, leaves, saved = self.sums(left, right, d)
                yield (least, d, parent, n, children if d == depth else 1, leaves, saved, sha if d == depth else EMPTY), None, None


def lines(ids):
    """Comma-joined ids in pieces."""
    now, size = [], 0
    for i in ids:
        now.append(str(i))
        size += len(now[-1]) + 1
        if size > LINE:
            yield ",".join(now)
            now, size = [], 0
    if now:
        yield ",".join(now)


def joined(borders: list[tuple[int, int, int]], pieces: dict) -> tuple[list[tuple], dict]:
    """Union-find over the borders (range, next range, shared turns), deepest first. ``pieces``: (range, depth, is it the right end) ->
    (piece, conversations, least, children, leaves, saved). Rows (node, depth, least, parent's least, conversations, children, leaves, saved), and
    for each piece's key its (node, least)."""
    up = list(range(max((p[0] for p in pieces.values()), default=-1) + 1))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges = [(d, a, b) for a, b, shared in borders for d in range(shared + 1)]
    for d, a, b in sorted(edges, reverse=True):
        up[find(pieces[b, d, False][0])] = find(pieces[a, d, True][0])
    nodes: dict = {}
    done = set()
    for (_, d, _), (piece, *values) in pieces.items():
        if piece not in done:
            done.add(piece)
            have = nodes.setdefault(find(piece), [d, 0, None, 0, 0, 0])
            n, least, *sums = values
            have[1:] = [have[1] + n, least if have[2] is None else min(have[2], least), *(x + y for x, y in zip(have[3:], sums, strict=True))]
    parents = {}
    for (part, d, side), (piece, *_) in pieces.items():
        if d:
            parents[find(piece)] = nodes[find(pieces[part, d - 1, side][0])][2]
    rows = [(node, d, least, parents.get(node), n, *sums) for node, (d, n, least, *sums) in nodes.items()]
    return rows, {key: (find(v[0]), nodes[find(v[0])][2]) for key, v in pieces.items()}


def trie(convs: DataFrame) -> DataFrame:
    """The nodes over conversations (conv_id, seq, points), as in NODE."""
    spark = convs.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ordered = convs.repartitionByRange(partitions(spark), "seq", "conv_id").sortWithinPartitions("seq", "conv_id").checkpoint()  # later passes find the same ranges

    def tips(batches):
        first = last = None
        for batch in batches:
            seqs = batch.column("seq")
            if len(seqs):
                first = seqs[0].as_py() if first is None else first
                last = seqs[-1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first], "last": [last]})

    ends = sorted(ordered.select("seq").mapInArrow(tips, "part int, first binary, last binary").collect())  # one row a range
    borders = [(a["part"], b["part"], shared_prefix(a["last"], b["first"])) for a, b in zip(ends, ends[1:], strict=False)]
    before, after = {b: n for _, b, n in borders}, {a: n for a, _, n in borders}

    def forest(batches):
        ids, seqs, points = [], [], []
        for batch in batches:
            ids += batch.column("conv_id").to_pylist()
            seqs += batch.column("seq").to_pylist()
            points += batch.column("points").to_numpy(zero_copy_only=False).tolist()
        part = TaskContext.get().partitionId()
        return part, Forest(ids, seqs, points, before.get(part, -1), after.get(part, -1)) if ids else None

    def open_pieces(batches):
        part, own = forest(batches)
        rows = list(own.pieces()) if own else []
        cols = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.bool_()) for c in cols[1:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], names=[c.split()[0] for c in piece_schema.split(", ")])

    piece_schema = "part int, depth long, on_left boolean, on_right boolean, n long, least long, children long, leaves long, saved long"
    pieces = {}
    for i, r in enumerate(ordered.mapInArrow(open_pieces, piece_schema).collect()):  # at most two rows a range and turn of its end conversations
        for side in (False, True):
            if r["on_right" if side else "on_left"]:
                pieces[r["part"], r["depth"], side] = (i, r["n"], r["least"], r["children"], r["leaves"], r["saved"])
    open_rows, found = joined(borders, pieces)
    by_part = defaultdict(dict)
    for (part, d, side), value in found.items():
        by_part[part][d, side] = value
    shared = spark.sparkContext.broadcast(dict(by_part))  # as many entries as pieces

    def all_nodes(batches):
        part, own = forest(batches)
        rows, at = [], 0
        for closed, node, line in own.rows(shared.value.get(part, {})) if own else ():
            rows.append((*(closed or (None,) * 8), node, part, at, line))
            at += 1
            if len(rows) == 5000:
                yield arrow(rows)
                rows = []
        yield arrow(rows)

    schema = f"{NODE}, node long, part long, line_no long, line string"
    names, types = zip(*((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in schema.split(", ")), strict=True)

    def arrow(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names=list(names))

    out = materialize(ordered.mapInArrow(all_nodes, schema), "nodes")
    closed = out.where("node is null").select(*[c.split()[0] for c in NODE.split(", ")])
    if not open_rows:
        return closed
    crossing = spark.createDataFrame(open_rows, "node long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    crossing = crossing.join(digests(out.where("node is not null").select("node", "part", "line_no", "line")), "node", "left")
    return closed.unionByName(crossing.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).drop("node"))


def digests(rows: DataFrame) -> DataFrame:
    """node, ends_sha256: over the lines of a node in order, one line in memory at a time."""

    def run(batches):
        now, hashed = None, None
        for batch in batches:
            done = []
            for node, line in zip(batch.column("node").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = node, hashlib.sha256(line.encode())
                else:
                    hashed.update(b"," + line.encode())
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(("node", "ends_sha256"), zip(*done, strict=True), strict=True)))
        if now is not None:
            yield pa.RecordBatch.from_pydict({"node": [now], "ends_sha256": [hashed.hexdigest()]})

    return rows.repartition("node").sortWithinPartitions("node", "part", "line_no").mapInArrow(run, "node long, ends_sha256 string")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rebuilt conversations."""
    return trie(rebuilt(table(spark, sf_dir, "conversations")))
