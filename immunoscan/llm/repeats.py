"""Which stretches of a document occur a second time anywhere, for a fixed window length.

A window is ``length`` consecutive symbols (bytes or words) of one document. Hashing and shuffling
every window of a corpus would cost many times the corpus, so the work goes in steps that are exact:

1. Each window has an anchor: the gram of ``gram`` symbols in it with the smallest hash. Equal
   windows have equal anchors at equal places. Only anchors (about ``2 / (length - gram)`` of all
   positions) leave the first pass, each with the hash of its context, which is the union of the
   windows that hold it, cut at the document's ends.
2. An anchor that occurs once belongs to no repeated window and drops out. Anchors with equal
   contexts settle: every window of that context is repeated.
3. The rest, and one member of each settled class as a partner for them, go on to smaller ranges
   of windows: ``nodes`` of a few windows, and at last single windows. Their hashes are compared
   in the same way, so a range is settled, dropped or refined.

Text is shuffled once, by document; the later steps share that exchange. Rows of a key are always
counted with map-side aggregation, and joins have one row a key on the small side, so that a
passage that a third of all documents share splits over tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import BYTE_VALUE, U8, chunks, flat, mix, powers, prefix, sliding, span, words
from .shared import discard, materialize, partitions

NODE_BITS = 4  # a node index and a position (below 2**28) share the low half of one long


@dataclass(frozen=True)
class Windows:
    unit: str  # "bytes" or "words"
    length: int
    gram: int
    node: int = 0  # windows in a node of the middle step; 0: no such step

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


class Chunk:
    """Symbols of a few documents with prefix hashes and, for each window, its smallest gram."""

    def __init__(self, spec: Windows, data: np.ndarray, off: np.ndarray):
        self.spec, self.data = spec, data
        if spec.unit == "words":
            self.starts, self.ends, self.off = words(data, off)
            raw = prefix(BYTE_VALUE[data])
            values = span(raw, self.starts, self.ends) | U8(1)
        else:
            values, self.off = BYTE_VALUE[data], off
        self.sums = prefix(values)
        self.n = n = values.size
        self.least = np.zeros(0, np.uint32)
        if n >= spec.length:
            k, w = spec.gram, spec.width
            gram = mix((self.sums[k:] - self.sums[:-k]) * powers(n + 1)[1][: n - k + 1])
            self.gram32 = (gram >> U8(32)).astype(np.uint32) | np.uint32(1)
            self.gram64 = gram
            self.least = sliding(self.gram32, w, np.minimum).copy()
            for end in self.off[1:]:  # windows that would leave their document
                self.least[max(0, end - spec.length + 1) : end] = 0

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor positions in the chunk and the row of each."""
        if not self.least.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = self.spec.width
        pad = np.zeros(w - 1, np.uint32)
        most = sliding(np.concatenate([pad, self.least, pad]), w, np.maximum)
        at = np.flatnonzero(most == self.gram32)
        return at, np.searchsorted(self.off, at, "right") - 1

    def bounds(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.off[row], self.off[row + 1]

    def windows_of(self, at: np.ndarray, row: np.ndarray, nearest: np.ndarray, count: int):
        """Window starts ``at - nearest - i`` that are in the document and have this anchor."""
        lo, hi = self.bounds(row)
        start = at[:, None] - nearest[:, None] - np.arange(count)
        fits = (start >= lo[:, None]) & (start <= (hi - self.spec.length)[:, None])
        fits &= (nearest[:, None] + np.arange(count)) < self.spec.width
        mine = np.zeros(start.shape, bool)
        mine[fits] = self.least[start[fits]] == np.broadcast_to(self.gram32[at][:, None], start.shape)[fits]
        return start, mine


def _arrow(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchor_rows(docs: DataFrame, spec: Windows) -> DataFrame:
    """``r1, rp, c, p``: row key, its second half with the position, gram hash and context hash."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column("text"))
            r1, r2 = (batch.column(k).to_numpy() for k in ("r1", "r2"))
            for i, j in chunks(off):
                chunk = Chunk(spec, data[off[i] : off[j]], off[i : j + 1] - off[i])
                at, row = chunk.anchors()
                if not at.size:
                    continue
                lo, hi = chunk.bounds(row)
                left, right = np.maximum(at - spec.width + 1, lo), np.minimum(at + spec.length, hi)
                cut = (at - left).astype(U8) * U8(1 << 20) + (right - at).astype(U8)
                context = mix(span(chunk.sums, left, right) ^ mix(cut + U8(77)))
                yield _arrow(["r1", "rp", "c", "p"], [r1[i:j][row], r2[i:j][row] + (at - lo), _signed(chunk.gram64[at]), _signed(context)])

    return docs.select("r1", "r2", "text").mapInArrow(run, "r1 long, rp long, c long, p long")


def _node_rows(spec: Windows):
    def run(batches):
        b = spec.node
        nodes = -(-spec.width // b)
        assert nodes <= 1 << NODE_BITS
        for batch in batches:
            data, off = flat(batch.column("text"))
            r1, r2 = (batch.column(k).to_numpy() for k in ("r1", "r2"))
            places = batch.column("places")
            for i, j in chunks(off):
                chunk = Chunk(spec, data[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = places.slice(i, j - i)
                row = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                at = chunk.off[row] + (lists.flatten().to_numpy() & 0xFFFFFFFF)
                out = []
                lo, hi = chunk.bounds(row)
                for q in range(nodes):
                    near, far = q * b, min(q * b + b, spec.width) - 1
                    _, mine = chunk.windows_of(at, row, np.full(at.size, near), far - near + 1)
                    use = mine.any(1)
                    a, r = at[use], row[use]
                    first, last = np.maximum(a - far, lo[use]), np.minimum(a - near, hi[use] - spec.length)
                    core = mix(span(chunk.sums, a - near, a - far + spec.length) ^ U8(q + 1))
                    cut = (a - first).astype(U8) * U8(1 << 20) + (a - last).astype(U8)
                    whole = mix(span(chunk.sums, first, last + spec.length) ^ mix(cut + U8(1 << 41)))
                    out.append((r1[i:j][r], r2[i:j][r] + (((a - chunk.off[r]) << NODE_BITS) | q), _signed(core), _signed(whole)))
                if out:
                    yield _arrow(["r1", "rp", "c", "p"], [np.concatenate(x) for x in zip(*out, strict=True)])

    return run


def _window_rows(spec: Windows):
    def run(batches):
        for batch in batches:
            data, off = flat(batch.column("text"))
            r1, r2 = (batch.column(k).to_numpy() for k in ("r1", "r2"))
            places = batch.column("places")
            for i, j in chunks(off):
                chunk = Chunk(spec, data[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = places.slice(i, j - i)
                row = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                place = lists.flatten().to_numpy() & 0xFFFFFFFF
                q = place & ((1 << NODE_BITS) - 1) if spec.node else np.zeros(place.size, np.int64)
                at = chunk.off[row] + (place >> NODE_BITS if spec.node else place)
                start, mine = chunk.windows_of(at, row, q * spec.node, spec.node or spec.width)
                which, col = np.nonzero(mine)
                s = start[which, col]
                s, keep = np.unique(s, return_index=True)
                r = row[which[keep]]
                h = span(chunk.sums, s, s + spec.length)
                yield _arrow(["r1", "rp", "p"], [r1[i:j][r], r2[i:j][r] + (s - chunk.off[r]), _signed(h)])

    return run


def high():
    """The row key's second half, from a packed column."""
    return F.expr("shiftleft(shiftright(rp, 32), 32)")


def low():
    """The position, from a packed column."""
    return F.expr("rp & 4294967295")


def _settle(rows: DataFrame, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows whose whole range is repeated, and those to look at more closely (with their partners).

    With ``write`` both are tables, so that ``rows`` and their shuffles can go.
    """
    classes = rows.groupBy("p").agg(F.min("c").alias("c"), F.count("*").alias("n"), F.min(F.struct("r1", "rp")).alias("rep"))
    cores = classes.groupBy("c").agg(F.sum("n").alias("nc"), F.count("*").alias("np")).where("nc > 1")
    seen = classes.join(cores, "c")
    if write:
        seen = materialize(seen.select("p", "n", "np", "rep"), "classes")
    settled = rows.join(seen.where("n > 1").select("p"), "p", "left_semi")
    if write:
        settled = materialize(settled.select("r1", "rp"), "settled")
    return settled, seen.where("n = 1 or np > 1").select("rep.r1", "rep.rp")


def _places(rows: DataFrame) -> DataFrame:
    return rows.select("r1", high().alias("r2"), low().alias("place")).groupBy("r1", "r2").agg(F.collect_list("place").alias("places"))


def intervals(docs: DataFrame, repeated: DataFrame, spec: Windows) -> DataFrame:
    """``r1, r2, spans`` of the documents: stretches (lo, hi) that repeated windows cover.

    ``docs``: r1, r2, text, already dealt out by r1, r2. ``repeated``: the anchor rows whose gram
    occurs twice, a table of ``materialize``, which is removed. A stretch may pass the document's end; the reader cuts it there.
    """
    settled, rest = _settle(repeated, write=True)
    discard(repeated)
    place = low()
    found = [settled.select("r1", high().alias("r2"), F.greatest(F.lit(0), place - (spec.width - 1)).alias("lo"), (place + spec.length).alias("hi"))]
    if spec.node:
        nodes = docs.join(_places(rest), ["r1", "r2"]).mapInArrow(_node_rows(spec), "r1 long, rp long, c long, p long")
        settled, rest = _settle(nodes)
        at, q = F.shiftright(place, NODE_BITS), place.bitwiseAND((1 << NODE_BITS) - 1)
        near = q * spec.node
        far = F.least(near + spec.node, F.lit(spec.width)) - 1
        found.append(settled.select("r1", high().alias("r2"), F.greatest(F.lit(0), at - far).alias("lo"), (at - near + spec.length).alias("hi")))
    single = docs.join(_places(rest), ["r1", "r2"]).mapInArrow(_window_rows(spec), "r1 long, rp long, p long")
    twice = single.groupBy("p").agg(F.count("*").alias("n")).where("n > 1").select("p")
    hits = single.join(twice, "p", "left_semi")
    found.append(hits.select("r1", high().alias("r2"), place.alias("lo"), (place + spec.length).alias("hi")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("r1", "r2").agg(F.collect_list(F.struct(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("spans"))


def covered(n: int, spans) -> np.ndarray:
    """Merged stretches (lo, hi) within 0..n."""
    if spans is None or not len(spans) or not n:
        return np.zeros((0, 2), np.int64)
    at = np.array(spans, np.int64).reshape(-1, 2)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(at[:, 0], n), 1)
    np.add.at(step, np.minimum(at[:, 1], n), -1)
    inside = np.concatenate([[0], np.cumsum(step[:n]) > 0, [0]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    return edge.reshape(-1, 2)


def removal(docs: DataFrame, spans: DataFrame, unit: str, keep_text: bool = False) -> DataFrame:
    """Each document with what stays of it: doc_id, n, n_removed, n_spans, kept_sha256 (and kept)."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column("text"))
            lists = batch.column("spans")
            out = []
            for k in range(batch.num_rows):
                text = data[off[k] : off[k + 1]]
                got = lists[k].values
                got = None if got is None else np.stack([got.field(0).to_numpy(), got.field(1).to_numpy()], 1)
                if unit == "words":
                    starts, ends, _ = words(text, np.array([0, text.size]))
                    n, cut = starts.size, covered(starts.size, got)
                    gone = np.zeros(n, bool)
                    for lo, hi in cut:
                        gone[lo:hi] = True
                    raw = text.tobytes()
                    kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
                    removed = int(gone.sum())
                else:
                    n, cut = text.size, covered(text.size, got)
                    edges = [0, *cut.ravel().tolist(), n]
                    raw = text.tobytes()
                    kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    removed = int((cut[:, 1] - cut[:, 0]).sum())
                out.append((n, removed, len(cut), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))
            arrays = [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return docs.join(spans, ["r1", "r2"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text and row keys, dealt out by the keys: the one exchange of whole texts."""
    from .shared import row_keys

    keyed = docs.select("doc_id", "text", *row_keys())
    return keyed.repartition(partitions(docs.sparkSession), "r1", "r2")
