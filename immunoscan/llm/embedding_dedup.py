"""Operator 8: embedding near-dedup by a subspace pigeonhole join.

Two unit vectors with cosine >= c have squared distance <= 2 - 2c. The vectors are rotated by a fixed
random orthogonal matrix and split into blocks; a block's budget is its share of that distance, so at
least one block of a linked pair is within its own. Pairs within a block's budget are candidates; they are
verified in double precision on the given vectors.

Equal vectors of a label form a class first; only one row of each is joined, with its weight and a number of its own, so a vec_id that
stands in several classes links them with nothing. The classes of a label are dealt into chunks of bounded size, which are written once to the
shared folder. A unit of the join is two chunks of one label, named by file and place; its task reads them. So no vector is copied for the
units that it meets in: disk grows with the vectors, only work with their pairs. A table names what was written; Spark commits it, so
files of lost tasks are never read. Tasks return link counts and a star forest of the links, never all pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label,
link with nothing: n_links 0, their own component. Repeated rows link with each other. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import materialize, partitions, shared_dir, table

UNIT, VALUES = 4096, 1 << 21  # rows of a chunk at most, and their components
TILE = 1024  # rows a side that are compared at once
CHUNKED = "label long, dim int, file string, offset long, rows int, cid long, k1 long, k2 long, n long, least long"


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _blocks(dim: int, count: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(count, dim) + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _radii(dim: int, count: int, cosine: float) -> list[tuple[int, int, float]]:
    """Blocks with their squared budget, in proportion to their width."""
    return [(lo, hi, (2 - 2 * cosine) * (hi - lo) / dim + 1e-9) for lo, hi in _blocks(dim, count)]


def _most(dim: int) -> int:
    """Rows of a chunk of vectors of so many components."""
    return min(UNIT, max(64, VALUES // dim))


def _written(folder: str, kind: str):
    """Writes the vectors of rows that come in order of label, dim and part; gives rows of CHUNKED."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.vectors"
        task, made, at, out, held, size, last = TaskContext.get().partitionId() << 40, 0, 0, None, [], 0, None

        def chunk():
            nonlocal made, at, out
            rows = pa.Table.from_batches(held)
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            number = rows.num_rows
            cid, n = task + made + np.arange(number, dtype=np.int64), rows.column("n").to_numpy()
            data = b"".join((cid.tobytes(), n.tobytes(), rows.column("embedding").combine_chunks().flatten().to_numpy().astype(kind).tobytes()))
            out.write(data)
            label, dim, _ = last
            same = [np.full(number, label), np.full(number, dim, np.int32), pa.array([name]).take(pa.array(np.zeros(number, np.int64))), np.full(number, at), np.full(number, number, np.int32)]
            made, at = made + number, at + len(data)
            own = [rows.column(c).combine_chunks() for c in ("k1", "k2", "n", "least")]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (*same, cid, *own)], names=names)

        try:
            for batch in batches:
                keys = [batch.column(c).to_numpy() for c in ("label", "dim", "part")]
                turns = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                for lo, hi in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                    now = tuple(int(k[lo]) for k in keys) if hi > lo else last
                    while lo < hi:
                        if held and (now != last or size >= _most(last[1])):
                            yield chunk()
                            held, size = [], 0
                        take = min(hi - lo, _most(now[1]) - size)
                        held.append(batch.slice(lo, take))
                        lo, size, last = lo + take, size + take, now
            if held:
                yield chunk()
        finally:
            if out is not None:
                out.close()

    names = [c.split()[0] for c in CHUNKED.split(", ")]
    return run


def _sides(x: np.ndarray, ranges: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block two matrices: the product of a left and a right row is minus the squared distance of their parts."""
    out = []
    for lo, hi, _ in ranges:
        part = x[:, lo:hi]
        norm, one = (part * part).sum(1, keepdims=True), np.ones((len(x), 1))
        out.append((np.hstack((2 * part, -norm, -one)).astype(np.float32), np.hstack((part, one, norm)).astype(np.float32)))
    return out


def _joined(folder: str, kind: str, cosine: float, blocks: int):
    """kind, a, b of units (dim and the places of two chunks): 0, a class, links that it has; 1, two classes that are linked."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        turned, known = {}, {}

        def chunk(file, offset, rows, dim):
            if (file, offset) not in known:
                if len(known) > 1:
                    known.pop(next(iter(known)))
                with store.open_input_file(f"{root}/{file}") as source:
                    data = source.read_at(rows * (16 + dim * np.dtype(kind).itemsize), offset)
                cid, n = np.frombuffer(data, np.int64, 2 * rows).reshape(2, rows)
                raw = np.frombuffer(data, kind, rows * dim, 16 * rows).reshape(rows, dim).astype(np.float64)
                if dim not in turned:
                    turned.clear()
                    turned[dim] = rotation(dim)
                norm = np.linalg.norm(raw, axis=1)
                x = raw / norm[:, None] @ turned[dim]
                known[file, offset] = (cid, n, raw, norm, x.astype(np.float32), _sides(x, _radii(dim, blocks, cosine)))
            return known[file, offset]

        def unit(dim, one, two):
            ranges, near = _radii(dim, blocks, cosine), 1e-5 + 1e-6 * dim  # near: above the errors of single precision
            first, second = chunk(*one, dim), chunk(*two, dim)
            links, edges = [np.zeros(len(first[0])), np.zeros(len(second[0]))], []
            for p in range(0, len(first[0]), TILE):
                for q in range(p if one == two else 0, len(second[0]), TILE):
                    a, b = slice(p, p + TILE), slice(q, q + TILE)
                    found = None
                    for (left, _), (_, right), (_, _, budget) in zip(first[5], second[5], ranges, strict=True):
                        within = left[a] @ right[b].T >= -budget - near
                        found = within if found is None else np.logical_or(found, within, out=found)
                    if one == two and p == q:
                        found = np.triu(found, 1)
                    i, j = np.divmod(np.flatnonzero(found), found.shape[1])
                    if not i.size:
                        continue
                    # in single precision most are beyond doubt; the others are told in double precision
                    c = (first[4][a] @ second[4][b].T)[i, j] if i.size > 4096 else np.full(i.size, cosine, np.float32)
                    i, j, yes, doubt = i + p, j + q, c >= cosine + near, np.abs(c - cosine) < 2 * near
                    for s in range(0, (at := np.flatnonzero(doubt)).size, 4096):
                        k = at[s : s + 4096]
                        yes[k] = np.einsum("ij,ij->i", first[2][i[k]], second[2][j[k]]) / (first[3][i[k]] * second[3][j[k]]) >= cosine
                    i, j = i[yes], j[yes]
                    if i.size:
                        links[0] += np.bincount(i, second[1][j], len(first[0]))
                        links[1] += np.bincount(j, first[1][i], len(second[0]))
                        edges.append(forest(first[0][i], second[0][j]))
            if not edges:
                return None
            cid, more = np.concatenate((first[0], second[0])), np.concatenate(links).astype(np.int64)
            a, b = forest(*map(np.concatenate, zip(*edges, strict=True)))
            some = np.flatnonzero(more)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), (some.size, a.size))), pa.array(np.concatenate((cid[some], a))), pa.array(np.concatenate((more[some], b)))], names=["kind", "a", "b"])

        for batch in batches:
            for dim, *places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (made := unit(dim, tuple(places[:3]), tuple(places[3:]))) is not None:
                    yield made

    return run


def near_dedup(vectors: DataFrame, cosine: float = 0.93, blocks: int = 4) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    sound = (F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))) & F.exists("embedding", lambda x: x != 0)
    sound = sound & F.col("vec_id").isNotNull()
    # two hashes stand for a label and a vector
    keys = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64("embedding", "label").alias("k2")]
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"), sound.alias("sound"))
    good = rows.where("sound").select("vec_id", "label", "embedding")
    kind = "float32" if dict(vectors.dtypes)["embedding"] == "array<float>" else "float64"
    # how many parts a label's classes are dealt into; few labels have more than one
    most = F.least(F.lit(UNIT), F.greatest(F.lit(64), F.floor(F.lit(VALUES) / F.col("dim")))) * 3 / 4
    sizes = good.select("label", F.size("embedding").alias("dim"), *keys).distinct().groupBy("label", "dim").agg(F.count("*").alias("m"))
    large = materialize(sizes.where(F.col("m") > most).select("label", "dim", F.ceil(F.col("m") / most).cast("long").alias("parts")), "sizes")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).select("*", *keys).withColumn("dim", F.size("embedding"))
    dealt = classes.join(F.broadcast(large), ["label", "dim"], "left").withColumn("part", F.coalesce(F.pmod("k2", "parts"), F.lit(0).cast("long"))).drop("parts")
    dealt = dealt.repartition(partitions(spark), "label", "dim", "part").sortWithinPartitions("label", "dim", "part")
    folder = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    written = materialize(dealt.withColumn("least", F.col("least").cast("long")).mapInArrow(_written(folder, kind), CHUNKED), "classes")
    places = ["file", "offset", "rows"]
    index = materialize(written.select("label", "dim", *places).distinct(), "index")
    other = index.select("label", "dim", *[F.col(c).alias(f"{c}_2") for c in places])
    units = index.join(other, ["label", "dim"]).where("struct(file, offset) <= struct(file_2, offset_2)").select("dim", *places, *[f"{c}_2" for c in places])
    found = materialize(units.repartition(partitions(spark)).mapInArrow(_joined(folder, kind, cosine, blocks), "kind int, a long, b long"), "links")
    _removed(spark, folder)
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("more"))
    label = materialize(components(found.where("kind = 1").select("a", "b")).select(F.col("node").alias("cid"), F.col("label").alias("part")), "parts")
    lowest = label.join(written.select("cid", "least"), "cid").groupBy("part").agg(F.min("least").alias("root"))
    roots = label.join(materialize(lowest, "lowest"), "part").select("cid", "root")
    named = written.join(links, "cid", "left").join(roots, "cid", "left")
    named = named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "least").alias("root"))
    out = rows.select("vec_id", *[F.when(F.col("sound"), k).alias(c) for c, k in zip(("k1", "k2"), keys, strict=True)]).join(named, ["k1", "k2"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"))


def _removed(spark: SparkSession, folder: str) -> None:
    """Removes chunks that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))
