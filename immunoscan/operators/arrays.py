"""Rows and arrays that are worked out with numpy from a sequence's letters, one sequence after the other.

``exploded`` and ``extended`` run a function of the sequence over the Arrow batches of a table; Spark deals the table out and takes the rows
on. What leaves a task at once is bounded in rows, whatever the lengths of the sequences. Spark's own array functions are interpreted, value by
value; these jobs spend some ten operations on each letter, so they would cost some microseconds a letter there.
"""

from __future__ import annotations

import sys
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dims import AA

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BLOCK = 1 << 17  # rows (or values of arrays) after which a batch leaves the task
PART, GROUP = 512, 1 << 20  # rows of a part of a sequence (a multiple of 8), and letters of the sequences whose parts are put together
PLACES = np.zeros(256, np.int64)
PLACES[[ord(a) for a in AA]] = np.arange(1, len(AA) + 1)


def codes_of(seq: str) -> np.ndarray:
    """Places of the letters in AA from 1, 0 for others."""
    return PLACES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def letters_of(seq: str) -> pa.Array:
    if not seq.isascii():
        return pa.array(list(seq), pa.string())
    return pa.StringArray.from_buffers(len(seq), pa.py_buffer(np.arange(len(seq) + 1, dtype=np.int32)), pa.py_buffer(seq.encode()))


def pieces_of(seq: str, starts: np.ndarray, size: int) -> pa.Array:
    """The parts of so many letters at these places from 0."""
    if not seq.isascii():
        return pa.array([seq[s : s + size] for s in starts], pa.string())
    text = np.frombuffer(seq.encode(), np.uint8)
    body = np.lib.stride_tricks.sliding_window_view(text, size)[starts] if len(starts) else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.arange(len(starts) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(body)))


def sums_of(values: np.ndarray, width: int) -> np.ndarray:
    """Sums of whole numbers over each full window."""
    if len(values) < width:
        return values[:0]
    added = np.concatenate(([0], np.cumsum(values)))
    return added[width:] - added[:-width]


def window_sums(codes: np.ndarray, matrix: list[list[int]]) -> np.ndarray:
    """The score of each window of letter codes by a matrix of places, in thousandths."""
    size = max(0, len(codes) - len(matrix) + 1)
    out = np.zeros(size, np.int64)
    for p, table in enumerate(matrix):
        if any(table):
            out += np.asarray(table, np.int64)[codes[p : p + size]]
    return out


def half_up(over: np.ndarray, under) -> np.ndarray:
    """Quotients of whole numbers, ties away from zero."""
    return np.sign(over) * ((2 * np.abs(over) + under) // (2 * under))


def rounded(values: np.ndarray, digits: int = 6) -> np.ndarray:
    """Doubles to some digits as Spark rounds them: by their shortest decimal form, ties away from zero."""
    scaled = np.abs(values) * 10.0**digits
    low = np.floor(scaled)
    out = (low + (scaled - low >= 0.5)) / 10.0**digits
    out = np.where(values < 0, 0.0 - out, out)
    for i in np.flatnonzero(np.abs(scaled - low - 0.5) < 1e-6 + 1e-15 * scaled):  # so near a tie the product itself may be rounded
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0


def spans_of(flags: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First and last places, from 0, of the maximal runs of true flags of at least this length."""
    turns = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    first, last = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - 1
    long = last - first + 1 >= least
    return first[long], last[long]


def _column(parts: list, kind: pa.DataType) -> pa.Array:
    if isinstance(parts[0], pa.Array):
        return pa.concat_arrays(parts)
    if isinstance(parts[0], list):
        return pa.array([x for p in parts for x in p], kind)
    whole = np.concatenate(parts)
    return pa.array(whole, kind, mask=np.isnan(whole) if pa.types.is_floating(kind) else None)


def _schema(df: DataFrame, keep: list[str], fields: str) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(fields).fields)
    return schema, to_arrow_schema(schema)


def _sent(kept: pa.RecordBatch, rows: list[int], sizes: list[int] | None, columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    at = pa.array(np.asarray(rows, np.int64) if sizes is None else np.repeat(rows, sizes))
    return pa.RecordBatch.from_arrays([*(kept.column(i).take(at).cast(schema.field(i).type) for i in range(kept.num_columns)), *columns], schema=schema)


def exploded(seqs: DataFrame, keep: list[str], fields: str, rows, then=None, gives: str | None = None, given: list[str] = []) -> DataFrame:  # noqa: B006
    """The columns to keep and ``fields``: what ``rows`` makes of each sequence of at least one letter, and of the sequence's values of the columns
    ``given``, an array a field, a value a row. NaN is null. Rows keep no order across sequences. ``then`` takes the batches of rows on within the task
    and makes batches of ``gives``."""
    schema, arrow = _schema(seqs, keep, fields)
    kinds = [f.type for f in arrow][len(keep) :]

    def run(batches):
        for batch in batches:
            kept, at, sizes, parts = batch.select(range(len(keep))), [], [], []
            more = [c.to_pylist() for c in batch.columns[len(keep) : -1]]
            flush = lambda: _sent(kept, at, sizes, [_column([p[i] for p in parts], kind) for i, kind in enumerate(kinds)], arrow)  # noqa: B023, E731
            for i, seq in enumerate(batch.column(batch.num_columns - 1)):
                made = rows(seq.as_py(), *(c[i] for c in more))
                if len(made[0]):
                    at.append(i), sizes.append(len(made[0])), parts.append(made)
                if sum(sizes[-1:]) >= BLOCK or len(at) % 64 == 0 and sum(sizes) >= BLOCK:
                    yield flush()
                    at, sizes, parts = [], [], []
            if at:
                yield flush()

    texts = seqs.where("n > 0").select(*keep, *[F.col(c).alias(f"given_{i}") for i, c in enumerate(given)], F.col("seq").alias("seq_"))
    return texts.mapInArrow(run, schema) if then is None else texts.mapInArrow(lambda batches: then(run(batches)), gives)


def parted(seqs: DataFrame, keep: list[str], fields: str, makes: list, by: int | None = None) -> DataFrame:
    """The columns to keep and ``fields``: the rows of each of ``makes``, one after the other; of a sequence each makes an array a field, or one text for all rows.
    NaN is null.

    Rows come in an order in which Spark's files take least: sequences of a batch by length, then text, and of those of a group the first PART rows, then the next.
    So columns that count places, and all columns of equal sequences, repeat within a few thousand rows. Files pack values in eights, so what is left of a sequence
    beyond a multiple of 8 rows comes at the end of its group; a repeat in another phase would not be one. With ``by`` the rows of a group come in order of that
    field: where wide columns follow from one number, its equal values stand together then, which saves more than the places cost."""
    schema, arrow = _schema(seqs, keep, fields)
    kinds = [f.type for f in arrow][len(keep) :]

    def cut(sizes):
        """Sequence, first and last row of the parts of a group."""
        for lo in range(0, max(sizes, default=0), PART):
            for i, n in enumerate(sizes):
                if lo < n // 8 * 8:
                    yield i, lo, min(lo + PART, n // 8 * 8)
        for i, n in enumerate(sizes):
            if n % 8:
                yield i, n // 8 * 8, n

    def column(made, parts, f, kind):
        if isinstance(made[0][f], str):
            return pa.repeat(made[0][f], sum(hi - lo for _, lo, hi in parts))
        return _column([made[i][f][lo:hi] for i, lo, hi in parts], kind)

    def run(batches):
        for batch in batches:
            kept, texts = batch.select(range(len(keep))), batch.column(batch.num_columns - 1).to_pylist()
            groups, most = [], GROUP if by is None else 4 * GROUP
            size = most
            for i in sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i])):  # noqa: B023
                if size + len(texts[i]) > most:
                    groups.append([])
                    size = 0
                groups[-1].append(i)
                size += len(texts[i])
            for make in makes:
                for group in groups:
                    made, parts, size = [make(texts[i]) for i in group], [], 0
                    if by is not None:
                        whole = [np.concatenate(x) for x in zip(*made, strict=True)]
                        order, owner = np.argsort(whole[by], kind="stable"), np.repeat(group, [len(m[by]) for m in made])
                        for lo in range(0, len(order), BLOCK):
                            at = order[lo : lo + BLOCK]
                            yield _sent(kept, owner[at], None, [_column([x[at]], kind) for x, kind in zip(whole, kinds, strict=True)], arrow)
                        continue
                    all_parts = list(cut([max(len(x) for x in m if not isinstance(x, str)) for m in made]))
                    for k, part in enumerate(all_parts, 1):
                        parts.append(part)
                        size += part[2] - part[1]
                        if size >= BLOCK or k == len(all_parts):
                            yield _sent(kept, [group[i] for i, _, _ in parts], [hi - lo for _, lo, hi in parts], [column(made, parts, f, kind) for f, kind in enumerate(kinds)], arrow)
                            parts, size = [], 0

    return seqs.where("n > 0").select(*keep, F.col("seq").alias("seq_")).mapInArrow(run, schema)


def extended(seqs: DataFrame, fields: str, made) -> DataFrame:
    """``seqs``, those of at least one letter, with ``fields``: for each sequence ``made`` gives a value or an array a field. An array of structs
    is given as one array a member."""
    schema, arrow = _schema(seqs, seqs.columns, fields)
    kinds = [f.type for f in arrow][len(seqs.columns) :]

    def column(parts, kind):
        if not pa.types.is_list(kind):
            return pa.array(parts, kind)
        inner, sizes = kind.value_type, [len(p[0] if isinstance(p, tuple) else p) for p in parts]
        if pa.types.is_struct(inner):
            values = pa.StructArray.from_arrays([_column([p[j] for p in parts], inner.field(j).type) for j in range(inner.num_fields)], fields=[inner.field(j) for j in range(inner.num_fields)])
        else:
            values = _column(parts, inner)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values).cast(kind)

    def run(batches):
        for batch in batches:
            kept, at, parts, size = batch.select(range(batch.num_columns - 1)), [], [], 0
            flush = lambda: _sent(kept, at, None, [column([p[i] for p in parts], kind) for i, kind in enumerate(kinds)], arrow)  # noqa: B023, E731
            for i, seq in enumerate(batch.column(batch.num_columns - 1)):
                text = seq.as_py()
                at.append(i), parts.append(made(text))
                size += len(text)
                if size >= BLOCK:
                    yield flush()
                    at, parts, size = [], [], 0
            if at:
                yield flush()

    return seqs.where("n > 0").select(*seqs.columns, F.col("seq").alias("seq_")).mapInArrow(run, schema)
