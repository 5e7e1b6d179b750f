"""Operator 9: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace) resolves a pre-token that is a
token as a whole. Tier two: misses go through merges by rank, with a heap over a linked list of bytes.
Resolved pre-tokens are remembered per worker, up to ``REMEMBER`` entries.

Null text counts as empty: no ids. A very long text is read whole, one at a time; a pre-token of any
length goes through the heap in n log n steps. Among pairs of equal rank the leftmost merges first.
Decoding gives back the bytes. Repeated rows get equal results, extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
import zlib
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches, table

REMEMBER = 1_000_000  # pre-tokens that a worker keeps


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def perfect_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each bucket, and the key index in each slot; as many slots as keys."""
    import xxhash

    n = len(keys)
    buckets = max(1, n // 3)
    hashed = [xxhash.xxh3_64_intdigest(k) for k in keys]
    inside: list[list[int]] = [[] for _ in range(buckets)]
    for i, h in enumerate(hashed):
        inside[h % buckets].append(i)
    shift, slots = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
    free = set(range(n))
    for b in sorted(range(buckets), key=lambda b: -len(inside[b])):
        own = inside[b]
        if not own:
            break
        if len(own) == 1:
            at = free.pop()
            shift[b], slots[at] = -at - 1, own[0]  # a lone key names its slot
            continue
        d = 1
        while True:
            at = [slot(hashed[i], d, n) for i in own]
            if len(set(at)) == len(at) and all(slots[a] < 0 for a in at):
                break
            d += 1
        shift[b] = d
        for a, i in zip(at, own, strict=True):
            slots[a] = i
            free.discard(a)
    return shift, slots


def slot(h: int, d: int, n: int) -> int:
    return ((h >> 20) * (2 * d + 1) + d * 0x9E3779B1 >> 3) % n


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges of the lowest rank first, the leftmost among equal ones.

    A heap entry is rank * n + place; it is stale if the pair that starts at the place has another rank by now.
    """
    n, get, push, pop = len(piece), ranks.get, heapq.heappush, heapq.heappop
    pair = [get(piece[i : i + 2], -1) for i in range(n)]
    pair[-1] = -1
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i = divmod(pop(heap), n)
        if pair[i] != r:
            continue
        j = after[i]
        after[i] = k = after[j]
        pair[j] = pair[i] = -1
        if k < n:
            before[k] = i
            if (r := get(piece[i : after[k]], -1)) >= 0:
                pair[i] = r
                push(heap, r * n + i)
        h = before[i]
        if h >= 0:
            pair[h] = r = get(piece[h:k], -1)
            if r >= 0:
                push(heap, r * n + h)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Tokens(dict):
    """Pre-token to the bytes of its 32-bit ids. A pre-token that is not yet known goes through both tiers."""

    def __init__(self, ranks: dict[bytes, int], shift: np.ndarray, slots: np.ndarray):
        import xxhash

        self.ranks, self.shift, self.digest = ranks, shift.tolist(), xxhash.xxh3_64_intdigest
        self.keys = list(ranks)
        self.slots = slots.tolist()
        self.ids = list(ranks.values())

    def whole(self, piece: bytes) -> int | None:
        h = self.digest(piece)
        d, n = self.shift[h % len(self.shift)], len(self.slots)
        i = self.slots[-d - 1 if d < 0 else slot(h, d, n)]
        return self.ids[i] if self.keys[i] == piece else None

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        one = self.whole(piece)
        out = array("i", (one,) if one is not None else merge(piece, self.ranks)).tobytes()
        if len(self) >= REMEMBER:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out


def text_ids(text: str, tokens: Tokens, split) -> np.ndarray:
    """Encodes one text."""
    return np.frombuffer(b"".join(map(tokens.__getitem__, split(text))), np.int32)


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


def ids_bytes(ids: list[int], pieces: list[bytes]) -> bytes:
    """Decodes one list of ids."""
    return b"".join(map(pieces.__getitem__, ids))


def _kept(name: str, make):
    """One value a worker process, whatever the number of its tasks."""
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


class Codec:
    """A vocabulary and its pattern, shared with the tasks once; a worker builds its lookup once."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        shared = spark.sparkContext.broadcast((ranks, *perfect_hash(list(ranks))))  # the vocabulary: a fixed size
        name = f"tokens{zlib.crc32(repr((pattern, sorted(ranks.items()))).encode())}"  # which vocabulary a worker remembers

        def tools():
            import regex

            tokens = _kept(name, lambda: Tokens(*shared.value))
            return tokens, regex.compile(pattern).findall, _kept(name + "pieces", lambda: pieces_of(tokens.ranks))

        self.tools = tools


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` with the token ids of the text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tools = Codec(docs.sparkSession, ranks, pattern).tools

    def run(batches):
        tokens, split, _ = tools()
        for batch in batches:
            flat = [text_ids(text, tokens, split) if text else np.zeros(0, np.int32) for text in batch.column("text").to_pylist()]
            off = np.cumsum([0, *[ids.size for ids in flat]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), ids], names=[id_col, "ids"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces_of(ranks))

    def run(batches):
        pieces = shared.value
        for batch in batches:
            out = [ids_bytes(ids or (), pieces) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode`` and ``decode`` in one pass, so that ids don't travel."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tools = Codec(docs.sparkSession, ranks, pattern).tools

    def run(batches):
        tokens, split, pieces = tools()
        decimal = [str(i) for i in range(len(pieces))]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = text_ids(text, tokens, split).tolist() if text else []
                line = ",".join(map(decimal.__getitem__, ids)).encode()
                rows.append((len(ids), sha256(line).hexdigest(), sha256(ids_bytes(ids, pieces)).hexdigest()))
            n, one, two = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
