"""Operator 11: ranked lexical search by the Best Position Algorithm over impact lists.

Two passes over the documents. The first counts what weights need: documents, terms and, for the terms of the queries,
the documents that hold them. In the second each task cuts its documents into chunks and builds the chunk's impact lists:
for each query term, the documents in descending order of impact. A query reads its lists side by side, some positions at
a time. Each document met is looked up in all of the query's lists at once (direct access), so its whole score is known
and its place in every list counts as seen. The best position of a list is the last one before its first unseen place;
no unseen document can score more than the sum of the impacts that follow the best positions. A query stops when that sum
is strictly below its k-th score: a document that ties with it may still win by its doc_id. The k-th score is carried
from chunk to chunk of a task. Tasks yield k rows a query, and a window over these rows picks the last k.

Queries are taken in blocks (``block``), each with its own two passes, so the broadcast terms of a block are bounded
however many queries there are. Memory in a task is bounded by ``chunk`` bytes of text (or one longer text).

Rows are documents: rows that share a doc_id are ranked one by one. Null texts and texts without a term are not counted
and not found. Equal scores go by ascending doc_id, null last. A query without terms, or a null one, has no rows; rows of
queries that repeat are answered each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import small_batches, table

# ASCII letters and digits and everything beyond ASCII make terms; only A to Z change case
_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP else 0x20 for b in range(256))
STEP = 32  # positions of a list read at first; each round reads twice as many


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all documents, and for each word of the vocabulary the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        held, n, length = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms_of(text)
                if found:
                    n, length = n + 1, length + len(found)
                    held[[known[t] for t in set(found) if t in known]] += 1
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at], pa.int64()), pa.array([n, length, *held[at]], pa.int64())], names=["term", "n"])

    df = np.zeros(len(vocabulary), np.int64)
    total = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most a row a term of the block
    for term, n in total.items():
        if term >= 0:
            df[term] = n
    return total.get(-1, 0), total.get(-2, 0), df


class Chunk:
    """Impact lists of some documents, with direct access by (term, document)."""

    def __init__(self, found: list[list[bytes]], known: dict[bytes, int], n_docs: int, n_terms: int):
        self.size = len(found)
        term, doc, tf, m = [], [], [], np.empty(self.size, np.int64)
        for d, words in enumerate(found):
            m[d] = 100 - 75 + (75 * len(words) * n_docs) // n_terms
            for t, n in Counter(words).items():
                at = known.get(t)
                if at is not None:
                    term.append(at)
                    doc.append(d)
                    tf.append(n)
        term, doc, tf = (np.array(x, np.int64) for x in (term, doc, tf))
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(known) + 1))
        key = term[order] * self.size + self.doc
        self.by_key = np.argsort(key)
        self.key = key[self.by_key]

    def places(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Row of each (term, document) in the lists, -1 where the document lacks the term."""
        want = (terms[:, None] * self.size + docs[None, :]).ravel()
        at = np.searchsorted(self.key, want)
        at[at == self.key.size] = 0
        rows = np.where(self.key[at] == want, self.by_key[at], -1) if self.key.size else np.full(want.size, -1)
        return rows.reshape(terms.size, docs.size)


def best_positions(chunk: Chunk, terms: np.ndarray, weights: np.ndarray, k: int, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the chunk and their scores, the k best and their ties among them. ``carried``: the k-th score of the
    chunks before, or 0."""
    starts, ends = chunk.starts[terms], chunk.starts[terms + 1]
    use = ends > starts
    terms, weights, starts, ends = terms[use], weights[use], starts[use], ends[use]
    if not terms.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    base = np.concatenate([[0], np.cumsum(ends - starts)])  # the lists' places in one array of flags
    seen, met = np.zeros(base[-1], bool), np.zeros(chunk.size, bool)
    read, best, step = starts.copy(), starts.copy(), STEP
    docs, scores = [], []
    kth, tops = carried, np.empty(0, np.int64)
    while True:
        upto = np.minimum(read + step, ends)
        new = np.unique(np.concatenate([chunk.doc[a:b] for a, b in zip(read, upto, strict=True)]))
        new = new[~met[new]]
        read, step = upto, step * 2
        if new.size:
            met[new] = True
            rows = chunk.places(terms, new)
            hit = rows >= 0
            score = (np.where(hit, chunk.impact[rows], 0) * weights[:, None]).sum(axis=0)
            seen[(rows - starts[:, None] + base[:-1, None])[hit]] = True
            docs.append(new)
            scores.append(score)
            tops = np.concatenate([tops, score])
            if tops.size >= k:
                tops = np.partition(tops, tops.size - k)[tops.size - k :]
                kth = max(carried, int(tops[0]))
        bound = 0
        for i in range(terms.size):
            left = seen[base[i] + best[i] - starts[i] : base[i + 1]]
            gap = int(left.argmin()) if left.size else 0
            best[i] += left.size if left.size and left[gap] else gap
            if best[i] < ends[i]:
                bound += int(weights[i]) * int(chunk.impact[best[i]])
        if bound < kth or (read == ends).all():
            return np.concatenate(docs), np.concatenate(scores)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = 2000, chunk: int = 32 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of each item."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    spans = items.select("item_id", "text").where("text is not null").collect()  # the stated queries, in blocks below
    parts = [_block(docs, spans[i : i + block], i, k, chunk) for i in range(0, len(spans), block)]
    kinds = {"item": items.schema["item_id"].dataType.simpleString(), "doc": docs.schema["doc_id"].dataType.simpleString()}
    schema = f"item_id {kinds['item']}, rank int, doc_id {kinds['doc']}, score long"
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(spans)], f"query int, item_id {kinds['item']}")
    return top.join(names, "query").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, rows: list, first: int, k: int, limit: int) -> DataFrame | None:
    asked = [Counter(terms_of(r["text"])) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))} if asked else {}
    if not vocabulary:
        return None
    n_docs, n_terms, df = statistics(docs, vocabulary)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df]
    lists = []
    for i, terms in enumerate(asked):
        at = [(vocabulary[t], n * weight[vocabulary[t]]) for t, n in terms.items() if weight[vocabulary[t]] > 0]
        if at:
            lists.append((first + i, np.array([a for a, _ in at], np.int64), np.array([w for _, w in at], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, lists))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, queries = shared.value
        best = {q: [] for q, _, _ in queries}  # (-score, doc_id is null, doc_id)

        def rank(ids, found):
            part = Chunk(found, known, n_docs, n_terms)
            for q, terms, weights in queries:
                have = best[q]
                got, score = best_positions(part, terms, weights, k, -have[-1][0] if len(have) == k else 0)
                floor = max(1, -have[-1][0] if len(have) == k else 1)
                if score.size > k:
                    floor = max(floor, int(np.partition(score, score.size - k)[score.size - k]))
                use = score >= floor
                have += [(-s, ids[d] is None, ids[d]) for d, s in zip(got[use].tolist(), score[use].tolist(), strict=True)]
                have.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
                del have[k:]

        ids, found, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    ids.append(i)
                    found.append(words)
                    size += len(text)
                    if size >= limit:
                        rank(ids, found)
                        ids, found, size = [], [], 0
        if ids:
            rank(ids, found)
        out = [(q, r[2], -r[0]) for q, have in best.items() for r in have]
        q, d, s = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, id_type), pa.array(s, pa.int64())], names=["query", "doc_id", "score"])

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, f"query int, doc_id {kind}, score long")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
