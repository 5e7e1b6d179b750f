"""Operator 4: language ID by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each keeps its maximum over a window of 256
bytes, and a softmax layer gives language probabilities. The network is trained in numpy on the driver, on a
bounded sample of labelled rows (``SAMPLE`` rows, ``PIECES`` windows each; a parameter). Prediction reads every
window of every text and averages the probabilities, weighted by the letters of the window.

A text that is null or has no letters is ``und`` with score 0. A null doc_id counts as held out. Without any
labelled row every text is ``und``. Repeated rows get equal results, extra columns are ignored, an empty table
gives an empty result. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numtext import chunks, flat
from .shared import small_batches, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBED = 8
SAMPLE = 4000
PIECES = 3
EPOCHS = 6
PAD = 256

LETTER = np.zeros(256, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def sample(docs: DataFrame, rows: int) -> list[tuple[str, str]]:
    """At most ``rows`` labelled texts that are not held out, as windows, dealt by a hash of the text."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = known.count()
    share = min(1.0, 1.2 * rows / max(1, total))
    part = known.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    room = F.greatest(F.length("text") - WINDOW, F.lit(1))
    at = [1 + F.pmod(F.xxhash64("text", F.lit(k)), room) for k in range(PIECES)]
    cut = [F.substring(F.col("text"), a.cast("int"), F.lit(WINDOW)) for a in at]
    # the first by hash, each text once a language: the same rows whatever the files and partitions are
    drawn = part.select("lang", F.array_distinct(F.array(*cut)).alias("cuts"), F.xxhash64("text", F.lit(7)).alias("h")).dropDuplicates(["h", "lang"])
    found = drawn.orderBy("h", "lang").limit(rows).collect()
    return [(r["lang"], cut) for r in found for cut in r["cuts"] if cut]


def _ids(texts: list[bytes]) -> np.ndarray:
    reach = WINDOW + max(WIDTHS) - 1
    out = np.full((len(texts), reach), PAD, np.int64)
    for k, t in enumerate(texts):
        raw = np.frombuffer(t[:WINDOW], np.uint8)
        out[k, : raw.size] = raw
    return out


class Net:
    """Weights as arrays. All filters are stored as wide as the widest, with zeros beyond their width."""

    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.wide = langs, max(WIDTHS)
        count = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.mask = np.zeros((self.wide, EMBED, count), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(-1, count)
        self.conv = (rng.normal(0, 0.3, (self.wide * EMBED, count)).astype(np.float32)) * self.mask
        self.bias = np.zeros(count, np.float32)
        self.out = rng.normal(0, 0.1, (count, len(langs))).astype(np.float32)
        self.base = np.zeros(len(langs), np.float32)

    def patches(self, ids: np.ndarray) -> np.ndarray:
        e = self.embed[ids]
        view = np.lib.stride_tricks.sliding_window_view(e, self.wide, axis=1)  # rows, window, embed, wide
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(ids), WINDOW, -1)

    def pooled(self, patches: np.ndarray) -> np.ndarray:
        return (patches.reshape(-1, patches.shape[2]) @ self.conv).reshape(len(patches), WINDOW, -1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.base
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, ids: np.ndarray) -> np.ndarray:
        return self.probabilities(self.pooled(self.patches(ids)).max(1))

    def train(self, ids: np.ndarray, target: np.ndarray, epochs: int, rate: float = 0.004, batch: int = 64) -> None:
        rng = np.random.default_rng(3)
        names = ("embed", "conv", "bias", "out", "base")
        first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                x = self.patches(ids[at])
                raw = self.pooled(x)
                arg = raw.argmax(1)  # rows, filters
                peak = np.take_along_axis(raw, arg[:, None], 1)[:, 0]
                hidden = np.maximum(peak + self.bias, 0)
                p = self.probabilities(peak)
                p[np.arange(len(at)), target[at]] -= 1
                p /= len(at)
                back = (p @ self.out.T) * (hidden > 0)
                best = np.take_along_axis(x, arg[:, :, None], 1)  # rows, filters, patch
                grad = {"out": hidden.T @ p, "base": p.sum(0), "bias": back.sum(0), "conv": np.einsum("rfp,rf->pf", best, back) * self.mask}
                into = (back[:, :, None] * self.conv.T[None]).reshape(len(at), -1, self.wide, EMBED)
                which = ids[at][np.arange(len(at))[:, None, None], arg[:, :, None] + np.arange(self.wide)]
                grad["embed"] = np.zeros_like(self.embed)
                np.add.at(grad["embed"], which.reshape(-1), into.reshape(-1, EMBED))
                grad["embed"][PAD] = 0
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grad[n]
                    second[n] = 0.99 * second[n] + 0.01 * grad[n] ** 2
                    move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - move).astype(np.float32))


def fit(docs: DataFrame, rows: int = SAMPLE, epochs: int = EPOCHS) -> Net | None:
    taught = sorted(sample(docs, rows))
    if not taught:
        return None
    langs = sorted({lang for lang, _ in taught})
    net = Net(langs)
    net.train(_ids([text.encode() for _, text in taught]), np.array([langs.index(lang) for lang, _ in taught]), epochs)
    return net


def _has_letter(raw: np.ndarray) -> bool:
    return bool(LETTER[raw[raw < 128]].any()) or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def identify(docs: DataFrame, net: Net | None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    if net is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        reach = np.arange(WINDOW + net.wide - 1)
        for batch in batches:
            data, off = flat(batch.column("text"))
            n = batch.num_rows
            total, weight = np.zeros((n, len(net.langs))), np.zeros(n)
            for i, j in chunks(off, 1 << 15):
                size = np.diff(off[i : j + 1])
                count = -(-size // WINDOW)
                row = np.repeat(np.arange(i, j), count)
                start = off[row] + WINDOW * (np.arange(row.size) - np.repeat(np.cumsum(count) - count, count))
                for lo in range(0, row.size, 128):
                    r, s = row[lo : lo + 128], start[lo : lo + 128]
                    at = s[:, None] + reach
                    inside = at < off[r + 1][:, None]
                    ids = np.where(inside, data[np.minimum(at, data.size - 1)].astype(np.int64), PAD)
                    letters = np.where(inside[:, :WINDOW], LETTER[ids[:, :WINDOW] & 255], 0).sum(1)
                    np.add.at(total, r, net.predict(ids) * letters[:, None])
                    np.add.at(weight, r, letters)
            best = total.argmax(1)
            lang, score = [], []
            for k in range(n):
                if weight[k] > 0 and _has_letter(data[off[k] : off[k + 1]]):
                    lang.append(net.langs[best[k]])
                    score.append(min(1.0, float(total[k, best[k]] / weight[k])))
                else:
                    lang.append("und")
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
