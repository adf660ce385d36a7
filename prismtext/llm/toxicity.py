"""Toxicity scoring with subword-bag embeddings and a linear softmax.

Every character n-gram of a word (three to five bytes, with word boundaries)
has an embedding, found by hash. The embeddings of a window of ``WINDOW`` words
(one by default) are averaged and a linear softmax over the average gives the
window's probability; a text's score is that of its worst window, so a few
toxic words count in a long text as in a short one. Embeddings and softmax are trained jointly in
numpy; n-grams are dropped at random in training, so that each carries meaning
by itself and a misspelling never seen is scored by the n-grams it shares.

Training reads a bounded, documented sample: about ``per_class`` labelled
texts of each class, chosen by a hash of the id, each read whole. Scoring
covers all rows. As the softmax is linear in the average, the table shipped to
the executors has one number for each n-gram bucket, of fixed size.

Defined results: a null or empty text scores as the bias of the softmax alone
(at most 0.05); without labelled rows of both classes every score is 0; equal
texts score equally; labels, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, pieces, utf8, word_hashes, words

BUCKETS, DIM = 1 << 18, 8
ORDERS = (3, 4, 5)
WINDOW = 1


def _ngrams(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word with a boundary byte at both ends, and each one's word."""
    size = ends - begins + 2
    start = np.concatenate([[0], np.cumsum(size)])
    text = np.full(int(start[-1]), 2, np.uint32)  # byte 2 marks a boundary
    place = np.arange(int((ends - begins).sum())) + np.repeat(begins - np.concatenate([[0], np.cumsum(ends - begins)])[:-1], ends - begins)
    text[np.arange(len(place)) + np.repeat(np.arange(len(begins)) * 2 + 1, ends - begins)] = raw[place]
    owner = np.repeat(np.arange(len(begins)), size)
    ids, whose = [], []
    acc = text * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        m = len(text) - n + 1
        if m <= 0:
            break
        acc = (acc[:m] ^ text[n - 1 :]) * np.uint32(0x85EBCA6B)
        acc ^= acc >> np.uint32(13)
        if n in ORDERS:
            inside = owner[:m] == owner[n - 1 :]
            ids.append((acc[inside] >> np.uint32(14)).astype(np.int64))
            whose.append(owner[:m][inside])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(whose)


def _bag(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch as (n-gram ids, word of each id), the word of each place, words before each text."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    begins, ends, before = words(raw, offsets)
    _, first, back = np.unique(word_hashes(raw, begins, ends), return_index=True, return_inverse=True)
    ids, whose = _ngrams(raw, begins[first], ends[first])
    return ids, whose, back, before, np.bincount(whose, minlength=len(first)).astype(np.float64)


def _windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window and the number of windows before each text."""
    count = -(-np.diff(before) // WINDOW)
    at = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(count)), count)
    return before[:-1][owner] + (np.arange(at[-1]) - at[:-1][owner]) * WINDOW, at


class Softmax:
    """The trained model, folded to one number for each bucket and a bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), bias

    def score(self, column: pa.Array) -> np.ndarray:
        ids, whose, back, before, count = _bag(column)
        out = np.full(len(column), min(self.bias, -3.0))
        if len(back):
            value = np.bincount(whose, self.table[ids], len(count))
            start, at = _windows(before)
            total, seen = np.add.reduceat(value[back], start), np.add.reduceat(count[back], start)
            logit = total / np.maximum(seen, 1) + self.bias
            some = np.diff(at) > 0
            out[some] = np.maximum.reduceat(logit, at[:-1][some])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[str], toxic: np.ndarray, epochs: int = 48, keep: float = 0.5, seed: int = 7) -> Softmax:
    """Fit embeddings and softmax jointly by Adam; a text is led by its worst windows.

    As the softmax is linear in the average, each n-gram's part in the gradient
    is one number: the embeddings' gradient is its outer product with the
    softmax vector, and the softmax vector's gradient its product with the
    embeddings.
    """
    rng = np.random.default_rng(seed)
    ids, whose, back, before, _ = _bag(pa.array(texts, pa.large_string()))
    start, at = _windows(before)
    some = np.diff(at) > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    target = toxic.astype(np.float64)[owner]
    # A class weighs as the root of its size: between each text alike and each class alike.
    per_text = np.where(toxic > 0, max(1, toxic.sum()), max(1, (1 - toxic).sum())) ** -0.5
    weight = (per_text / per_text.sum())[owner]
    used, ids = np.unique(ids, return_inverse=True)
    n_words = int(whose.max()) + 1
    window_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(back))))
    heads = at[:-1][some]
    row = np.repeat(np.arange(len(heads)), np.diff(at)[some])
    p = {"E": rng.normal(0, 0.1, (len(used), DIM)), "u": rng.normal(0, 0.5, DIM), "b": np.array(-2.0)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, epochs + 1):
        drop = rng.random(len(ids)) < keep
        value = np.bincount(whose, (p["E"] @ p["u"])[ids] * drop, n_words)
        count = np.bincount(whose, drop, n_words)
        seen = np.maximum(np.add.reduceat(count[back], start), 1)
        logit = np.clip(np.add.reduceat(value[back], start) / seen + p["b"], -30, 30)
        # A text's windows share its weight by their score, ever more sharply.
        sharp = min(4.0, 0.5 + t / 5)
        soft = np.exp(sharp * (logit - np.maximum.reduceat(logit, heads)[row]))
        share = soft / np.add.reduceat(soft, heads)[row]
        g = (1 / (1 + np.exp(-logit)) - target) * share * weight
        by_word = np.bincount(back, (g / seen)[window_of], n_words)
        by_id = np.bincount(ids, by_word[whose] * drop, len(used))
        grads = {"E": by_id[:, None] * p["u"][None] + 1e-7 * p["E"], "u": p["E"].T @ by_id + 1e-5 * p["u"], "b": g.sum()}
        for k, grad in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            p[k] = p[k] - 0.08 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    table = np.zeros(BUCKETS)
    table[used] = p["E"] @ p["u"]
    return Softmax(table, float(p["b"]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Softmax | None:
    """Fit on about ``per_class`` texts of each class. ``labels`` has doc_id and toxic (0, 1 or null)."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    chosen = known.where(place < share)
    # The sample's size is bounded by per_class, so its ids may be broadcast.
    got = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").collect()
    got.sort(key=lambda r: (r["toxic"], r["text"]))
    toxic = np.array([r["toxic"] for r in got])
    if not len(got) or toxic.min() == toxic.max():
        return None
    return train([r["text"] for r in got], toxic)


def score(docs: DataFrame, model: Softmax | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and a score from 0 to 1 for every row."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 1 << 20):
            s = shared.value.score(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, f"{fields}score double")


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learn = labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), learn)
    return score(rows, model, ["doc_id", "held_out"]).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
