"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed runs of 3, 4 and 5 characters that it holds (lower case, with a blank at
both ends). From labelled texts: each feature's ratio r of smoothed shares among toxic and other texts, then
logistic regression over features of value r. Scoring multiplies both into one weight a feature, so that a
whole text of any length is scored by one table of fixed size.

The fit takes labelled rows of least id hash, at most FIT_ROWS, of at most FIT_CHARS code points each and
FIT_FEATURES features together; it runs in one task of that bounded size. Scores cover all rows.

Defined results: null text counts as empty and scores by the intercept; rows of a doc_id with several labels
train as toxic if any is 1; labels that are null, or whose doc_id is null, don't train; with labels of one
kind only, all scores are the smoothed share of toxic labels; without any labelled text (no labels, none that
meets a text, no texts) nothing speaks for toxicity and all scores are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc32_text, map_rows, mix

BITS, SIZES = 20, (3, 4, 5)
FIT_ROWS, FIT_CHARS, FIT_FEATURES = 6_000, 200_000, 40_000_000
SMOOTH, LEAST_TEXTS, ROUNDS, DECAY = 1.0, 4, 200, 2e-4
#: Features of the fit that are worked on at once.
BLOCK = 1 << 19


def ngrams(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams in text order, with repeats."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(code) >= n:
                run = np.full(len(code) - n + 1, n, np.uint64)
                for j in range(n):
                    run = run * np.uint64(0x9E3779B97F4A7C15) + code[j : j + len(run)]
                out.append((mix(run) >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _blocks(lengths: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of whole rows of about BLOCK features: first row and feature, and those after the last."""
    ends = np.append(0, np.cumsum(lengths))
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(0, ends[-1], BLOCK)), len(lengths)])
    return [(i, j, ends[i], ends[j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _fit(labels: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights of all features and the intercept. Empties `rows`: beside them it holds four bytes for each active feature and blocks of BLOCK features."""
    size, y = 1 << BITS, labels.astype(float)
    weights = np.zeros(size, np.float32)
    if not len(y):
        return weights, -math.inf
    positive = float(y.sum())
    prior = math.log((positive + SMOOTH) / (len(y) - positive + SMOOTH))
    if positive in (0, len(y)):
        return weights, prior
    with_, of_toxic = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for toxic, row in zip(y, rows, strict=True):  # no feature stands twice in a row
        with_[row] += 1
        if toxic:
            of_toxic[row] += 1
    ratio = np.log((of_toxic + SMOOTH) / (positive + 2 * SMOOTH)) - np.log((with_ - of_toxic + SMOOTH) / (len(y) - positive + 2 * SMOOTH))
    active = np.flatnonzero((with_ >= LEAST_TEXTS) & (np.abs(ratio) > 0.7))
    number = np.full(size, -1, np.int32)
    number[active] = np.arange(len(active))
    flat, lengths = np.empty(int(with_[active].sum(dtype=np.int64)), np.int32), np.zeros(len(rows), np.int64)
    at = 0
    for k, row in enumerate(rows):
        found = number[row]
        found = found[found >= 0]
        flat[at : at + len(found)] = found
        lengths[k], rows[k] = len(found), None
        at += len(found)
    rows.clear()
    blocks, value = _blocks(lengths), ratio[active] / 4
    w, b, m, v = np.zeros(len(active)), prior, np.zeros(len(active) + 1), np.zeros(len(active) + 1)
    balance = np.where(y > 0, 0.5 * len(y) / positive, 0.5 * len(y) / (len(y) - positive))
    for k in range(1, ROUNDS + 1):  # Adam over all rows
        g, of_b, part = np.zeros(len(active)), 0.0, w * value
        for i, j, lo, hi in blocks:
            z = b + np.bincount(np.repeat(np.arange(j - i), lengths[i:j]), part[flat[lo:hi]], j - i)
            error = balance[i:j] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i:j]) / len(y)
            g += np.bincount(flat[lo:hi], np.repeat(error, lengths[i:j]), len(active))
            of_b += error.sum()
        g = np.append(g * value + DECAY * w, of_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    w = w * value
    weights[active] = np.where(np.abs(w) < 1e-3, 0, w)
    return weights, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, float]:
    """The weight table (float32, 2^BITS) and intercept from (doc_id, toxic) rows and their texts."""
    bounded_batches(docs.sparkSession)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= FIT_CHARS)
    found = texts.join(F.broadcast(marked), "doc_id")
    rows = map_rows(found, ["doc_id", "toxic", "text"], "doc_id long, toxic int, grams binary", lambda: lambda i, y, t: (i, int(y > 0), np.unique(ngrams(t)).tobytes()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x, room = [], [], FIT_FEATURES
        for batch in batches:
            for toxic, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.frombuffer(raw.as_buffer(), np.uint32)
                if len(grams) <= room:
                    room -= len(grams)
                    y.append(toxic)
                    x.append(grams.copy())
        weights, b = _fit(np.array(y, int), x)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "intercept": [b]})

    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("grams")).select("toxic", "grams").mapInArrow(learn, "weights binary, intercept double").first()
    if model is None:  # no partition held a row
        weights, b = _fit(np.zeros(0, int), [])
        return weights.tobytes(), b
    return bytes(model.weights), model.intercept


@lru_cache(2)
def _table(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32)


def _score(text: str | None, weights: np.ndarray, intercept: float) -> float:
    grams = ngrams(text)
    z = intercept + float(weights[np.unique(grams[weights[grams] != 0])].sum(dtype=float))
    if z == -math.inf:
        return 0.0
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def scored(docs: DataFrame, model: tuple[bytes, float]) -> DataFrame:
    """doc_id and score, one pass without exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        weights, intercept = _table(shared.value[0]), shared.value[1]
        return lambda doc_id, text: (doc_id, _score(text, weights, intercept))

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double", start)


def below(docs: DataFrame, model: tuple[bytes, float], cut: float) -> DataFrame:
    """The documents that score below `cut`, with their columns."""
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = _table(shared.value[0]), shared.value[1]
        for batch in batches:
            yield batch.filter(pa.array([_score(t, weights, intercept) < cut for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out() -> object:
    """Rows kept out of training: crc32 of the id as text divides by 5."""
    return F.coalesce(crc32_text("doc_id") % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; trained on the rows that aren't held out."""
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
