"""Packing token pieces into fixed windows by non-negative least squares.

Full windows of a document are sequences of their own. Of the rest, each input partition packs its tails:
combinations of up to three lengths that fill a window exactly are the columns of a matrix, the histogram of
tail lengths is the right-hand side, and non-negative least squares gives each combination's repeat count.
Counts are rounded, and bounded by what is there where rounding up asks for more; residual tails are packed
greedily and cut where that fills a window. What is left at the end is cut into sequences of a power of two,
which need no padding.

A partition is bounded by the reader's split size, holds a tail of under one window for each of its
documents, and needs no exchange. Sequence ids carry the partition's number in their upper bits.

Defined results: null text counts as empty, and an empty document is its end id alone; null doc_id is
carried; repeated rows are packed as rows of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches, token_cache

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of present lengths that fill the window, one a row, 0 for no third; lengths ascend."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    pairs = lengths[(lengths * 2 <= window) & there[window - lengths]]
    out = [np.stack([window - pairs, pairs, np.zeros_like(pairs)], 1)]
    for a in lengths[lengths * 3 <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[there[window - a - b]]
        out.append(np.stack([window - a - b, b, np.full_like(b, a)], 1))
    return np.concatenate(out)


def solve(columns: np.ndarray, histogram: np.ndarray, rounds: int = 40, close: float = 0.05) -> np.ndarray:
    """Non-negative x with columns of x near the histogram, by coordinate descent on the squares.

    A round moves, each to its own optimum, the columns whose step gains more than that of any column that shares a
    length with them; as these share none, they are orthogonal and move together. Starting from nothing with the
    steepest columns keeps x sparse, with counts large enough to survive rounding. Ends when no step reaches `close`.
    """
    size, target = len(histogram), histogram.astype(float)
    a, b, c = (np.ascontiguousarray(x) for x in columns.T)
    norm = 1.0 + (b > 0) + (c > 0) + 2 * (a == b) + 2 * ((b == c) & (c > 0)) + 2 * (a == c)
    jitter = 1 + 1e-9 * np.arange(len(columns)) / max(1, len(columns))
    x = np.zeros(len(columns))
    for _ in range(rounds):
        short = target - np.bincount(a, x, size) - np.bincount(b, x, size) - np.bincount(c, x, size)
        short[0] = 0  # no third
        step = np.maximum(-x, (short[a] + short[b] + short[c]) / norm)
        at = np.flatnonzero(np.abs(step) >= close)
        if not len(at):
            break
        step, i, j, k = step[at], a[at], b[at], c[at]
        gain = step * step * norm[at] * jitter[at]
        best = np.zeros(size)
        for rows in (i, j, k):
            np.maximum.at(best, rows, gain)
        best[0] = 0
        first = (best[i] <= gain) & (best[j] <= gain) & (best[k] <= gain)
        x[at[first]] += step[first]
    return x


def plan(lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences for tails of these lengths (each under a window): lists of (tail, from, length)."""
    left: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable"):
        left[int(lengths[i])].append(int(i))
    histogram = np.bincount(lengths, minlength=window + 1)
    columns = combinations(np.flatnonzero(histogram), window) if len(lengths) else np.zeros((0, 3), int)
    if len(columns):
        counts = solve(columns, histogram)
        for k in np.argsort(-counts, kind="stable"):
            if (times := round(counts[k])) == 0:
                break
            need = [n for n in columns[k].tolist() if n]
            for _ in range(min(times, *(len(left[n]) // need.count(n) for n in need))):
                yield [(left[n].pop(), 0, n) for n in need]
    rest = sorted((n, i, 0) for n, found in left.items() for i in found)
    current, room = [], window
    while rest:
        k = bisect_right(rest, (room, len(lengths), window)) - 1
        n, i, start = rest.pop(k if k >= 0 else 0)
        take = min(n, room)
        if n > take:
            insort(rest, (n - take, i, start + take))
        current.append((i, start, take))
        room -= take
        if not room:
            yield current
            current, room = [], window
    room = window - room
    while room:
        size, part = 1 << (room.bit_length() - 1), []
        room -= size
        while size:
            i, start, n = current.pop(0)
            take = min(n, size)
            if n > take:
                current.insert(0, (i, start + take, n - take))
            part.append((i, start, take))
            size -= take
        yield part


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece: its document, place there, digest of its ids, sequence and offset there."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(tokenizer_path, True)
        wide, size = cache.dtype, cache.dtype.itemsize
        end = np.array([end_id], wide).tobytes()
        base = TaskContext.get().partitionId() << 40
        tails, owners, made, rows = [], [], 0, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)
            rows.clear()
            return out

        for got in batches:
            for doc_id, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                raw = cache(text) + end
                ids = np.frombuffer(raw, wide).astype("<u4")
                for at in range(0, len(ids) - window + 1, window):
                    rows.append((doc_id, at, window, zlib.crc32(ids[at : at + window].tobytes()), len(ids), base + made, 0))
                    made += 1
                if at := len(ids) % window:
                    tails.append(raw[-size * at :])
                    owners.append((doc_id, len(ids) - at, len(ids)))
            if len(rows) >= 10_000:
                yield batch()
        for sequence in plan(np.array([len(t) // size for t in tails], np.int64), window):
            offset = 0
            for i, start, n in sequence:
                doc_id, at, total = owners[i]
                piece = np.frombuffer(tails[i], wide, n, size * start).astype("<u4").tobytes()
                rows.append((doc_id, at + start, n, zlib.crc32(piece), total, base + made, offset))
                offset += n
            made += 1
            if len(rows) >= 10_000:
                yield batch()
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
