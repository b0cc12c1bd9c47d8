"""Sequence packing by non-negative least squares over a length histogram.

1. Every document is encoded; its whole windows are sequences of their own, and its rest (shorter
   than a window) enters the histogram of rest lengths, which has at most ``window - 1`` bins.
2. Shallow combinations of two or three lengths that fill a window exactly are enumerated, and
   their repeat counts are fitted to the histogram by non-negative least squares.
3. Counts are rounded down and checked against the histogram; what is left of it is packed
   greedily, longest first: the residual rests stand end to end and are cut at every window.
4. The last, partly filled window is cut at powers of two, which need no padding.

The plan depends on the histogram alone (bounded by the window), and is solved on the driver. A
rest finds its place by its rank among rests of its length: a counter inside each task of the
encoding pass plus the totals of the tasks before it, so a length that a third of all documents
share needs no sorting and lands in no single task.

Nulls: a null text is empty and holds only the end id. Empty tables give empty results. Ties and
repeated rows are told apart by the order in which the encoding pass met them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, store, text_of
from .tokens import encoder

WINDOW = 2048
ROUNDS = 300
PIECES = (
    "task int, length int, rank long, doc_id long, start long, doc_tokens long, "
    "ids_crc32 long, ids binary"
)
PLACED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _batch(rows: list[tuple], kind: str):  # noqa: ANN202  (pyarrow is imported in workers)
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, types[t]) for n, t in (c.split() for c in kind.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def combinations(window: int) -> np.ndarray:
    """All sorted pairs and triples of lengths below ``window`` that add up to it.

    Rows (a, b, c) with a >= b >= c; c is 0 for a pair.
    """
    found = []
    for c in range(window // 3 + 1):
        b = np.arange(max(c, 1), (window - c) // 2 + 1)
        found.append(np.stack([window - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(found)


def nnls_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradient.

    Column j of A counts how often combination j uses each length (row 0 is not a length).
    """
    bins = len(histogram)
    used = combos.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.bincount(used, weights=np.repeat(x, 3), minlength=bins)
        out[0] = 0.0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[combos[:, 0]] + r[combos[:, 1]] + np.where(combos[:, 2] > 0, r[combos[:, 2]], 0.0)

    probe = np.ones(len(combos))
    for _ in range(20):
        probe = back(forward(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = ahead = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        moved = np.maximum(0.0, ahead - back(forward(ahead) - histogram) / (1.02 * size))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = moved + (t - 1) / t_next * (moved - x)
        x, t = moved, t_next
    return x


class Plan:
    """Where the rest of each length and rank goes."""

    def __init__(self, histogram: np.ndarray, window: int) -> None:
        self.window = window
        combos = combinations(window)
        combos = combos[(histogram[combos[:, 0]] > 0) & (histogram[combos[:, 1]] > 0)
                        & ((combos[:, 2] == 0) | (histogram[combos[:, 2]] > 0))]
        left = histogram.astype(np.int64).copy()
        slots: list[tuple[int, int, int, int]] = []  # length, repeats, first sequence, offset
        sequence = int(left[window])
        self.first_rest = sequence
        left[window] = 0
        if len(combos):
            counts = nnls_counts(left.astype(float), combos)
            order = np.argsort(-counts, kind="stable")
            # Fitted counts first, then what the rounding left, both within the histogram.
            for wanted in (np.floor(counts + 1e-6).astype(np.int64), None):
                for j in order:
                    parts = [int(p) for p in combos[j] if p]
                    most = min(int(left[p]) // parts.count(p) for p in parts)
                    n = most if wanted is None else min(most, int(wanted[j]))
                    if n <= 0:
                        continue
                    offset = 0
                    for p in parts:
                        left[p] -= n
                        slots.append((p, n, sequence, offset))
                        offset += p
                    sequence += n
        slots.sort(key=lambda s: s[0])
        self.slots = np.array(slots, dtype=np.int64).reshape(-1, 4)
        self.slot_from = np.searchsorted(self.slots[:, 0], np.arange(window + 2))
        self.slot_end = np.cumsum(self.slots[:, 1])
        self.residual_first = sequence
        longest_first = left[::-1] * np.arange(len(left))[::-1]
        self.residual_base = (np.cumsum(longest_first) - longest_first)[::-1].copy()
        self.residual_total = int(longest_first.sum())

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """Cuts (sequence, offset, length) of the ``rank``-th rest of a length."""
        if length == self.window:
            return [(rank, 0, length)]
        low, high = int(self.slot_from[length]), int(self.slot_from[length + 1])
        before = int(self.slot_end[low - 1]) if low else 0
        at = int(np.searchsorted(self.slot_end[low:high], rank + before, side="right")) + low
        if at < high:
            _, n, sequence, offset = (int(v) for v in self.slots[at])
            return [(sequence + rank + before - (int(self.slot_end[at]) - n), offset, length)]
        planned = (int(self.slot_end[high - 1]) if high > low else before) - before
        begin = int(self.residual_base[length]) + (rank - planned) * length
        return self._cut(begin, length)

    def _cut(self, begin: int, length: int) -> list[tuple[int, int, int]]:
        cuts, end = [], begin + length
        whole = self.residual_total // self.window
        while begin < end:
            sequence, offset, size = begin // self.window, begin % self.window, self.window
            if sequence == whole:  # the partly filled tail, as powers of two
                rest, start = self.residual_total % self.window, 0
                while True:
                    size = 1 << (rest.bit_length() - 1)
                    if offset < start + size:
                        break
                    start, rest, sequence = start + size, rest - size, sequence + 1
                offset -= start
            take = min(end - begin, size - offset)
            cuts.append((self.residual_first + sequence, offset, take))
            begin += take
        return cuts


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    end_id: int = 1,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator) -> Iterator:
        codec, task = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        met = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            for doc_id, raw in zip(
                batch.column("doc_id").to_pylist(), codec.encode(texts), strict=True
            ):
                tokens = len(raw) // 4
                for start in range(0, tokens, window):
                    part = raw[4 * start : 4 * (start + window)]
                    n = len(part) // 4
                    rows.append((task, n, int(met[n]), doc_id, start, tokens, zlib.crc32(part),
                                 None if n == window else part))
                    met[n] += 1
            yield _batch(rows, PIECES)

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = store(ids.mapInArrow(encode, PIECES), "pack-pieces")
    totals = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in totals.groupBy("length").agg(F.sum("n").alias("n")).collect():  # <= window rows
        histogram[row.length] = row.n
    plan = spark.sparkContext.broadcast(Plan(histogram, window))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = totals.select(
        "length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator) -> Iterator:
        solved = plan.value
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                done = 0
                for sequence, offset, n in solved.place(p["length"], p["rank"]):
                    crc = p["ids_crc32"] if n == p["length"] else zlib.crc32(
                        p["ids"][4 * done : 4 * (done + n)]
                    )
                    rows.append((p["doc_id"], p["start"] + done, n, crc, p["doc_tokens"],
                                 sequence, offset))
                    done += n
            yield _batch(rows, PLACED)

    return ranked.select(
        "length", "rank", "doc_id", "start", "doc_tokens", "ids_crc32", "ids"
    ).mapInArrow(place, PLACED)
