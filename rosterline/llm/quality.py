"""Quality scores from document statistics: random Fourier features, ridge, isotonic calibration.

1. Each whole text becomes a few statistics (shares of character classes, repetition, shape of
   words and lines); they are standardised over the labelled training rows.
2. Random Fourier features approximate a Gaussian kernel over the statistics. Every partition sums
   its normal equations; the sums meet in a grouping with one key per matrix cell, so the driver
   gets one matrix of fixed size, whatever the number of rows or partitions.
3. Ridge scores are calibrated by isotonic regression over a histogram of fixed size.

Training uses all labelled rows of the training folds, each as often as its document occurs;
several labels of a document count with their mean. No id, label, language or source enters a
score. Nulls: a null text is empty, a null label does not count, a null id cannot be labelled.
Without training rows every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store, text_of

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "not_ascii", "distinct",
    "repeated", "top_word", "bare_marks", "marked_words", "short_words", "lines", "same_lines",
    "same_triples",
)
FEATURES, RIDGE, BINS, SEED = 256, 1e-3, 2000, 20
LOW, HIGH = -0.5, 1.5


def statistics(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text, all of them shares or logarithms."""
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    foreign, space = counts[128:].sum(), counts[9:14].sum() + counts[32]
    marks = n - upper - lower - digits - foreign - space
    visible = max(1, n - space)
    lowered = text.lower().split()
    tally: dict[bytes, int] = {}
    for word in lowered:
        tally[word] = tally.get(word, 0) + 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    triples = list(zip(lowered, lowered[1:], lowered[2:]))
    bare = sum(1 for word in words if not word.isalnum() and not any(c > 127 or chr(c).isalnum() for c in word[:4]))
    marked = sum(1 for word in words if 32 < word[-1] < 48 or word[-1] in b"|:;<=>?@[]^_`{}~\\")
    return [
        float(np.log1p(n)), float(np.log1p(w)), min(visible / w, 50.0), upper / visible,
        digits / visible, marks / visible, foreign / visible, len(tally) / w,
        sum(a == b for a, b in zip(lowered, lowered[1:])) / w, max(tally.values()) / w, bare / w,
        marked / w, sum(len(word) <= 3 for word in words) / w, min(len(lines) / w, 1.0),
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(triples)) / max(1, len(triples)),
    ]


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def fold(doc_id: Column) -> Column:
    """0 to 4; rows of fold 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Model:
    """Everything a score needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        # A trace of the raw score keeps the order inside the levels of the calibration.
        inside = (np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW)
        return 0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * inside


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centres and levels of the pools."""
    pools: list[list[float]] = []
    for x, y, w in zip(at, value, weight, strict=True):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def _pass(rows: DataFrame, run: Callable[[np.ndarray, np.ndarray], tuple], kind: str) -> DataFrame:
    """One row per cell of what ``run`` sums over the partition's (x, y)."""

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist())
                found = run(x, batch.column("y").to_numpy(zero_copy_only=False))
                total = found if total is None else total + found
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "v"])

    return rows.mapInArrow(sums, kind).groupBy("cell").agg(F.sum("v").alias("v"))


def fit(described: DataFrame, labels: DataFrame, *, features: int = FEATURES) -> Model:
    """Fit on the described rows (doc_id, x) that ``labels`` (doc_id, quality) marks.

    ``described`` should be a stored table: it is read three times.
    """
    small_batches(described.sparkSession, 2048)
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg("quality").alias("y")
    )
    rows = store(
        described.filter(fold(F.col("doc_id")) != 0).join(marks, "doc_id").select("x", "y"),
        "quality-rows",
    )
    d = len(STATISTICS)
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    rng = np.random.default_rng(SEED)
    waves, phases = rng.normal(0, 1 / np.sqrt(d), (d, features)), rng.uniform(0, 2 * np.pi, features)
    n = moments["n"]
    if not n:
        return Model(np.zeros(d), np.ones(d), waves, phases)
    scale = np.array([moments[f"s{i}"] for i in range(d)])
    model = Model(
        np.array([moments[f"m{i}"] for i in range(d)]), np.where(scale > 1e-9, scale, 1.0), waves, phases
    )
    size = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.lift(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = np.zeros(size * size + size)
    for row in _pass(rows, normal, "cell long, v double").toLocalIterator():
        sums[row.cell] = row.v
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    penalty = RIDGE * n / features * np.eye(size)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + penalty, right)

    def tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = ((np.clip(model.raw(x), LOW, HIGH) - LOW) / (HIGH - LOW) * (BINS - 1)).round().astype(int)
        return np.concatenate(
            [np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]
        ).astype(float)

    sums = np.zeros(2 * BINS)
    for row in _pass(rows, tally, "cell long, v double").toLocalIterator():
        sums[row.cell] = row.v
    count, good = sums[:BINS], sums[BINS:]
    there = np.flatnonzero(count)
    at = LOW + there / (BINS - 1) * (HIGH - LOW)
    model.knots, model.levels = isotonic(at, good[there] / count[there], count[there])
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per described row."""
    small_batches(described.sparkSession, 2048)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"]
            )

    return described.mapInArrow(run, "doc_id long, score double")


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    *, threshold: float = 0.3,
) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; fitted on these documents."""
    model = fit(store(describe(docs, id_col, text_col), "quality-described"), labels)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(model.score(x))

    return docs.filter(scored(text_of(text_col).cast("binary")) >= threshold)
