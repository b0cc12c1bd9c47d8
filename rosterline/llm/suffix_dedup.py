"""Removal of byte strings of 400 bytes or more that occur twice, by blockwise suffix naming.

A byte goes if it lies in a ``LENGTH``-byte string that also starts anywhere else. The classical
blockwise construction sorts suffixes one bucket at a time and settles long ties with ranks of a
cover sample: positions such that any two suffixes meet sampled positions at a common distance.
Here the cover sample is chosen by content (the least hash among ``SPAN`` consecutive substrings),
so equal strings are sampled at equal distances without fixed residues, and one position in about
a hundred is sampled. Every string start belongs to exactly one sampled position: the least one
of its own string. A bucket is all suffixes that begin with the same sampled substring.

Inside the buckets, ranks (hashes of ever shorter contexts around the sampled position) settle
ties level by level. A node stands for a range of string starts. If two nodes of a bucket agree on
the union of their strings, every string of the range occurs twice; if a node's common core occurs
once, none does; all other nodes are split in four, down to single strings. One representative of
every settled context stays as a partner for the unsettled ones, so no pair within a bucket is
listed and no bucket is gathered in a task.

Rows are narrow: text is read where it lies, except for the texts of open nodes and of removals.
Ranks are 64-bit hashes, compared within equal cores only; a wrong match needs equal hashes of
different strings. Documents are known by a 64-bit hash of id and text.

Nulls: a null text is empty; texts shorter than ``LENGTH`` lose nothing. Repeated rows are copies
of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, maybe_in, small_batches, store, text_of

LENGTH, SPAN, FAN = 400, 256, 4
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


class Rolling:
    """64-bit hashes of any byte range of a chunk, each in constant time."""

    _tables: tuple | None = None

    def __init__(self, data: np.ndarray) -> None:
        size = len(data) + 1
        if Rolling._tables is None or len(Rolling._tables[1]) < size:
            room = max(size, CHUNK + 4 * LENGTH)
            letters = np.random.default_rng(1).integers(1, MASK, 256, dtype=np.uint64, endpoint=True)
            powers, inverse = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(room, b, dtype=np.uint64))])
                for b in (BASE, pow(BASE, -1, 1 << 64))
            )
            Rolling._tables = (letters, powers, inverse)
        letters, powers, self.inverse = Rolling._tables
        self.sums = np.zeros(size, dtype=np.uint64)
        np.cumsum(letters[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slide(values: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over every full window of ``width`` values, by block prefixes and suffixes."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, fill, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    behind = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def _windows(at: np.ndarray, h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted sampled positions: the first and the last string start that each one owns.

    A start belongs to the leftmost least sampled position among the ``span`` positions from it.
    """
    first, last = at - span + 1, at.copy()
    n, step = len(at), 1
    while step < n:
        gap = at[step:] - at[:-step]
        near = gap < span
        if not near.any():
            break
        left_wins = near & (h[:-step] <= h[step:])
        right_wins = near & (h[step:] < h[:-step])
        np.maximum(first[step:], np.where(left_wins, at[:-step] + 1, first[step:]), out=first[step:])
        np.minimum(last[:-step], np.where(right_wins, at[step:] - span, last[:-step]), out=last[:-step])
        step += 1
    return first, last


def union_names(
    roll: Rolling, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int
) -> np.ndarray:
    """Hash of all strings that start ``hi`` to ``lo`` bytes before ``at``, and of that range."""
    shape = (hi.astype(np.uint64) << np.uint64(16)) + lo.astype(np.uint64)
    return mixed(roll.of(at - hi, at - lo + length) + shape * np.uint64(BASE))


def anchors(data: np.ndarray, length: int = LENGTH, span: int = SPAN) -> Iterator[tuple]:
    """Yield (position, core, union, lo, hi) arrays of a text's sampled positions, by chunks.

    Owned string starts are position - hi .. position - lo.
    """
    n, core = len(data), length - span + 1
    for begin in range(0, max(0, n - core + 1), CHUNK):
        low = max(0, begin - span)
        roll = Rolling(data[low : min(n, begin + CHUNK + length + span)])
        if len(roll.sums) - 1 < length:
            continue
        at = np.arange(len(roll.sums) - core)
        h = roll.of(at, at + core)
        least = _slide(h, span, np.minimum, MASK)
        rim = np.zeros(span - 1, np.uint64)
        chosen = np.flatnonzero(_slide(np.concatenate([rim, least, rim]), span, np.maximum, 0) == h)
        first, last = _windows(chosen, h[chosen], span)
        first, last = np.maximum(first, 0), np.minimum(last, len(roll.sums) - 1 - length)
        mine = (first <= last) & (chosen + low >= begin) & (chosen + low < begin + CHUNK)
        s, lo, hi = chosen[mine], (chosen - last)[mine], (chosen - first)[mine]
        yield s + low, h[s], union_names(roll, s, lo, hi, length), lo, hi


def children(
    data: np.ndarray, nodes: list[dict], width: int, length: int, span: int
) -> Iterator[tuple]:
    """Yield (position, node, core, union, weight, lo, hi) arrays: the nodes' four parts each."""
    n = len(data)
    at, j, w, lo, hi = (
        np.array([x[c] for x in nodes], dtype=np.int64) for c in ("p", "j", "w", "lo", "hi")
    )
    for begin in range(0, n, CHUNK):
        here = (at >= begin) & (at < begin + CHUNK)
        if not here.any():
            continue
        low = max(0, begin - span)
        roll = Rolling(data[low : min(n, begin + CHUNK + length + span)])
        for part in range(FAN):
            node = j[here] * FAN + part
            a, z = node * width, node * width + width - 1
            first, last = np.maximum(lo[here], a), np.minimum(hi[here], z)
            ok = first <= last
            s, a, z, first, last = (v[ok] for v in (at[here] - low, a, z, first, last))
            yield (s + low, node[ok], roll.of(s - a, s - z + length),
                   union_names(roll, s, first, last, length), w[here][ok], first, last)


ACT = "uid long, p long, j int, core long, u long, w int, lo int, hi int"


def _act(uid: list[int], found: list[tuple]):  # noqa: ANN202  (pyarrow is imported in workers)
    """Arrow batch of the arrays (position, node, core, union, weight, lo, hi) of several texts."""
    import pyarrow as pa

    counts = [len(f[0]) for f in found]
    columns = [np.repeat(np.array(uid, dtype="i8"), counts)]
    empty = [np.zeros(0, dtype="u8")] * 7
    columns += [np.concatenate(c) for c in zip(*(found or [empty]), strict=True)]
    names = [c.split() for c in ACT.split(", ")]
    arrays = [
        pa.array(c.view("i8") if c.dtype == np.uint64 else c.astype("i8")).cast(
            pa.int32() if t == "int" else pa.int64()
        )
        for c, (_, t) in zip(columns, names, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in names])


def _settle(act: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Ranges settled as repeated (uid, a, b), and the nodes to split (uid, p, j, w, lo, hi)."""
    node, name = ["j", "core"], ["j", "core", "u"]
    shared = act.groupBy(*node).agg(F.sum("w").alias("n")).filter("n > 1")
    likely = maybe_in(act, node, bit_filter(shared, node, bits), bits).filter("_maybe").drop("_maybe")
    classes = store(
        likely.groupBy(*name).agg(
            F.sum("w").alias("n"), F.min("w").alias("open"),
            F.min(F.struct("uid", "p", "lo", "hi")).alias("one"),
        ),
        "repeat-classes",
    )
    twice = classes.filter("n > 1 and open = 1").select(*name)
    done = (
        maybe_in(likely.filter("w = 1"), name, bit_filter(twice, name, bits), bits).filter("_maybe")
        .join(twice, name)
        .select("uid", (F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo")).alias("b"))
    )
    mixed_groups = classes.groupBy(*node).agg(
        F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")
    ).filter("kinds > 1 and least = 1")
    split = maybe_in(classes, node, bit_filter(mixed_groups, node, bits), bits).filter("_maybe")
    return store(done, "repeat-ranges"), split.select(
        "one.uid", "one.p", "j", F.least("n", F.lit(2)).cast("int").alias("w"), "one.lo", "one.hi"
    )


def cover(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that start in the ranges a..b."""
    runs: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or []):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b + length)
        else:
            runs.append([a, b + length])
    return [(a, b) for a, b in runs]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = LENGTH,
    span: int = SPAN,
    filter_bits: int = 1 << 24,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes).

    ``span`` is a power of four and less than ``length``.
    """
    spark = docs.sparkSession
    small_batches(spark, 64)
    text = text_of(text_col)
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"),
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text).alias("uid"),
    )
    long = base.filter(F.octet_length("text") >= length).select("uid", "text")
    # Rows of one id and text are read once, whatever their number: every string of them occurs twice.
    again = store(
        long.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("uid"), "repeat-ids"
    )
    likely = maybe_in(long, ["uid"], bit_filter(again, ["uid"], filter_bits), filter_bits)
    folded = store(
        likely.filter("_maybe").groupBy("uid").agg(
            F.first("text").alias("text"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("w")
        ),
        "repeat-rows",
    )
    once = likely.filter("not _maybe").select("uid", "text", F.lit(1).alias("w")).unionByName(folded)

    def sample(batches: Iterator) -> Iterator:
        for batch in batches:
            uids, found = [], []
            for uid, raw, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, core, union, lo, hi in anchors(np.frombuffer(raw, np.uint8), length, span):
                    uids.append(uid)
                    found.append((at, np.zeros_like(at), core, union, np.full_like(at, w), lo, hi))
            yield _act(uids, found)

    def cores(batches: Iterator) -> Iterator:
        for batch in sample(batches):
            yield batch.select(["core"])

    # Most sampled substrings occur once: a first pass counts them, a second one keeps the others.
    counted = once.mapInArrow(cores, "core long").groupBy("core").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    repeated = store(bit_filter(counted, ["core"], filter_bits), "repeat-cores")
    sampled = once.mapInArrow(sample, ACT)
    act = store(
        maybe_in(sampled, ["core"], repeated, filter_bits).filter("_maybe").drop("_maybe"), "repeat-act"
    )
    width = span
    settled = folded.filter("w = 2").select(
        "uid", F.lit(0).alias("a"), (F.octet_length("text") - length).alias("b")
    )
    while True:
        done, split = _settle(act, filter_bits)
        settled = settled.unionByName(done)
        if width == 1:
            break
        width //= FAN
        nodes = split.groupBy("uid").agg(F.collect_list(F.struct("p", "j", "w", "lo", "hi")).alias("nodes"))
        nodes = store(nodes, "repeat-nodes")
        words = bit_filter(nodes, ["uid"], filter_bits)
        texts = maybe_in(once.select("uid", "text"), ["uid"], words, filter_bits).filter("_maybe")

        def divide(batches: Iterator, width: int = width) -> Iterator:
            for batch in batches:
                uids, found = [], []
                for row in batch.to_pylist():
                    for part in children(
                        np.frombuffer(row["text"], np.uint8), row["nodes"], width, length, span
                    ):
                        uids.append(row["uid"])
                        found.append(part)
                yield _act(uids, found)

        act = store(
            texts.join(nodes, "uid").select("uid", "text", "nodes").mapInArrow(divide, ACT), "repeat-act"
        )
    ranges = store(
        settled.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "repeat-spans"
    )
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kind += ", kept binary" * with_text

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                raw, runs = row["text"], cover(row["ranges"], length)
                ends = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((row["id"], len(raw), len(raw) - len(kept), len(runs),
                             hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in kind.split(", ")]
            )

    marked = maybe_in(base, ["uid"], bit_filter(ranges, ["uid"], filter_bits), filter_bits)
    touched = marked.filter("_maybe").join(ranges, "uid", "left").select("id", "text", "ranges")
    clean = marked.filter("not _maybe").select(
        "id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")
    )
    # The two parts go through Python apart, so that the plain one keeps its own tasks.
    return touched.mapInArrow(finish, kind).unionByName(clean.mapInArrow(finish, kind)).withColumnRenamed(
        "id", id_col
    )
