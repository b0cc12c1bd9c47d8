"""Token ids in a binary file format with a minimal perfect hash index.

``write_ids`` range-sorts the documents by id and writes Parquet files that hold one row per shard:
the raw ids of its documents end to end (little-endian, 2 bytes wide where the vocabulary allows,
else 4) and the directory of its documents. ``write_index`` adds the index: keys are dealt to
buckets by hash, and each bucket has a minimal perfect hash function (a cascade of bit arrays:
a key that alone claims a bit of its level owns it, the others try the next level; its slot is the
rank of its bit). Slots hold a 32-bit fingerprint of the key and the place (task, shard, offset,
length). ``locate`` asks one bucket per key in constant time; ``fetch`` reads the payload there.

A key is (id, copy): rows that share an id are copies 0, 1, ... in text order. Nulls: a null id is a
key like any other and sorts first; a null text is empty and holds only the end id. Empty tables
give an empty store. Shards are closed at ``SHARD_IDS`` ids, so that any reader's memory is bounded
by that or by the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, store, text_of
from .tokens import encoder

SHARD_IDS, SHARD_DOCS, BUCKET_KEYS = 2_000_000, 50_000, 4096
SHARDS = (
    "task int, shard int, width int, n_ids long, doc_ids array<long>, copies array<long>, "
    "offsets array<long>, payload binary"
)
INDEX = (
    "bucket long, levels array<long>, bits binary, fingerprints binary, tasks binary, "
    "shards binary, offsets binary, lengths binary"
)
DOC = "doc_id long, copy long, task int, shard int, offset long, n_tokens long, ids_crc32 long"


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    end_id: int = 2,
    width: int = 2,
) -> None:
    """Write the ids of every document, with ``end_id`` appended, in ascending id order."""
    spark = docs.sparkSession
    small_batches(spark)

    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec, task = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        kind, shard, last, copy = np.dtype(f"<u{width}"), 0, (), 0
        ids: list = []
        copies: list[int] = []
        offsets, parts = [0], []

        def row() -> pa.RecordBatch:
            values = (task, shard, width, offsets[-1], ids, copies, offsets, b"".join(parts))
            types = [pa.int32()] * 3 + [pa.int64()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            arrays = [pa.array([v], t) for v, t in zip(values, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            raws = codec.encode(batch.column("text").to_pylist())
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws, strict=True):
                if ids and (offsets[-1] + len(raw) // 4 > SHARD_IDS or len(ids) >= SHARD_DOCS):
                    yield row()
                    ids, copies, offsets, parts, shard = [], [], [0], [], shard + 1
                copy = copy + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                ids.append(doc_id)
                copies.append(copy)
                wide = np.frombuffer(raw, dtype="<u4")
                if width < 4 and int(wide.max()) >> (8 * width):
                    raise ValueError(f"an id does not fit into {width} bytes")
                parts.append(wide.astype(kind).tobytes())
                offsets.append(offsets[-1] + len(raw) // 4)
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARDS).write.parquet(f"{path}/shards")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{path}/shards")


def _mix(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of (key, copy) for a level; a finaliser over both words, seeded."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        for salt in (copies.astype(np.uint64), np.uint64(seed)):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = (h ^ (h >> np.uint64(31))) + salt * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _fingerprint(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return (_mix(keys, copies, 0) >> np.uint64(32)).astype("<u4")


def build_hash(keys: np.ndarray, copies: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes in bits, all levels' bits, and the slot of each (distinct) key."""
    levels: list[int] = []
    arrays, owners = [], []
    left = np.arange(len(keys))
    while len(left):
        size = max(64, 2 * len(left))
        at = (_mix(keys[left], copies[left], len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        bits, owner = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
        won = alone[at]
        bits[at[won]], owner[at[won]] = True, left[won]
        levels.append(size)
        arrays.append(bits)
        owners.append(owner[bits])
        left = left[~won]
    order = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    slots = np.empty(len(keys), dtype=np.int64)
    slots[order] = np.arange(len(order))
    return levels, np.concatenate(arrays) if arrays else np.zeros(0, dtype=bool), slots


def find_slots(
    levels: list[int], bits: np.ndarray, keys: np.ndarray, copies: np.ndarray
) -> np.ndarray:
    """The slot of each key, -1 where no level claims it."""
    ranks = np.concatenate([[0], np.cumsum(bits)])
    slots, base = np.full(len(keys), -1, dtype=np.int64), 0
    for level, size in enumerate(levels, 1):
        at = (_mix(keys, copies, level) % np.uint64(size)).astype(np.int64) + base
        hit = (slots < 0) & bits[at]
        slots[hit] = ranks[at[hit]]
        base += size
    return slots


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    """Null ids get a number of their own for hashing; ``is_null`` keeps them apart from it."""
    return keys.select(
        "*",
        F.coalesce("doc_id", F.lit(0)).alias("key"),
        F.when(F.col("doc_id").isNull(), -1 - F.col("copy")).otherwise(F.col("copy")).alias("nth"),
    ).withColumn("bucket", F.pmod(F.xxhash64("key", "nth"), F.lit(buckets)))


def write_index(spark: SparkSession, path: str) -> None:
    """Build the index over every row of a written store, bucket by bucket."""
    spread = F.expr(
        "posexplode(transform(doc_ids, (d, i) -> struct(d AS doc_id, copies[i] AS copy, "
        "offsets[i] AS offset, offsets[i + 1] - offsets[i] AS length)))"
    )
    places = _shards(spark, path).select("task", "shard", spread).select("task", "shard", "col.*")
    buckets = max(1, -(-places.count() // BUCKET_KEYS))

    def build(key, rows):  # noqa: ANN001, ANN202
        import pandas as pd

        keys, copies = rows["key"].to_numpy(), rows["nth"].to_numpy()
        levels, bits, slots = build_hash(keys, copies)
        order = np.argsort(slots)
        packed = [
            rows[c].to_numpy()[order].astype(t).tobytes()
            for c, t in (("task", "<i4"), ("shard", "<i4"), ("offset", "<i8"), ("length", "<i8"))
        ]
        prints = _fingerprint(keys, copies)[order].tobytes()
        return pd.DataFrame([(key[0], levels, np.packbits(bits).tobytes(), prints, *packed)])

    _bucketed(places, buckets).drop("doc_id", "copy").groupBy("bucket").applyInPandas(
        build, INDEX
    ).withColumn("buckets", F.lit(buckets).cast("long")).write.parquet(f"{path}/index")


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Places (doc_id, copy, task, shard, offset, n_tokens) of the keys (doc_id, copy) found.

    Each key asks one bucket: hash to a slot, compare the fingerprint, read the place. A key that
    was never stored is refused but for one chance in 2^32.
    """
    index = spark.read.parquet(f"{path}/index")
    first = index.select("buckets").first()
    buckets = first.buckets if first else 1

    def ask(rows, found):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(rows) or not len(found):
            return pd.DataFrame(columns=["key", "nth", "task", "shard", "offset", "n_tokens"])
        b = found.iloc[0]
        levels = [int(v) for v in b.levels]
        bits = np.unpackbits(np.frombuffer(b.bits, np.uint8), count=sum(levels)).astype(bool)
        keys, nth = rows["key"].to_numpy(), rows["nth"].to_numpy()
        slots = find_slots(levels, bits, keys, nth)
        stored = np.frombuffer(b.fingerprints, "<u4")
        good = (slots >= 0) & (stored[np.maximum(slots, 0)] == _fingerprint(keys, nth))
        s = slots[good]
        return pd.DataFrame({
            "key": keys[good], "nth": nth[good],
            "task": np.frombuffer(b.tasks, "<i4")[s], "shard": np.frombuffer(b.shards, "<i4")[s],
            "offset": np.frombuffer(b.offsets, "<i8")[s],
            "n_tokens": np.frombuffer(b.lengths, "<i8")[s],
        })

    asked = _bucketed(keys.select("doc_id", "copy"), buckets).select("bucket", "key", "nth")
    places = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        ask, "key long, nth long, task int, shard int, offset long, n_tokens long"
    )
    return places.select(
        F.when(F.col("nth") >= 0, F.col("key")).alias("doc_id"),
        F.when(F.col("nth") >= 0, F.col("nth")).otherwise(-1 - F.col("nth")).alias("copy"),
        "task", "shard", "offset", "n_tokens",
    )


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Ids of the keys (doc_id, copy): the located places, joined with the shards they lie in.

    Meant for key sets that touch part of the shards; a whole read is ``scan``.
    """
    at = locate(spark, path, keys)
    shards = _shards(spark, path)
    piece = F.expr(
        "substring(payload, cast(offset * width + 1 as int), cast(n_tokens * width as int))"
    )
    return at.join(shards.select("task", "shard", "width", "payload"), ["task", "shard"]).select(
        "doc_id", "copy", "width", piece.alias("raw")
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document with its place, number of ids and crc32 of its 32-bit ids."""
    small_batches(spark)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                wide = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                cuts, n = row["offsets"], len(row["doc_ids"])
                sums = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                columns = [
                    row["doc_ids"], row["copies"], [row["task"]] * n, [row["shard"]] * n,
                    cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:])], sums,
                ]
                types = [pa.int32() if c.endswith(" int") else pa.int64() for c in DOC.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    [c.split()[0] for c in DOC.split(", ")],
                )

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return _shards(spark, path).mapInArrow(read, DOC)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(task, shard, first): ids of all documents before a shard, over tasks, then inside each."""
    shards = _shards(spark, path).select("task", "shard", "n_ids")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(
        tasks, "task"
    ).select("task", "shard", (F.col("base") + F.col("before")).alias("first"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: doc_id, copy, start, n_tokens, ids_crc32.

    The place comes from the index; the content from the scan of the payload. A document whose
    place in the index and in the payload differ would be missing, which tests rule out.
    """
    stored = store(scan(spark, path), "ids-read")
    keys = stored.select("doc_id", "copy")
    at = locate(spark, path, keys)
    place = ["task", "shard", "offset"]
    return stored.drop("doc_id", "copy", "n_tokens").join(at, place).join(
        shard_starts(spark, path), ["task", "shard"]
    ).select(
        "doc_id", "copy", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
