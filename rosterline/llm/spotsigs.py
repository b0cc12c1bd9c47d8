"""SpotSigs document fingerprints.

A spot is a common word (an anchor) with the chain of the next content words after it; content
words are the words that are no anchors. The set of a text's spot hashes is its fingerprint, and
likeness is the Jaccard value of two sets. Page furniture holds few common words, so spots come from
running text.

``near_duplicates`` finds all pairs at a threshold: sets are partitioned by length so that a set's
partners lie in its own partition or the next one, matched on the rarest spots a pair must share,
and compared with the bounds that the lengths imply. Only distinct fingerprints enter it.

A text without any spot has one signature, the hash of all its words, so that equal texts have
equal fingerprints and likeness 1. Nulls: a null text is empty; a null id sorts first. Rows of
equal id follow each other by text. A single document is its own next one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, store, text_of
from .components import components

#: Common words of English, German, French and Spanish; a parameter of every function.
ANCHORS = (
    "a an and are as at be but by can for from had has have he her his i if in into is it its my no "
    "not of on or our she so than that the their them then there they this to was we were what when "
    "which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen "
    "einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns "
    "vom von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous "
    "ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella en es esta este fue ha hay la las lo los más me muy o para pero por que "
    "se sin sobre su sus también un una y ya"
).split()
CHAIN, THRESHOLD = 2, 0.8
WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 1_000_000


class Spotter:
    """Spot sets of texts; word hashes are kept between texts."""

    def __init__(self, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN) -> None:
        self.anchors, self.chain = frozenset(anchors), chain
        self.hashes: dict[str, int] = {}
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 1 << 63, chain + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _hash(self, word: str) -> int:
        """64 bits, the lowest one set for an anchor."""
        value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        return (value & ~1) | (word in self.anchors)

    def spots(self, text: str) -> np.ndarray:
        """Sorted distinct 32-bit spot hashes, never empty."""
        words = WORD.findall(text.lower())
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        for word in set(words):
            if word not in self.hashes:
                self.hashes[word] = self._hash(word)
        values = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        is_anchor = (values & np.uint64(1)).astype(bool)
        content = values[~is_anchor]
        at = np.flatnonzero(is_anchor)
        before = at - np.arange(len(at))  # content words before each anchor
        full = before + self.chain <= len(content)
        at, before = at[full], before[full]
        mixed = values[at] * self.factors[0]
        for k in range(self.chain):
            mixed = (mixed ^ (mixed >> np.uint64(31))) + content[before + k] * self.factors[k + 1]
        if not len(mixed):
            whole = int.from_bytes(
                hashlib.blake2b((" ".join(words) or text).encode(), digest_size=8).digest(), "big"
            )
            mixed = np.array([whole], dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def encode(spots: np.ndarray) -> str:
    """The fingerprint string: base64 of the big-endian spot hashes in ascending order."""
    return base64.b64encode(spots.astype(">u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard value of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    anchors: Sequence[str] = ANCHORS, chain: int = CHAIN,
) -> DataFrame:
    """(doc_id, fingerprint) per row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spotter = Spotter(anchors, chain)
        for batch in batches:
            prints = [encode(spotter.spots(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def compare_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    anchors: Sequence[str] = ANCHORS, chain: int = CHAIN,
) -> DataFrame:
    """Each text against an edited form of itself and against the next text by ascending id.

    Edited: the last floor(n / 2) code points replaced by the first as many of the next text (the
    first text after the last). Rows: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Documents are dealt to ranges of ids and read in order within a range; each range also gets
    the first document of the range after it. Ranges are cut at approximate quantiles of the ids.
    """
    spark = docs.sparkSession
    small_batches(spark, 64)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    edges = np.array(cuts, dtype=np.float64)

    @F.pandas_udf("int")
    def range_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype("int32"))

    order = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    dealt = rows.withColumn("range", range_of(order))
    # One row per range: its first document.
    heads = store(
        dealt.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first")), "spot-heads"
    )
    by_range, whole = Window.orderBy("range"), Window.partitionBy()
    ranges_in_order = heads.select("range").select(
        "range",
        F.coalesce(F.lag("range").over(by_range), F.max("range").over(whole)).alias("before"),
    )
    follow = heads.join(ranges_in_order, "range").select(
        F.col("before").alias("range"), "first.doc_id", "first.text", F.lit(True).alias("follows")
    )
    ordered = (
        dealt.withColumn("follows", F.lit(False))
        .unionByName(follow.select("doc_id", "text", "range", "follows"))
        .repartition("range").sortWithinPartitions("range", "follows", "doc_id", "text")
    )
    kind = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spotter, held = Spotter(anchors, chain), None
        types = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["text"]
                spots = spotter.spots(text)
                if held is not None:
                    doc_id, old, mine = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new = spotter.spots(edited)
                    out.append((
                        doc_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), encode(mine),
                        encode(new), likeness(mine, new), likeness(mine, spots),
                    ))
                held = None if row["follows"] else (row["doc_id"], text, spots)
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                [c.split()[0] for c in kind.split(", ")],
            )

    return ordered.select("doc_id", "text", "follows").mapInArrow(compare, kind)


def near_duplicates(prints: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, component_id) per row of ``prints`` (doc_id, fingerprint).

    class_id is the smallest doc_id of the same fingerprint, component_id the smallest reachable
    over pairs of likeness ``threshold`` or more.
    """
    small_batches(prints.sparkSession, 1024)

    @F.pandas_udf("array<long>")
    def unpacked(prints_):  # noqa: ANN001, ANN202
        return prints_.map(lambda p: decode(p).astype("int64"))

    classes = store(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("spots", unpacked("fingerprint")),
        "spot-classes",
    )
    often = classes.select(F.explode("spots").alias("spot")).groupBy("spot").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = (
        classes.select("node", F.size("spots").alias("size"), F.explode("spots").alias("spot"))
        .join(often.filter("n > 1"), "spot")
        .groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "spot"))).alias("shared"))
    )
    # Spots held by one set only come first in the order by rarity; they cannot match, but they
    # use up places of the prefix, which is exact.
    alone = F.col("size") - F.size("shared")
    take = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1 - alone
    band = F.floor(F.log(F.col("size").cast("double")) / np.log(1 / threshold))
    keyed = store(
        ranked.filter(take > 0).select(
            "node", "size", band.alias("band"),
            F.explode(F.slice("shared", F.lit(1), take.cast("int"))).alias("s"),
        ).select("node", "size", "band", "s.spot"),
        "spot-prefixes",
    )
    # Partners of a set lie in its own length band or in a neighbouring one.
    left = keyed.select("spot", "band", F.col("node").alias("a"), F.col("size").alias("na"))
    right = keyed.withColumn("to", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") - 1))).select(
        "spot", F.col("to").alias("band"), F.col("node").alias("b"), F.col("size").alias("nb")
    )
    pairs = left.join(right, ["spot", "band"]).filter(
        (F.col("a") < F.col("b"))
        & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    ).select("a", "b").distinct()
    sets = classes.select("node", "spots")
    common = F.size(F.array_intersect("sa", "sb"))
    links = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("spots").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("spots").alias("sb")), "b")
        .filter(common >= F.lit(threshold) * (F.size("sa") + F.size("sb") - common) - 1e-9)
        .select("a", "b")
    )
    parts = store(components(links), "spot-parts").withColumnRenamed("component", "root")
    rooted = classes.select("fingerprint", "class_id", "node").join(parts, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    names = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = rooted.join(names, "root").select("fingerprint", "class_id", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "class_id", "component_id")
