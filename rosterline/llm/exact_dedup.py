"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

The first pass counts rows by text length and hash of a short prefix. Keys held by one row only
are settled there: that text has no copy. The surviving keys are folded into a bit filter of fixed
size (``filter_bits``), which is broadcast, so the second pass hashes full content only where a
copy is still possible, without moving any text. A bit shared by two keys costs one needless hash
and never a wrong result. Full hashes are grouped with map-side combination; groups are joined
back by key on narrow rows, where adaptive execution splits the partition of a hot group.

Nulls: a null text equals the empty text; a null id loses against every id. Ties: among rows of
equal text and equal largest id exactly one stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, maybe_in, store, text_of

PREFIX_CHARS = 64
FILTER_BITS = 1 << 24


def _refined(
    docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, filter_bits: int
) -> DataFrame:
    """Rows (_row, _id, _text, _digest); _digest is null where no other row can be equal."""
    keyed = docs.select(
        F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text")
    ).select(
        "*",
        F.octet_length("_text").alias("_length"),
        F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("_head"),
    )
    counts = store(
        keyed.groupBy("_length", "_head").agg(F.count(F.lit(1)).alias("n")), "dedup-keys"
    )
    by_length = counts.groupBy("_length").agg(F.sum("n").alias("n_length")).filter("n_length > 1")
    open_keys = counts.join(by_length, "_length").filter("n > 1")
    words = bit_filter(open_keys, ["_length", "_head"], filter_bits)
    marked = maybe_in(keyed, ["_length", "_head"], words, filter_bits)
    return marked.select(
        "_row", "_id", "_text", F.when(F.col("_maybe"), F.sha2(F.col("_text"), 256)).alias("_digest")
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    prefix_chars: int = PREFIX_CHARS,
    filter_bits: int = FILTER_BITS,
    every_digest: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null for texts that have no copy unless ``every_digest`` is set.
    """
    refined = _refined(docs, id_col, text_col, prefix_chars, filter_bits)
    shown = F.coalesce("_digest", F.sha2(F.col("_text"), 256)) if every_digest else F.col("_digest")
    rows = store(
        refined.select(
            "_id",
            "_digest",
            shown.alias("text_sha256"),
            F.monotonically_increasing_id().alias("_uid"),
        ),
        "dedup-rows",
    )
    single = rows.filter(F.col("_digest").isNull()).select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    tested = rows.filter(F.col("_digest").isNotNull())
    # Stored, so that the join has plain exchanges on both sides and a hot group can be split.
    groups = store(
        tested.groupBy("_digest").agg(
            F.max(F.struct("_id", "_uid")).alias("top"), F.count(F.lit(1)).alias("group_size")
        ),
        "dedup-groups",
    )
    grouped = tested.join(groups, "_digest").select(
        F.col("_id").alias(id_col),
        F.col("top._id").alias("keep_id"),
        "group_size",
        (F.col("_uid") == F.col("top._uid")).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies; of equal texts the row with the largest id stays."""
    rows = store(
        _refined(docs, id_col, text_col, PREFIX_CHARS, FILTER_BITS).select(
            "_row", "_id", "_digest", F.monotonically_increasing_id().alias("_uid")
        ),
        "dedup-docs",
    )
    tested = rows.filter(F.col("_digest").isNotNull())
    winners = tested.groupBy("_digest").agg(F.max(F.struct("_id", "_uid")).alias("top"))
    kept = tested.join(winners.select(F.col("top._uid").alias("_uid")), "_uid", "left_semi")
    return rows.filter(F.col("_digest").isNull()).unionByName(kept).select("_row.*")
