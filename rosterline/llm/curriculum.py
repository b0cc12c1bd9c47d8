"""Mixing sources to target weights with a time-varying curriculum.

Every source has a target number of words and a weight schedule over training time 0..1, given as
knots ``(time, weight)`` joined by straight lines. The integral of the schedule is the share of the
source's words that is due by a time; inverting it turns the place of a document in its source's
stream of words into a training position. Documents are range-sorted by that position.

A source's stream is its documents in a reproducible shuffled order (md5 of the id), one pass after
another. The mix takes its first ``target`` words, so a document is taken at most ``max_repeats``
times, the last one in part. Places in the stream are sums over fixed sub-streams (4,096 per
source, by the leading digits of the md5), so a hot source is summed by many tasks.

Nulls: a null source is a source of its own and ranks last; a null text has no words. Rows of equal
id are ordered by size and text hash. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, store, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Falling, level and rising; used in turn, like the weights.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
Schedule = Sequence[tuple[float, float]]


def due_time(share: Column, schedule: Schedule) -> Column:
    """The time at which ``share`` of the schedule's integral is due: its inverse integral."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    total, done, pieces = sum(areas), 0.0, []
    for area, ((t0, w0), (t1, w1)) in zip(areas, zip(schedule, schedule[1:]), strict=True):
        if area <= 0:
            continue
        rest, slope = share * total - done, (w1 - w0) / (t1 - t0)
        # Solves w0 x + slope x^2 / 2 = rest in the form that is stable for a small slope.
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest))
        step = F.when(rest <= 0, 0.0).otherwise(2 * rest / (F.lit(w0) + root))
        done += area
        pieces.append((done / total, F.least(F.lit(float(t1)), t0 + step)))
    out = pieces[-1][1]
    for upto, value in reversed(pieces[:-1]):
        out = F.when(share <= upto, value).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int
) -> DataFrame:
    """(source, rank, source_size, target) from rows (source, source_size).

    Targets are ``min(cap, level * weight)`` with one level for all: sources are capped in the
    order of ``cap / weight`` as long as the level that the others would get exceeds that ratio.
    One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    turn = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ranked = ranked.select(
        "*", weight.alias("w"), (F.col("source_size") * float(max_repeats)).alias("cap")
    ).withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    total, all_w = F.sum("source_size").over(whole) * share, F.sum("w").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        all_w - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levelled = ranked.select("*", level.alias("level")).withColumn(
        "open", F.col("level") < F.col("ratio")
    )
    common = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(whole)
    target = F.when(F.col("open"), common["level"] * F.col("w")).otherwise(F.col("cap"))
    return levelled.select("source", "rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    share: float = 1.5,
    max_repeats: int = 2,
    carry: bool = False,
) -> DataFrame:
    """One row per input row, range-sorted by training position (rows that are not taken last).

    Columns: id, source, size, source_size, target, taken, position and again (the training
    positions of the first and the second pass, null where a pass takes nothing), first_words and
    second_words (what each pass takes). ``max_repeats`` is 1 or 2. With ``carry`` the input row
    comes along as the struct ``row`` and the result is not sorted.
    """
    text = text_of(text_col)
    kept = [F.struct("*").alias("row")] if carry else []
    uid = F.monotonically_increasing_id().alias("uid")
    rows = store(
        docs.select(
            uid,
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text).alias("tie"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
            *kept,
        ).withColumn("part", F.substring("key", 1, 3)),
        "mix-rows",
    )
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(
        parts.groupBy("source").agg(F.sum("part_size").alias("source_size")),
        weights, share, max_repeats,
    )
    in_source = Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = parts.select(
        "source", "part", F.coalesce(F.sum("part_size").over(in_source), F.lit(0)).alias("start")
    )
    plan = starts.alias("s").join(
        targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))
    ).select("s.source", "s.part", "s.start", "t.rank", "t.source_size", "t.target")
    in_part = Window.partitionBy("source", "part").orderBy("key", "id", "size", "tie").rowsBetween(
        Window.unboundedPreceding, -1
    )
    narrow = rows.drop("row").withColumn("before", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    placed = narrow.alias("r").join(
        plan.alias("p"),
        F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")),
    ).select("r.*", "p.start", "p.rank", "p.source_size", "p.target")

    goal, offset = F.round("target").cast("long"), F.col("start") + F.col("before")

    def words(begin: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), goal - begin)).cast("long")

    def at(begin: Column, taken: Column) -> Column:
        middle = (begin + taken / 2) / F.greatest(goal, F.lit(1))
        turn, out = F.col("rank") % len(schedules), None
        for i, schedule in enumerate(schedules):
            when = F.when if out is None else out.when
            out = when(turn == i, due_time(middle, schedule))
        return F.when(taken > 0, out)

    passes = placed.select(
        "*", words(offset).alias("first_words"),
        words(offset + F.col("source_size")).alias("second_words"),
    )
    result = passes.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("first_words") + F.col("second_words")).alias("taken"),
        at(offset, F.col("first_words")).alias("position"),
        at(offset + F.col("source_size"), F.col("second_words")).alias("again"),
        "first_words", "second_words", *(["uid"] if carry else []),
    )
    if carry:
        return result.join(rows.select("uid", "row"), "uid").drop("uid")
    order = [F.col("position").asc_nulls_last(), F.col(id_col)]
    return result.repartitionByRange(*order).sortWithinPartitions(*order)


def first_words(text: str, words: int) -> str:
    """The text up to the end of its ``words``-th word."""
    end = 0
    for n, found in enumerate(re.finditer(WORD, text), 1):
        end = found.end()
        if n >= words:
            break
    return text[:end]


def training_order(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    length_col: str | None = None, **options,  # noqa: ANN003
) -> DataFrame:
    """The mix itself: a row of ``docs`` for every pass that takes it, range-sorted by position.

    A document that a pass takes in part (the last one of its source) is cut after the words
    taken, and ``length_col``, if named, is set to the code points that are left.
    """
    small_batches(docs.sparkSession)
    mixed = mix(docs, id_col, text_col, source_col, carry=True, **options)
    passes = mixed.select(
        "size", "row",
        F.explode(F.array(
            F.struct(F.col("position").alias("at"), F.col("first_words").alias("take")),
            F.struct(F.col("again").alias("at"), F.col("second_words").alias("take")),
        )).alias("pass"),
    ).filter("pass.take > 0")
    names = docs.columns
    kept = [F.col(f"row.`{c}`").alias(c) for c in names]
    whole = passes.filter("pass.take = size").select("pass.at", F.struct(*kept).alias("doc"))

    @F.pandas_udf("string")
    def cut(texts, takes):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([first_words(t, n) for t, n in zip(texts, takes, strict=True)], dtype=object)

    parts = passes.filter("pass.take < size").withColumn(
        "shorter", cut(text_of(f"row.{text_col}"), F.col("pass.take"))
    )
    new = {text_col: F.col("shorter")}
    if length_col is not None:
        new[length_col] = F.length("shorter").cast(docs.schema[length_col].dataType)
    changed = [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names]
    order = ["at", f"doc.{id_col}"]
    rows = whole.unionByName(parts.select("pass.at", F.struct(*changed).alias("doc")))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc.*")
