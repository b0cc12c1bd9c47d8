"""The registered query of every operator, and its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.session import pin_utc, shared_dir

from . import (
    bloom_lm,
    curriculum,
    exact_dedup,
    id_store,
    license_scan,
    merkle,
    packing,
    quality,
    simhash,
    spotsigs,
    suffix_dedup,
    token_counts,
    turn_repair,
)
from .common import store
from .sql import ORACLES as RECURSIVE_SQL

#: Folder of the public vocabulary files, unless the session names another.
VOCABULARIES = "/opt/tokenizers"


def vocabulary(spark: SparkSession, name: str) -> str:
    """Path of a vocabulary file; ``rosterline.tokenizers`` names their folder on the workers."""
    folder = spark.conf.get("rosterline.tokenizers", None)
    if folder is None:
        try:
            import public_tokenizers
        except ModuleNotFoundError:
            folder = VOCABULARIES
        else:
            return public_tokenizers.path(name)
    return f"{folder}/{name}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document, by the set-similarity join of its word blocks."""
    return license_scan.license_report(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), vocabulary(spark, "byte_bpe_50k.json"), end_id=1)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, by progressive refinement."""
    rows = exact_dedup.exact_duplicates(documents(spark, sf_dir), every_digest=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, the last entry of its prefix counts."""
    return token_counts.token_counts(
        documents(spark, sf_dir), vocabulary(spark, "word_bpe_49k.json"), limit=2048
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document and its training position, in training order."""
    mixed = curriculum.mix(documents(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.round("position", 6).alias("position"),
    )


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot fingerprint of every document, its edited form, and their likeness."""
    return spotsigs.compare_edits(documents(spark, sf_dir))


def op7_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written, indexed and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/llm/ids-{uuid.uuid4().hex}"
    id_store.write_ids(
        documents(spark, sf_dir), path, vocabulary(spark, "word_bpe_49k.json"), end_id=2
    )
    id_store.write_index(spark, path)
    return id_store.read_back(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the ids is held out from training."""
    described = store(quality.describe(documents(spark, sf_dir)), "quality-described")
    model = quality.fit(described, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(described, model).select(
        "doc_id",
        (quality.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    fps = store(simhash.fingerprints(documents(spark, sf_dir)), "simhash-rows")
    rows = simhash.near_duplicates(fps)
    return rows.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 400 bytes that occur twice."""
    rows = suffix_dedup.remove_repeats(documents(spark, sf_dir), length=400)
    return rows.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


def op11_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document; a seventh of the ids is held out from training."""
    return bloom_lm.language_model_scores(documents(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every damaged conversation."""
    pin_utc(spark)
    return turn_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and audit path of every document, and whether a tampered leaf still verifies."""
    return merkle.manifest(documents(spark, sf_dir), tampered=merkle.one_more_char())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_spotsigs": op6_spotsigs,
    "op7_id_store": op7_id_store,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_bloom_lm": op11_bloom_lm,
    "op12_turn_repair": op12_turn_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _sql_due_time(schedule: curriculum.Schedule) -> str:
    """SQL of the inverse integral of a schedule at ``u``."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    total, done, out = sum(areas), 0.0, "CASE WHEN u IS NULL THEN NULL"
    for area, ((t0, w0), (t1, w1)) in zip(areas, zip(schedule, schedule[1:]), strict=True):
        rest, slope = f"(u * {total}::DOUBLE - {done}::DOUBLE)", (w1 - w0) / (t1 - t0)
        root = f"sqrt(greatest(0::DOUBLE, {w0 * w0}::DOUBLE + 2 * {slope}::DOUBLE * {rest}))"
        done += area
        last = done >= total
        out += f" {'ELSE' if last else f'WHEN u <= {done / total}::DOUBLE THEN'} least({t1}::DOUBLE, "
        out += f"{t0}::DOUBLE + CASE WHEN {rest} <= 0 THEN 0 ELSE 2 * {rest} / ({w0}::DOUBLE + {root}) END)"
    return out + " END"


_TURNS = " ".join(
    f"WHEN {i} THEN {_sql_due_time(schedule)}" for i, schedule in enumerate(curriculum.SCHEDULES)
)

def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NOTICES = ", ".join(
    f"('{t.label}', {_sql_list(sorted(set(t.words)))}, {t.needed(license_scan.THRESHOLD)})"
    for t in license_scan.TEMPLATES if not t.phrase
)
_PHRASES = ", ".join(
    f"('{t.label}', {_sql_list(t.words)})" for t in license_scan.TEMPLATES if t.phrase
)

ORACLES: dict[str, str] = {
    "op1_license_scan": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents),
        b AS (SELECT uid, list_slice(words, k * 32 + 1, k * 32 + 64) AS held
              FROM (SELECT uid, words, unnest(range(0, len(words) // 32 + 1)) AS k FROM d)),
        t(label, own, need) AS (VALUES {_NOTICES}),
        m AS (SELECT uid, label, NULL::BIGINT AS start,
                     len(list_intersect(list_distinct(held), own)) / len(own)::DOUBLE AS score
              FROM b, t
              WHERE len(list_intersect(list_distinct(held), own)) >= need),
        p(label, spelled) AS (VALUES {_PHRASES}),
        s AS (SELECT uid, label, i AS start, 1.0::DOUBLE AS score
              FROM (SELECT uid, words, unnest(range(0, len(words))) AS i FROM d), p
              WHERE list_slice(words, i + 1, i + len(spelled)) = spelled),
        a AS (SELECT uid, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (start IS NOT NULL) AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
              FROM (SELECT * FROM m UNION ALL SELECT * FROM s) GROUP BY uid)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word,
               last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0) AS score
        FROM d LEFT JOIN a USING (uid)""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_mixing": rf"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
        w AS (SELECT *, [5.0::DOUBLE, 2, 1][1 + rank % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
        l AS (SELECT *, cap / w AS ratio,
                (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
              FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, rank, source_size, CASE WHEN level < ratio THEN w * (
                SELECT level FROM l WHERE level < ratio ORDER BY ratio, rank LIMIT 1) ELSE cap END AS target
              FROM l),
        p AS (SELECT d.doc_id, d.size, t.rank, t.source_size, t.target, round(t.target)::BIGINT AS goal,
                coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        k AS (SELECT *, greatest(0, least(size, goal - before)) AS first_words,
                greatest(0, least(size, goal - before - source_size)) AS second_words FROM p),
        u AS (SELECT *, (before + first_words / 2::DOUBLE) / greatest(goal, 1)::DOUBLE AS u FROM k)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (first_words + second_words)::BIGINT AS taken,
               CASE WHEN first_words > 0 THEN round(CASE rank % 3 {_TURNS} END, 6) END AS position
        FROM u""",
} | RECURSIVE_SQL
