"""Sinks.  Each writes from the executors; nothing is gathered into one document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import enforce
from .contract import changed_sources, fingerprint_table


def split_placed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a point and rows without one; every row is in exactly one of the two."""
    has_point = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.filter(has_point), df.filter(~has_point)


def feature_lines(df: DataFrame) -> DataFrame:
    """``code, value``: every row as the text of a map feature, nulls written out; no point, no geometry."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    feature = F.struct(
        F.lit("Feature").alias("type"), F.when(placed, point).alias("geometry"), "properties"
    )
    return df.select("code", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_features(df: DataFrame, path: str, sources: DataFrame | None = None) -> None:
    """One map feature per line under ``path/features``, build metadata under ``path/metadata``.

    ``df`` has code, latitude, longitude and a struct ``properties``.
    """
    feature_lines(df).select("value").write.mode("errorifexists").text(path + "/features")
    if sources is not None:
        meta = sources.agg(F.collect_list(F.struct(*sources.columns)).alias("sources"))
        meta.write.mode("errorifexists").json(path + "/metadata")


def write_profiles(stats: DataFrame, cells: DataFrame, path: str) -> None:
    """Wide figures per entity and long value counts, as two parquet tables."""
    stats.write.mode("errorifexists").parquet(path + "/stats")
    cells.write.mode("errorifexists").partitionBy("dim").parquet(path + "/cells")


def write_diff(changes: DataFrame, path: str) -> None:
    """Changes as JSON lines, one folder per kind of change."""
    changes.write.mode("errorifexists").partitionBy("change_type").json(path)


def write_feed(feed: DataFrame, path: str) -> None:
    """The campaign feed in reading order: open cases first, then by id."""
    ordered = feed.orderBy(F.col("status") != "accepting", "case_id")
    ordered.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def publish(
    spark: SparkSession,
    outputs: Mapping[str, DataFrame],
    gates: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]],
    target: str,
    files: Mapping[str, Callable[[Mapping[str, DataFrame], str], DataFrame]] | None = None,
) -> str:
    """Stage every output, run every gate on the staged files, then write the manifest and the pointer.

    ``files`` writes further forms of the staged tables below a path and returns what can be reread from
    there. A gate takes the staged tables and returns its violations; those of a failed gate are all written
    to ``failures/<version>`` of the target. All staged files are fingerprinted
    when they are written and once more after the gates: a file that was altered in between is refused. The
    manifest is written last, and readers follow the pointer log to versions that have one, so a failed or
    interrupted run is never visible. Returns the new version.
    """
    version = uuid.uuid4().hex
    root = f"{target}/versions/{version}"
    staged: dict[str, DataFrame] = {}
    for name, df in outputs.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
        staged[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
    for name, write in (files or {}).items():
        staged[name] = write(staged, f"{root}/{name}")
    written = spark.createDataFrame(fingerprint_table(staged).collect(), OUTPUTS)
    enforce({
        **{name: gate(staged) for name, gate in gates.items()},
        "staged files": check_staged(staged, written),
    }, report=f"{target}/failures/{version}")
    written.coalesce(1).write.parquet(f"{root}/{MANIFEST_NAME}")
    pointer = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at")
    )
    pointer.write.mode("append").parquet(f"{target}/pointer")
    return version


#: Name of the table that is written last; outputs may not have it.
MANIFEST_NAME = "outputs"
OUTPUTS = "source string, rows bigint, fingerprint string"


def check_staged(staged: Mapping[str, DataFrame], written: DataFrame) -> DataFrame:
    """Staged tables that are no longer what was written; the files are listed and read again."""
    again = {name: _reread(df) for name, df in staged.items()}
    changes = changed_sources(written, fingerprint_table(again)).filter("state <> 'unchanged'")
    return changes.select(
        F.lit("staged_file_altered").alias("rule"), F.col("source").alias("key"), F.col("reasons").alias("detail")
    )


def _reread(df: DataFrame) -> DataFrame:
    """The same files, listed anew."""
    folders = sorted({path.rsplit("/", 1)[0] for path in df.inputFiles()})
    form = "text" if df.columns == ["value"] else "parquet"
    if not folders:
        return df
    return df.sparkSession.read.format(form).schema(df.schema).load(folders)


def current_version(spark: SparkSession, target: str) -> str | None:
    """The version published last, or None before the first publication."""
    from .readers import path_exists

    if not path_exists(spark, f"{target}/pointer"):
        return None
    log = spark.read.parquet(f"{target}/pointer")
    row = log.agg(F.max_by("version", "published_at").alias("version")).first()
    return row.version


def is_whole(spark: SparkSession, target: str, version: str) -> bool:
    """Whether a version has its manifest and every output that the manifest names."""
    from .readers import path_exists

    root = f"{target}/versions/{version}"
    if not path_exists(spark, f"{root}/{MANIFEST_NAME}"):
        return False
    names = spark.read.schema(OUTPUTS).parquet(f"{root}/{MANIFEST_NAME}").select("source").collect()
    return all(path_exists(spark, f"{root}/{r.source}") for r in names)


def published_path(spark: SparkSession, target: str, name: str) -> str:
    """Where an output of the current version lies; the version must be whole."""
    version = current_version(spark, target)
    if version is None:
        raise ValueError(f"nothing is published under {target}")
    if not is_whole(spark, target, version):
        raise ValueError(f"version {version} under {target} is not whole")
    return f"{target}/versions/{version}/{name}"


def read_published(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(published_path(spark, target, name))
