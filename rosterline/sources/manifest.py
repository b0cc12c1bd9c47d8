"""File manifests: what every source consisted of when a publication was built.

A file is known by path, length and modification time; only files whose entry differs from the last
manifest are read and fingerprinted, row by row and split over tasks like any other scan. Fingerprints of
files add up to those of their source, so nothing depends on how a source is cut into files. An entry
also has the address and the publication date of its source, and the inputs of a build stand beside
the files, one entry each.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .contract import fingerprint_figures
from .readers import path_exists

MANIFEST = (
    "source string, path string, length bigint, modified bigint, rows bigint, fingerprint string, "
    "url string, published string, hashed boolean"
)
INPUT = "input:"


@dataclass(frozen=True)
class Source:
    """Where a source lies, how its files are read, and what its publisher says about it."""

    path: str | None
    form: str = "text"
    columns: tuple[str, ...] = ()
    url: str | None = None
    published: str | None = None


def file_list(spark: SparkSession, sources: Mapping[str, Source]) -> DataFrame:
    """``source, path, uri, length, modified, url, published`` of every file; contents are not read."""
    none = "source string, path string, uri string, length bigint, modified bigint, url string, published string"
    parts = [spark.createDataFrame([], none)]
    for name, source in sources.items():
        if source.path is None or not path_exists(spark, source.path):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source.path)
        parts.append(files.select(
            F.lit(name).alias("source"), "path", F.col("_metadata.file_path").alias("uri"), "length",
            F.unix_micros("modificationTime").alias("modified"),
            F.lit(source.url).cast("string").alias("url"), F.lit(source.published).cast("string").alias("published"),
        ))
    return reduce(DataFrame.unionByName, parts)


def _file_fingerprints(spark: SparkSession, source: Source, paths: list[str]) -> DataFrame:
    """``uri, rows, fingerprint`` of the given files of a source."""
    rows = spark.read.format(source.form).load(paths)
    columns = list(source.columns) or rows.columns
    kept = rows.select(F.col("_metadata.file_path").alias("uri"), F.struct(*[f"`{c}`" for c in columns]).alias("row"))
    return kept.groupBy("uri").agg(*fingerprint_figures(columns, prefix="row."))


def file_manifest(
    spark: SparkSession,
    sources: Mapping[str, Source],
    known: DataFrame | None = None,
    inputs: Mapping[str, object] | None = None,
) -> DataFrame:
    """The manifest of ``sources`` and ``inputs``, fingerprints of files that ``known`` has taken from there.

    ``hashed`` tells which files were read. Only the paths of those reach the driver, as in every scan.
    """
    files = cut_lineage(file_list(spark, sources))
    if known is None:
        known = spark.createDataFrame([], MANIFEST)
    same = ["source", "path", "length", "modified"]
    kept = files.join(known.select(*same, "rows", "fingerprint"), same).withColumn("hashed", F.lit(False))
    fresh = files.join(known.select(*same), same, "left_anti")
    paths: dict[str, list[str]] = {}
    for row in fresh.select("source", "path").collect():
        paths.setdefault(row.source, []).append(row.path)
    read = [spark.createDataFrame([], "uri string, rows bigint, fingerprint string")]
    read += [_file_fingerprints(spark, sources[name], found) for name, found in sorted(paths.items())]
    hashed = fresh.join(reduce(DataFrame.unionByName, read), "uri", "left").withColumns({
        "rows": F.coalesce("rows", F.lit(0)), "fingerprint": F.coalesce("fingerprint", F.lit("0")),
        "hashed": F.lit(True),
    })
    given = spark.createDataFrame([(INPUT + k, str(v)) for k, v in (inputs or {}).items()], "source string, value string")
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    none = F.lit(None)
    entries = given.select(
        "source", F.lit("").alias("path"), none.cast("bigint").alias("length"), none.cast("bigint").alias("modified"),
        none.cast("bigint").alias("rows"), F.xxhash64("value").cast("string").alias("fingerprint"),
        none.cast("string").alias("url"), none.cast("string").alias("published"), F.lit(False).alias("hashed"),
    )
    return kept.select(*columns).unionByName(hashed.select(*columns)).unionByName(entries)


def source_states(manifest: DataFrame) -> DataFrame:
    """``source, rows, fingerprint, url, published``: the files of a source added up."""
    total = F.sum(F.col("fingerprint").cast("decimal(38,0)"))
    return manifest.groupBy("source").agg(
        F.sum("rows").alias("rows"), total.cast("string").alias("fingerprint"),
        F.max("url").alias("url"), F.max("published").alias("published"),
    )
