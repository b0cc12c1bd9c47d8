"""Scans.  Readers stay lazy unless they must look at a header or check a key."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import as_col
from ..functions.dates import release_date
from ..functions.text import slug_key
from ..operators.frames import drop_nan
from ..session import broadcast_if_few, cut_lineage

FEATURE_SCHEMA = """
    type string,
    geometry struct<type: string, coordinates: array<double>>,
    properties struct<
        code: string, name: string, city: string, state: string, adp: double,
        operator: struct<contract_type: string, company: string>,
        inspection: struct<last_rating: string, last_end_date: string>>
"""
COLLECTION_SCHEMA = f"""
    metadata struct<sources: array<struct<source: string, as_of: string>>>,
    features array<struct<{FEATURE_SCHEMA.replace("type string", "type: string", 1)
                           .replace("geometry struct", "geometry: struct", 1)
                           .replace("properties struct", "properties: struct", 1)}>>
"""
RELEASE_COLUMNS = (
    "code", "name", "city", "state", "adp", "contract_type", "company", "last_rating",
    "last_end_date",
)


def load_registry(
    spark: SparkSession,
    path: str,
    key: str = "detention_facility_code",
    name: str = "name",
    check: bool = True,
    order: str | None = None,
) -> DataFrame:
    """One row per entity.  A missing key is made from the name; a repeated key is an error.

    ``order`` names a column for the place of the row in source order: by file, then by row.
    """
    raw = spark.read.parquet(path)
    if order is not None:
        placed = raw.withColumn(order, source_order()).orderBy(order)
        raw = placed.withColumn(order, F.monotonically_increasing_id())
    keyed = drop_nan(raw.drop("geometry")).withColumn(key, F.coalesce(F.col(key), slug_key(name)))
    if check:
        repeated = keyed.groupBy(key).count().filter("count > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"duplicate {key}: " + ", ".join(str(r[0]) for r in repeated))
    return keyed


def load_events(
    spark: SparkSession, path: str, columns: Sequence[str], timestamps: Sequence[str] = ()
) -> DataFrame:
    """Only the named columns.  Text timestamps are parsed leniently; unreadable ones are null."""
    df = spark.read.parquet(path).select(*columns)
    for column in timestamps:
        if isinstance(df.schema[column].dataType, T.StringType):
            df = df.withColumn(column, F.col(column).try_cast("timestamp"))
    return drop_nan(df)


def _cells(line: str, sep: str) -> Column:
    """The trimmed cells of a delimited line, quotes taken off."""
    outside = re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    plain = F.transform(
        F.split(line, outside, -1), lambda c: F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1")
    )
    return F.transform(plain, lambda c: F.trim(F.replace(c, F.lit('""'), F.lit('"'))))


def read_located_header(
    spark: SparkSession,
    path: str,
    required: Sequence[str],
    probe: int = 25,
    not_null: str = "Name",
    sep: str = ",",
) -> DataFrame:
    """Delimited text whose header sits somewhere in the first ``probe`` lines of each file.

    The header is the first line whose trimmed, lower-cased cells hold all ``required``
    names.  Where it lies is a table of one row per file, joined on the file; only the one header
    that all files share reaches the driver.  Files may be split.  Quoted line breaks are not supported.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    first_lines = Window.partitionBy("file").orderBy("line")
    cells = _cells("value", sep)
    names = F.transform(cells, F.lower)
    heads = (
        lines.filter("block = 0")
        .withColumn("position", F.row_number().over(first_lines))
        .filter(F.col("position") <= probe)
        .withColumn("is_header", F.forall(
            F.array(*[F.lit(r.strip().lower()) for r in required]), lambda r: F.array_contains(names, r)
        ))
        .groupBy("file")
        .agg(F.min(F.when(F.col("is_header"), F.struct(F.col("line").alias("line"), cells.alias("cells")))).alias("head"))
    )
    heads = cut_lineage(heads)
    missing = [r.file for r in heads.filter("head is null").select("file").limit(5).collect()]
    found = heads.filter("head is not null")
    headers = found.select("head.cells").distinct().limit(2).collect()
    if missing or not headers:
        wanted = sorted(r.strip().lower() for r in required)
        raise ValueError(f"no header with {wanted} in the first {probe} lines: {missing or path}")
    if len(headers) > 1:
        raise ValueError("files disagree on their header; read them one by one")
    columns = tuple(headers[0].cells)
    ddl = ", ".join(f"`{c or f'_{i}'}` string" for i, c in enumerate(columns))
    starts = broadcast_if_few(found.select("file", F.col("head.line").alias("header_line")))
    body = lines.join(starts, "file").filter(
        (F.col("block") > 0) | (F.col("line") > F.col("header_line"))
    )
    parsed = body.select(F.from_csv("value", ddl, {"sep": sep}).alias("row"))
    return parsed.select("row.*").filter(F.col(f"`{not_null}`").isNotNull())


def source_order() -> Column:
    """A row id in source order: by file, place of the split in the file, and row of the split.

    The plain running id follows the order in which splits are packed, largest file first.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )


def _read_table(spark: SparkSession, path: str, sep: str, quote: str = '"') -> DataFrame:
    """Text table with trimmed column names, all columns as text, and a row number."""
    df = spark.read.csv(path, header=True, sep=sep, quote=quote, escape=quote or None)
    names = [F.col(f"`{c}`").alias(c.strip()) for c in df.columns]
    return df.select(*names, source_order().alias("row_id"))


def load_places(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer lines with readable coordinates: state, name, area, latitude, longitude, row_id."""
    raw = _read_table(spark, path, sep="\t", quote="")
    area = F.coalesce(F.trim(F.col("ALAND")), F.lit(""))
    return raw.select(
        F.upper(F.trim("USPS")).alias("state"),
        F.col("NAME").alias("name"),
        F.when(area == "", F.lit(0.0)).otherwise(area.try_cast("double")).alias("area"),
        F.trim("INTPTLAT").try_cast("double").alias("latitude"),
        F.trim("INTPTLONG").try_cast("double").alias("longitude"),
        "row_id",
    ).dropna(subset=["area", "latitude", "longitude"])


def load_counties(spark: SparkSession, path: str) -> DataFrame:
    """County lines with readable coordinates: state, name, latitude, longitude, row_id."""
    raw = _read_table(spark, path, sep="\t", quote="")
    return raw.select(
        F.upper(F.trim("USPS")).alias("state"),
        F.col("NAME").alias("name"),
        F.trim("INTPTLAT").try_cast("double").alias("latitude"),
        F.trim("INTPTLONG").try_cast("double").alias("longitude"),
        "row_id",
    ).dropna(subset=["latitude", "longitude"])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _upper_key(column: Column | str) -> Column:
    return F.upper(F.trim(as_col(column)))


def load_key_overrides(
    spark: SparkSession, path: str, name: str = "ice_name", code: str = "detention_facility_code"
) -> DataFrame:
    """Human decisions ``(name_key, state) -> code``; the last line of a key wins.

    Lines without a code are ignored and a missing file is an empty table.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "name_key string, state string, code string")
    raw = _read_table(spark, path, sep=",").select(
        _upper_key(name).alias("name_key"),
        _upper_key("state").alias("state"),
        F.trim(code).alias("code"),
        "row_id",
    )
    return (
        raw.filter(F.col("code") != "")
        .groupBy("name_key", "state")
        .agg(F.max_by("code", "row_id").alias("code"))
    )


def load_location_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Hand-placed points ``(name_key, state) -> located``; unreadable coordinates are skipped."""
    located = "struct<latitude: double, longitude: double, precision: string, matched_to: string, source: string>"
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"name_key string, state string, located {located}")
    raw = _read_table(spark, path, sep=",")
    raw = raw.withColumns(
        {
            "latitude": F.col("latitude").try_cast("double"),
            "longitude": F.col("longitude").try_cast("double"),
        }
    ).dropna(subset=["latitude", "longitude"])
    point = F.struct(
        "latitude",
        "longitude",
        F.coalesce(F.col("precision"), F.lit("manual")).alias("precision"),
        F.coalesce(F.col("matched_to"), F.lit("")).alias("matched_to"),
        F.concat(
            F.lit("Hand-placed: "), F.trim(F.coalesce(F.col("evidence"), F.lit("")))
        ).alias("source"),
    )
    return (
        raw.select(
            _upper_key("name").alias("name_key"),
            _upper_key("state").alias("state"),
            point.alias("located"),
            "row_id",
        )
        .groupBy("name_key", "state")
        .agg(F.max_by("located", "row_id").alias("located"))
    )


def read_contract_csv(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """A CSV whose header must equal ``fields`` exactly, in order.

    Blank lines are skipped and every value is trimmed; an absent value is empty text.
    """
    df = spark.read.csv(path, header=True, escape='"', enforceSchema=False)
    if tuple(df.columns) != tuple(fields):
        raise ValueError("columns must exactly match: " + ", ".join(fields))
    trimmed = df.select(
        source_order().alias("row_id"),
        *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields],
    )
    return trimmed.filter(F.concat(*[F.col(c) for c in fields]) != "")


def release_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` by name only; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name")
    )


def newest_release(
    files: DataFrame, extension: str = "xlsx", name: str = "file_name", by: str = "date"
) -> DataFrame:
    """The file with the latest date in its name; undated files are ignored.

    ``by="name"`` is the simpler rule for sources whose names sort by themselves.
    """
    if by == "name":
        return files.orderBy(F.col(name).desc()).limit(1)
    dated = files.withColumn("release_date", release_date(name, extension))
    return (
        dated.filter(F.col("release_date").isNotNull())
        .orderBy(F.col("release_date").desc(), F.col(name))
        .limit(1)
    )


def load_release(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """A published release as flat rows; the last feature of a code wins.

    ``lines`` is one feature per line, as written by ``write_features`` and splittable.
    ``collection`` is a single document per file, for small releases from elsewhere.
    """
    if form == "lines":
        rows = spark.read.schema(FEATURE_SCHEMA).json(path + "/features").select(
            "properties", source_order().alias("row_id")
        )
        meta = spark.read.schema("sources array<struct<source: string, as_of: string>>").json(
            path + "/metadata"
        )
        as_of = meta.select(F.try_element_at("sources", F.lit(1))["as_of"]).scalar()
        rows = rows.withColumn("as_of", as_of)
    elif form == "collection":
        whole = spark.read.schema(COLLECTION_SCHEMA).json(path, multiLine=True)
        rows = whole.select(
            F.explode("features.properties").alias("properties"),
            F.try_element_at("metadata.sources", F.lit(1))["as_of"].alias("as_of"),
            source_order().alias("row_id"),
        )
    else:
        raise ValueError(f"unknown release form {form!r}")
    flat = rows.select(
        "row_id",
        F.col("properties.code").alias("code"),
        F.struct(
            "properties.name", "properties.city", "properties.state", "properties.adp",
            "properties.operator.contract_type", "properties.operator.company",
            "properties.inspection.last_rating", "properties.inspection.last_end_date", "as_of",
        ).alias("row"),
    ).filter(F.coalesce(F.col("code"), F.lit("")) != "")
    return flat.groupBy("code").agg(F.max_by("row", "row_id").alias("row")).select("code", "row.*")
