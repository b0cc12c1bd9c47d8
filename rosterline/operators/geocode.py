"""Approximate points for rows without one, each labelled with its precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOX_PAD_DEGREES, COUNTY_SOURCE, PLACE_SOURCE, STATE_SOURCE
from ..functions.display import python_title
from ..functions.places import candidate_places, normalize_place, place_keys
from ..session import by_shuffle, spread
from .frames import argmax_by, explode_rows, union_prefer

NAMES_COUNTY = r"(?i)\bcounty\b"


def place_entries(places: DataFrame) -> DataFrame:
    """Every lookup key of every gazetteer line: ``state, place, pos, area, latitude, ...``."""
    columns = ["state", "area", "latitude", "longitude", "row_id"]
    return explode_rows(spread(places, "row_id"), columns, place_keys("name"), "place", "pos")


def fill_aliases(primary: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases only serve keys that no primary name holds."""
    return union_prefer(primary, aliases, ["state", "place"])


def gazetteer(places: DataFrame) -> DataFrame:
    """``(state, place) -> latitude, longitude``; the largest area wins, the first row a tie."""
    entries = place_entries(places)

    def winners(part: DataFrame) -> DataFrame:
        return argmax_by(part.drop("pos"), ["state", "place"], "area", "row_id").select(
            "state", "place", "latitude", "longitude"
        )

    return fill_aliases(winners(entries.filter("pos = 0")), winners(entries.filter("pos > 0")))


def county_points(counties: DataFrame) -> DataFrame:
    """``(state, county) -> latitude, longitude``; the last line of a county wins."""
    named = counties.select(
        "state",
        normalize_place(F.replace("name", F.lit(" County"), F.lit(""))).alias("county"),
        "row_id",
        F.struct("latitude", "longitude").alias("point"),
    )
    return named.groupBy("state", "county").agg(F.max_by("point", "row_id").alias("point")).select(
        "state", "county", "point.*"
    )


def centroids(county: DataFrame) -> DataFrame:
    """Unweighted mean over one point per county."""
    return county.groupBy("state").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )


def bounding_boxes(county: DataFrame) -> DataFrame:
    return county.groupBy("state").agg(
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
    )


#: What a hit rests on, the strongest first.
OVERRIDE, CITY, COUNTY, STATE = range(4)


def tagged(entries: DataFrame, place: str, kind: int) -> DataFrame:
    """Part of the dictionary of names: ``_state, _place, kind, latitude, longitude``."""
    return entries.select(
        F.col("state").alias("_state"), F.col(place).alias("_place"), F.lit(kind).alias("kind"),
        "latitude", "longitude",
    )


def name_hits(df: DataFrame, dictionary: DataFrame, key: str, name: str = "name", state: str = "state") -> DataFrame:
    """``key, kind, pos, place, latitude, longitude`` of every part of a name that the dictionary knows in
    the state. County entries only serve names that say "county"."""
    keyed = df.select(key, F.upper(F.trim(state)).alias("_state"), F.col(name).alias("_name"))
    parts = explode_rows(
        keyed, [key, "_state", F.col("_name").rlike(NAMES_COUNTY).alias("_says_county")],
        candidate_places("_name", "_state"), "_place", "pos",
    )
    return parts.join(by_shuffle(dictionary), ["_state", "_place"]).filter(
        (F.col("kind") != COUNTY) | F.col("_says_county")
    ).select(key, "kind", "pos", F.col("_place").alias("place"), "latitude", "longitude")


def state_hits(df: DataFrame, states: DataFrame, key: str, state: str = "state") -> DataFrame:
    """The point of the state of every row, in the form of ``name_hits``."""
    points = states.select(F.col("state").alias("_state"), "latitude", "longitude")
    return df.select(key, F.upper(F.trim(state)).alias("_state")).join(points, "_state").select(
        key, F.lit(STATE).alias("kind"), F.lit(0).alias("pos"), F.col("_state").alias("place"), "latitude", "longitude"
    )


def best_hit(hits: DataFrame, key: str) -> DataFrame:
    """``key, hit``: the strongest kind, then the earliest part of the name."""
    rest = [c for c in hits.columns if c not in (key, "kind", "pos")]
    return hits.groupBy(key).agg(F.min(F.struct("kind", "pos", *rest)).alias("hit"))


def first_candidate_hit(df: DataFrame, places: DataFrame, key: str, name: str = "name",
                        state: str = "state") -> DataFrame:
    """``(key, hit)``: the earliest candidate of the name that the gazetteer knows in the state."""
    return best_hit(name_hits(df, tagged(places, "place", CITY), key, name, state), key)


def county_hit(df: DataFrame, counties: DataFrame, key: str, name: str = "name",
               state: str = "state") -> DataFrame:
    """As ``first_candidate_hit`` on counties, only for names that say "county"."""
    return best_hit(name_hits(df, tagged(counties, "county", COUNTY), key, name, state), key)


def state_hit(df: DataFrame, states: DataFrame, key: str, state: str = "state") -> DataFrame:
    return best_hit(state_hits(df, states, key, state), key)


def _located(hit: str) -> Column:
    """The published location of a hit, labelled with its precision."""
    place, kind = F.col(f"{hit}.place"), F.col(f"{hit}.kind")
    state = F.col("_state")

    def point(precision: str, matched: Column, source: str) -> Column:
        return F.struct(
            F.col(f"{hit}.latitude").alias("latitude"), F.col(f"{hit}.longitude").alias("longitude"),
            F.lit(precision).alias("precision"), matched.alias("matched_to"), F.lit(source).alias("source"),
        )

    return (
        F.when(kind == OVERRIDE, F.col(f"{hit}.manual"))
        .when(kind == CITY, point("city_centroid", F.concat(python_title(place), F.lit(", "), state), PLACE_SOURCE))
        .when(kind == COUNTY, point(
            "county_centroid", F.concat(python_title(place), F.lit(" County, "), state), COUNTY_SOURCE
        ))
        .when(kind == STATE, point("state_centroid", state, STATE_SOURCE))
    )


LOCATED = "struct<latitude:double,longitude:double,precision:string,matched_to:string,source:string>"


def geocode(
    df: DataFrame,
    places: DataFrame,
    counties: DataFrame,
    overrides: DataFrame | None = None,
    key: str = "code",
    name: str = "name",
    state: str = "state",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Add ``located``: override, then place, then county, then state, else null.

    ``places`` and ``counties`` are the tables of ``gazetteer`` and ``county_points``; together they
    are one dictionary, which the parts of the names meet in one join. Rows that have both
    coordinates, or no state, are never looked up and take part in no join. ``key`` is unique.
    """
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    state_key = F.upper(F.trim(F.coalesce(F.col(state), F.lit(""))))
    keyed = spread(df, key).withColumn("_state", F.when(missing & (state_key != ""), state_key))
    todo = keyed.filter(F.col("_state").isNotNull())

    dictionary = tagged(places, "place", CITY).unionByName(tagged(counties, "county", COUNTY))
    none = F.lit(None).cast(LOCATED).alias("manual")
    hits = name_hits(todo, dictionary, key, name, "_state").unionByName(
        state_hits(todo, centroids(counties), key, "_state")
    ).select("*", none)
    if overrides is not None:
        points = overrides.select(
            F.col("name_key").alias("_name_key"), F.col("state").alias("_state"), F.col("located").cast(LOCATED).alias("manual")
        )
        asked = todo.select(key, "_state", F.upper(F.trim(name)).alias("_name_key"))
        hits = hits.unionByName(asked.join(by_shuffle(points), ["_name_key", "_state"]).select(
            key, F.lit(OVERRIDE).alias("kind"), F.lit(0).alias("pos"), F.lit("").alias("place"),
            F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), "manual",
        ))
    found = todo.join(
        by_shuffle(best_hit(hits, key).withColumnRenamed(key, "_key")), F.col(key) == F.col("_key"), "left"
    )
    placed = found.select(*df.columns, _located("hit").alias("located"))
    rest = keyed.filter(F.col("_state").isNull()).select(*df.columns, F.lit(None).cast(LOCATED).alias("located"))
    return placed.unionByName(rest)


def outside_bounds(
    df: DataFrame, boxes: DataFrame, state: str = "state", lat: str = "latitude",
    lon: str = "longitude", pad: float = BOX_PAD_DEGREES,
) -> DataFrame:
    """Located rows with a ``placement``: ``outside`` the padded box of their state, or ``unknown``
    where the state has no box.  Rows inside, edges included, are left out."""
    boxed = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).join(
        boxes.withColumnRenamed("state", "_state"), F.upper(df[state]) == F.col("_state"), "left"
    )
    inside = F.col(lat).between(F.col("lat_min") - pad, F.col("lat_max") + pad) & F.col(lon).between(
        F.col("lon_min") - pad, F.col("lon_max") + pad
    )
    placement = F.when(F.col("_state").isNull(), "unknown").when(~inside, "outside")
    return boxed.withColumn("placement", placement).filter("placement is not null").select(
        *[df[c] for c in df.columns], "placement"
    )
