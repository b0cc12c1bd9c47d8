import math

import pytest
from pyspark.sql import functions as F

from rosterline.constants import NOT_REPORTED
from rosterline.functions import dates, display, numeric, records


def test_suppression_hides_one_to_four(spark):
    rows = spark.range(7).select(numeric.suppress("id").alias("c")).select("c.*").collect()
    assert [r.n for r in rows] == [0, None, None, None, None, 5, 6]
    assert [r.suppressed for r in rows] == [False, True, True, True, True, False, False]
    assert [r.lt for r in rows] == [None, 5, 5, 5, 5, None, None]


def test_totals_treat_missing_parts_differently(spark):
    df = spark.createDataFrame(
        [(1.25, 2.0), (None, 2.0), (None, None), (0.0, None)], "a double, b double"
    )
    rows = df.select(
        numeric.total_skip_null("a", "b").alias("loose"), numeric.total_strict("a", "b").alias("strict")
    ).collect()
    assert [r.loose for r in rows] == [3.25, 2.0, None, 0.0]
    assert [r.strict for r in rows] == [3.25, None, None, None]


def test_gated_ratio(spark):
    df = spark.createDataFrame([(4, 10), (5, 4), (5, 10), (6, 9)], "a int, b int")
    assert [r[0] for r in df.select(numeric.gated_ratio("a", "b")).collect()] == [None, None, 0.5, 0.667]


def test_haversine_known_distance(one):
    miles = one(numeric.haversine_miles, 0.0, 0.0, 0.0, 90.0,
                schema="a double, b double, c double, d double")
    assert math.isclose(miles, 3958.8 * math.pi / 2, rel_tol=1e-12)


@pytest.mark.parametrize(
    "value, web, report",
    [
        (None, NOT_REPORTED, NOT_REPORTED), (0.0, "0", "0"), (0.05, "0.05", "0.050"),
        (0.004, "0.004", "0.004"), (0.49, "0.5", "0.5"), (3.0, "3.0", "3.0"), (12.34, "12.3", "12"),
        (1234.5, "1,234.5", "1,234"), (float("nan"), NOT_REPORTED, NOT_REPORTED),
    ],
)
def test_display_avg(one, value, web, report):
    assert one(display.display_avg, value, schema="a double") == web
    assert one(lambda a: display.display_avg(a, "report"), value, schema="a double") == report


def test_funding_progress(spark):
    df = spark.createDataFrame([(1000, 250), (1000, 1500), (200, 1), (8, 1)], "g int, r int")
    rows = df.select(numeric.funding_progress("g", "r").alias("p")).select("p.*").collect()
    assert [tuple(r) for r in rows] == [(750, 25), (0, 100), (199, 1), (7, 13)]


def test_is_stale(spark):
    df = spark.createDataFrame(
        [(10.0, 5.0), (10.0, 0.0), (10.0, None), (None, 5.0), (0.0, 5.0), (5.0, 5.0)], "t double, p double"
    )
    assert [r[0] for r in df.select(numeric.is_stale("t", "p")).collect()] == [True] + [False] * 5


@pytest.mark.parametrize(
    "text, amount", [("7500", 7500), ("0", 0), ("-1", None), ("7.5", None), ("x", None), ("", None), ("1_000", None)]
)
def test_whole_dollars(one, text, amount):
    assert one(numeric.whole_dollars, text) == amount


def test_age_and_bands(spark):
    df = spark.createDataFrame(
        [("2026-01-05", y) for y in (2027, 2026, 2009, 2008, 1961, 1906, 1905, None)], "d string, y int"
    ).withColumn("ts", F.col("d").cast("timestamp"))
    rows = df.select(dates.age_at("ts", "y").alias("a")).select("a", dates.band("a").alias("b")).collect()
    assert [tuple(r) for r in rows] == [
        (None, None), (0, "0-17"), (17, "0-17"), (18, "18-24"), (65, "65+"), (120, "65+"), (None, None), (None, None),
    ]


def test_duration_keeps_sign_and_open_ends(spark):
    df = spark.createDataFrame(
        [("2026-01-01 00:00:00", "2026-01-02 12:00:00"), ("2026-01-02", "2026-01-01"),
         ("2026-01-01", None), ("2026-01-01", "soon")], "a string, b string",
    )
    assert [r[0] for r in df.select(dates.duration_days("a", "b")).collect()] == [1.5, -1.0, None, None]


@pytest.mark.parametrize(
    "name, expected",
    [("FY26_stats07202026.xlsx", "2026-07-20"), ("FY26_stats13012026.xlsx", None), ("stats.xlsx", None),
     ("FY26_stats07202026.csv", None)],
)
def test_release_date(one, name, expected):
    assert one(lambda a: dates.release_date(a).cast("string"), name) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("2026-08-01", "2026-08-01"), ("2026-02-30", None), ("20260801", None), ("2026-8-1", None), ("", None)],
)
def test_strict_iso_date(one, text, expected):
    assert one(lambda a: dates.strict_iso_date(a).cast("string"), text) == expected


def test_public_status(spark):
    df = spark.createDataFrame(
        [("accepting", "2026-07-31"), ("accepting", "2026-08-01"), ("funded", "2026-07-01")], "s string, e string"
    )
    shown = dates.public_status("s", F.col("e").cast("date"), "2026-08-01")
    assert [r[0] for r in df.select(shown).collect()] == ["verification_expired", "accepting", "funded"]


@pytest.mark.parametrize(
    "text, expected",
    [("ICE HOLD ROOM", "ICE Hold Room"), ("o'fallon SALT-LAKE", "O'Fallon Salt-Lake"), ("us marshals", "US Marshals"),
     ("ice_box 3rd", "Ice_box 3rd")],
)
def test_title_case(one, text, expected):
    assert one(display.title_case, text) == expected


def test_python_title(one):
    for text in ("salt lake city", "3rd ward", "o'fallon x-y"):
        assert one(display.python_title, text) == text.title()


def test_code_label(one):
    assert one(display.code_label, "BOP") == "Federal Bureau of Prisons"
    assert one(display.code_label, "NEW") == "NEW"
    assert one(display.code_label, None) == one(display.code_label, "") == NOT_REPORTED


@pytest.mark.parametrize(
    "rating, klass, paint",
    [("Fail", "fail", "fail"), ("FAILED, was pass", "fail", "none"), ("Meets Standard", "pass", "none"),
     ("Pass", "pass", "pass"), ("pending", "none", "none"), (None, "none", "none")],
)
def test_rating(one, rating, klass, paint):
    assert one(display.rating_class, rating) == klass
    assert one(display.rating_paint, rating) == paint


def test_geo_uri_needs_both(one):
    schema = "a double, b double"
    assert one(records.geo_uri, 1.5, -2.0, schema=schema) == "geo:1.5,-2.0?q=1.5,-2.0"
    assert one(records.geo_uri, 1.5, None, schema=schema) is None


def test_category_struct(one):
    known = one(records.category_struct, "not_reported")
    assert (known.code, known.label) == ("not_reported", "Not reported")
    assert one(records.category_struct, "other").label is None


def test_location_fields(spark):
    located = "struct<latitude: double, longitude: double, precision: string, matched_to: string, source: string>"
    df = spark.createDataFrame(
        [(1.0, 2.0, None), (None, 2.0, (5.0, 6.0, "city_centroid", "Austin, TX", "gaz")),
         (None, None, (5.0, 6.0, "manual", "There", "hand")), (None, None, None)],
        f"lat double, lon double, located {located}",
    )
    rows = df.select(records.location_fields("lat", "lon", "located").alias("p")).select("p.*").collect()
    assert [r.location_precision for r in rows] == ["exact", "city_centroid", "manual", "none"]
    assert [r.latitude for r in rows] == [1.0, 5.0, 5.0, None]
    assert rows[0].location_note is None and "Austin, TX" in rows[1].location_note
    assert "centre of There" in rows[2].location_note and rows[3].location_note
    assert [r.approx for r in rows] == [0, 1, 1, 1]
