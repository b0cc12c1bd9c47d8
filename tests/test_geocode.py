from rosterline.operators import geocode

PLACES = "state string, name string, area double, latitude double, longitude double, row_id long"
COUNTIES = "state string, name string, latitude double, longitude double, row_id long"
LOCATED = "struct<latitude: double, longitude: double, precision: string, matched_to: string, source: string>"


def tables(spark):
    places = spark.createDataFrame(
        [("NY", "Albany CDP", 5.0, 1.0, 1.0, 0), ("NY", "Albany city", 20.0, 2.0, 2.0, 1),
         ("NY", "Albany town", 20.0, 3.0, 3.0, 2), ("ID", "Boise City", 9.0, 4.0, 4.0, 3),
         ("ID", "Boise City-Nampa village", 99.0, 5.0, 5.0, 4), ("UT", "Salt CDP", 1.0, 6.0, 6.0, 5),
         ("UT", "Salt Lake City city", 1.0, 7.0, 7.0, 6), ("TX", "Pecos City", 1.0, 8.0, 8.0, 7),
         ("TX", "Town of Pecos", 50.0, 9.0, 9.0, 8)], PLACES)
    counties = spark.createDataFrame(
        [("ID", "Boise County", 30.0, 30.0, 0), ("ID", "Ada County", 40.0, 50.0, 1),
         ("ID", "Ada County", 41.0, 51.0, 2), ("AK", "Nome Census Area", 60.0, -160.0, 3)], COUNTIES)
    return geocode.gazetteer(places), geocode.county_points(counties)


def test_gazetteer_prefers_area_then_first_row_and_primary_names(spark):
    places, counties = tables(spark)
    got = {(r.state, r.place): r.latitude for r in places.collect()}
    assert got["NY", "albany"] == 2.0
    assert got["ID", "boise"] == 4.0
    assert got["ID", "boise city nampa"] == 5.0
    assert got["UT", "salt lake"] == 7.0
    assert got["TX", "pecos"] == 8.0
    points = {(r.state, r.county): r.latitude for r in counties.collect()}
    assert points == {("ID", "boise"): 30.0, ("ID", "ada"): 41.0, ("AK", "nome census area"): 60.0}
    centre = {r.state: (r.latitude, r.longitude) for r in geocode.centroids(counties).collect()}
    assert centre["ID"] == (35.5, 40.5)


def test_cascade(spark):
    places, counties = tables(spark)
    overrides = spark.createDataFrame(
        [("BOISE SPECIAL", "ID", (1.5, 2.5, "manual_office_code", "Boise, ID", "Hand-placed: x"))],
        f"name_key string, state string, located {LOCATED}")
    rows = [
        ("a", "Boise Hold Room", "id", None, None), ("b", "Boise County Jail", "ID", None, None),
        ("c", "Ada County Jail", "ID", None, None), ("d", "Ada Hold Room", "ID", None, None),
        ("e", "Salt Lake Hold Room (Salt)", "UT", None, None), ("f", "boise special ", " ID", None, 5.0),
        ("g", "Nowhere", "ZZ", None, None), ("h", "Boise", "", None, None), ("i", "Boise", None, None, None),
        ("j", "Boise Hold Room", "ID", 9.0, 9.0),
    ]
    df = spark.createDataFrame(rows, "code string, name string, state string, latitude double, longitude double")
    got = {r.code: r.located for r in geocode.geocode(df, places, counties, overrides).collect()}
    assert len(got) == len(rows)
    short = {k: (v.precision, v.matched_to, v.latitude) if v else None for k, v in got.items()}
    assert short == {
        "a": ("city_centroid", "Boise, ID", 4.0), "b": ("city_centroid", "Boise, ID", 4.0),
        "c": ("county_centroid", "Ada County, ID", 41.0), "d": ("state_centroid", "ID", 35.5),
        "e": ("city_centroid", "Salt, UT", 6.0), "f": ("manual_office_code", "Boise, ID", 1.5),
        "g": None, "h": None, "i": None, "j": None,
    }
    without = {r.code: r.located for r in geocode.geocode(df, places, counties).collect()}
    assert without["f"].precision == "city_centroid" and without["a"] == got["a"]


def test_single_lookups(spark):
    places, counties = tables(spark)
    df = spark.createDataFrame([("a", "Ada County Jail", "ID"), ("b", "Boise Office", "ID")], "code string, name string, state string")
    assert {r.code for r in geocode.first_candidate_hit(df, places, "code").collect()} == {"b"}
    assert {r.code for r in geocode.county_hit(df, counties, "code").collect()} == {"a"}
    assert {r.code for r in geocode.state_hit(df, geocode.centroids(counties), "code").collect()} == {"a", "b"}


def test_names_meet_one_dictionary_in_one_join(spark):
    places, counties = tables(spark)
    rows = [(f"r{i}", "Ada County Jail" if i % 2 else "Boise Hold Room", "ID" if i % 3 else None, None, None) for i in range(30)]
    df = spark.createDataFrame(rows, "code string, name string, state string, latitude double, longitude double")
    found = geocode.geocode(df, places, counties)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    by_name = [line for line in plan.splitlines() if "Join" in line and "_place" in line]
    assert len(by_name) == 1 and "Inner" in by_name[0]
    located = {r.code: r.located for r in found.collect()}
    assert len(located) == 30
    assert all((located[f"r{i}"] is None) == (i % 3 == 0) for i in range(30))
    assert located["r1"].precision == "county_centroid" and located["r2"].precision == "city_centroid"


def test_bounds_include_their_edges(spark):
    boxes = spark.createDataFrame([("TX", 10.0, 20.0, 30.0, 40.0)],
                                  "state string, lat_min double, lat_max double, lon_min double, lon_max double")
    df = spark.createDataFrame(
        [("in", "tx", 8.5, 41.5), ("out", "TX", 8.4, 35.0), ("none", "GU", 1.0, 1.0), ("null", "TX", None, 1.0)],
        "code string, state string, latitude double, longitude double")
    got = {r.code: r.placement for r in geocode.outside_bounds(df, boxes).collect()}
    assert got == {"out": "outside", "none": "unknown"}
