from pyspark.sql import functions as F

from rosterline.operators.release import release_diff, release_summary

SCHEMA = ("code string, name string, city string, state string, adp double, contract_type string, company string, "
          "last_rating string, last_end_date string")


def release(spark, *rows):
    full = [
        (code, extra.get("name", "Example Facility"), "Austin", "TX", adp, extra.get("contract", "IGSA"), None,
         extra.get("rating"), None)
        for code, adp, extra in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def diff(spark, before, after):
    changes = release_diff(release(spark, *before), release(spark, *after)).collect()
    kinds = {}
    for row in sorted(changes, key=lambda r: r.code):
        kinds.setdefault(row.change_type, []).append(row)
    return kinds


def row(code, adp=None, **extra):
    return code, adp, extra


def test_added_and_removed(spark):
    got = diff(spark, [row("AAA", 100.0)], [row("BBB", 200.0)])
    assert [c.code for c in got["added"]] == ["BBB"]
    assert [c.code for c in got["removed"]] == ["AAA"]
    assert got["added"][0].label == "Example Facility (Austin, TX)"
    assert got["added"][0].detail == "new facility, 200 average daily population"


def test_swing_needs_both_floors(spark):
    assert diff(spark, [row("A", 20.0)], [row("A", 30.0)]) == {}
    assert diff(spark, [row("A", 2000.0)], [row("A", 2030.0)]) == {}
    got = diff(spark, [row("A", 200.0)], [row("A", 400.0)])
    assert got["swings"][0].detail == "up 200 (100%), 200 to 400"
    got = diff(spark, [row("A", 1500.0)], [row("A", 300.0)])
    assert got["swings"][0].detail == "down 1,200 (80%), 1,500 to 300"


def test_no_longer_published_is_not_zero(spark):
    got = diff(spark, [row("A", 500.0)], [row("A")])
    assert set(got) == {"reporting_stopped"} and "was 500" in got["reporting_stopped"][0].detail


def test_newly_published_is_not_a_rise(spark):
    assert set(diff(spark, [row("A")], [row("A", 500.0)])) == {"reporting_started"}


def test_published_zero_is_movement(spark):
    got = diff(spark, [row("A", 0.0)], [row("A", 90.0)])
    assert set(got) == {"swings"} and got["swings"][0].detail == "up 90, 0 to 90"


def test_attribute_changes(spark):
    got = diff(spark, [row("A", 100.0, rating="Pass")], [row("A", 100.0, rating="Fail", contract="CDF")])
    assert sorted(c.detail for c in got["attributes"]) == ["contract type: IGSA → CDF", "inspection rating: Pass → Fail"]
    got = diff(spark, [row("A", rating=None)], [row("A", rating="Pass")])
    assert got["attributes"][0].detail == "inspection rating: not published → Pass"


def test_unchanged_reports_nothing(spark):
    same = [row("A", 100.0, rating="Pass"), row("B")]
    assert diff(spark, same, same) == {}


def test_small_average_is_not_shown_as_zero(spark):
    got = diff(spark, [row("A", 0.49), row("B", 0.0)], [row("B", 0.0)])
    assert got["removed"][0].detail == "no longer in the release, last reported 0.5 held"


def test_added_mirrors_removed(spark):
    a, b = [row("A", 1.0), row("B")], [row("B"), row("C"), row("D", 3.0)]
    forth, back = diff(spark, a, b), diff(spark, b, a)
    assert {c.code for c in forth["added"]} == {c.code for c in back["removed"]} == {"C", "D"}
    assert {c.code for c in forth["removed"]} == {c.code for c in back["added"]} == {"A"}


def test_dates_and_sizes_are_carried_through(spark):
    before = release(spark, row("A")).withColumn("as_of", F.lit("2026-07-20"))
    after = release(spark, row("A"), row("B")).withColumn("as_of", F.lit("2026-08-03"))
    summary = release_summary(before, after, release_diff(before, after)).collect()
    assert {(r.figure, r.n, r.as_of) for r in summary} == {
        ("before", 1, "2026-07-20"), ("after", 2, "2026-08-03"), ("added", 1, None)}


def test_nameless_row_is_labelled_by_code(spark):
    got = diff(spark, [], [row("A", name="")])
    assert got["added"][0].label == "A (Austin, TX)"
    assert got["added"][0].detail == "new facility, population not reported"
