import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rosterline.functions.numeric import suppress
from rosterline.operators import assemble as asm
from rosterline.operators import checks, frames, serve
from rosterline.sources import load_release, provenance, publish, read_published, split_placed, write_features
from rosterline.sources.sinks import current_version

PAIRS = "code string, ours double, theirs double, peak double"


def pairs(spark, rows):
    return spark.createDataFrame([(f"c{i}", *r) for i, r in enumerate(rows)], PAIRS)


def test_pearson_is_nan_when_undefined(spark):
    def value(rows):
        df = spark.createDataFrame(rows, "x double, y double")
        return df.agg(checks.pearson(F.col("x"), F.col("y"))).first()[0]

    assert math.isnan(value([(1.0, 2.0), (2.0, 3.0)]))
    assert math.isnan(value([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)]))
    assert value([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == pytest.approx(1.0)


def test_agreement_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.0, rng.uniform(1, 90), None]), rng.choice([0.0, rng.uniform(1, 90)]), 1.0) for _ in range(200)]
    got = checks.agreement(pairs(spark, rows)).first()
    good = [(x, y) for x, y, _ in rows if x and y and x > 0 and y > 0]
    ratios = sorted(y / x for x, y in good)
    assert got.n == len(good)
    assert got.correlation == pytest.approx(statistics.correlation(*zip(*good)))
    assert got.median_ratio == pytest.approx(ratios[len(ratios) // 2])
    ends = checks.divergent_ratios(pairs(spark, rows)).collect()
    assert sorted(r.ratio for r in ends) == pytest.approx(ratios[:3] + ratios[-3:])


def test_extremes_overlap_in_small_tables(spark):
    ends = checks.divergent_ratios(pairs(spark, [(1.0, 2.0, 1.0), (1.0, 3.0, 1.0)])).collect()
    assert [r.end for r in ends].count("low") == 2 and len(ends) == 4


def test_within_share_short_form(spark):
    row = checks.within_share(pairs(spark, [(0.0, 5.0, 1.0), (None, 5.0, 1.0)])).first()
    assert tuple(row) == (0, None, None, None)
    row = checks.within_share(pairs(spark, [(10.0, 5.0, 1.0), (10.0, 4.9, 1.0), (1.0, 1.0, 1.0)])).first()
    assert (row.n, row.within) == (3, 2)


def test_strict_total_drops_rows_with_gaps(spark):
    listing = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0, None), (2, 9.0, 9.0, 9.0, 9.0)],
        "l_id long, `Male Crim` double, `Male Non-Crim` double, `Female Crim` double, `Female Non-Crim` double")
    registry = spark.createDataFrame([("A", 2.0, 1.0), ("B", 2.0, 1.0)], "code string, "
                                     "average_daily_population_last_year double, max_daily_population_last_year double")
    matches = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "l_id long, code string")
    found = checks.population_pairs(matches, listing, registry)
    assert {r.code: r.theirs for r in found.collect()} == {"A": None, "B": 36.0}
    assert [r.code for r in checks.stale_rows(found).collect()] == ["B"]


def test_match_rate_and_collision_gates(spark):
    schema = "l_id long, l_name string, state string, code string, method string, score double"
    good = [(i, f"n{i}", "TX", f"c{i}", "exact-name", None) for i in range(19)]
    at_floor = spark.createDataFrame([*good, (19, "open", "TX", None, "unmatched", None)], schema)
    checks.enforce({"rate": checks.check_match_rate(at_floor), "collisions": checks.check_collisions(at_floor)})
    below = spark.createDataFrame([*good[:10], (19, "open", "TX", None, "unmatched", None)], schema)
    with pytest.raises(checks.GateFailure, match="open"):
        checks.enforce({"rate": checks.check_match_rate(below)})
    twice = spark.createDataFrame([*good, (19, "copy", "TX", "c3", "fuzzy", 0.9)], schema)
    with pytest.raises(checks.GateFailure, match="copy"):
        checks.enforce({"collisions": checks.check_collisions(twice)})


def test_skipped_check_fails_only_in_strict_mode(spark):
    checks.enforce({"late": None}, strict=False)
    with pytest.raises(checks.GateFailure, match="skipped"):
        checks.enforce({"late": None})


def test_all_violations_are_written(spark, tmp_path):
    rows = spark.range(50).selectExpr("'rule' AS rule", "cast(id AS string) AS key", "'late' AS detail")
    report = str(tmp_path / "failures")
    with pytest.raises(checks.GateFailure, match="all are in .*two_words") as failure:
        checks.enforce({"two words": rows, "clean": rows.limit(0)}, report=report)
    assert str(failure.value).count("'late'") == 5
    assert spark.read.parquet(f"{report}/two_words").count() == 50
    assert not (tmp_path / "failures" / "clean").exists()


def test_profile_gate(spark):
    stats = spark.createDataFrame([("A", 3, 2.0), ("B", 9, -1.0), ("C", 7, 5.0), ("D", 2, None)], "code string, n long, m double")
    stats = stats.select("code", suppress("n").alias("n_set"), F.col("m").alias("median_set"))
    cells = spark.createDataFrame([("C", "gender", "F", 3)], "code string, dim string, value string, n long")
    raw = cells.select("code", "dim", "value", suppress("n", 1).alias("n"))
    found = checks.check_profiles(stats, raw, counts=["n_set"], medians={"median_set": "n_set"})
    assert {(r.rule, r.key) for r in found.collect()} == {
        ("small_cell", "C"), ("median_without_sample", "A"), ("negative_median", "B")}
    hidden = cells.select("code", "dim", "value", suppress("n").alias("n"))
    clean = stats.filter("code in ('C', 'D')")
    assert checks.check_profiles(clean, hidden, counts=["n_set"], medians={"median_set": "n_set"}).isEmpty()


def small_release(spark):
    registry = spark.createDataFrame(
        [("A", "Lake Jail", "TX", 30.0, -97.0, 12.5, 20.0), ("B", "Hill Jail", "TX", None, None, None, 5.0),
         ("C", "Moon", "ZZ", None, None, 0.0, 0.0)],
        "code string, name string, state string, latitude double, longitude double, "
        "average_daily_population_last_year double, max_daily_population_last_year double")
    listing = spark.createDataFrame(
        [(1, 1.0, None, 2.25, None, "Pass", 30.0), (2, None, None, None, None, None, None)],
        "l_id long, `Male Crim` double, `Male Non-Crim` double, `Female Crim` double, `Female Non-Crim` double, "
        "`Last Final Rating` string, `FY26 ALOS` double").withColumn("Mandatory", F.lit(1.0))
    matches = spark.createDataFrame([(1, "B"), (2, "A")], "l_id long, code string")
    attached = asm.attach_attributes(registry, matches, listing)
    stats = spark.createDataFrame([("A", 9)], "code string, stays_in_window long")
    for c in ("age_known", "n_completed", "n_set", "n_posted", "unique_people", "people_with_recorded_set"):
        stats = stats.withColumn(c, suppress(F.lit(3)))
    for c in ("age_median", "los_median", "los_p90", "median_set", "median_posted", "person_median_set", "person_recorded_set_share"):
        stats = stats.withColumn(c, F.lit(3.0))
    cells = spark.createDataFrame([("A", "gender", "F", 3), ("A", "gender", "M", 6)], "code string, dim string, value string, n long")
    cells = cells.withColumn("n", suppress("n"))
    with_profiles = asm.attach_profiles(attached, asm.profile_records(stats, cells))
    return registry, attached, asm.assemble(with_profiles, {"registry": {"source": "reg", "as_of": "2026-08-01"}})


def test_assembled_release_round_trip(spark, tmp_path):
    registry, attached, records = small_release(spark)
    placed, unplaced = split_placed(records)
    assert {r.code for r in placed.collect()} == {"A"} and {r.code for r in unplaced.collect()} == {"B", "C"}
    assert checks.check_build(placed, unplaced, registry).isEmpty()
    path = str(tmp_path / "release")
    write_features(records, path, provenance(registry, "reg", as_of="2026-08-01"))
    lines = spark.read.text(path + "/features")
    docs = {json.loads(r.value)["properties"]["code"]: json.loads(r.value) for r in lines.collect()}
    a, b = docs["A"]["properties"], docs["B"]["properties"]
    assert docs["A"]["geometry"] == {"type": "Point", "coordinates": [-97.0, 30.0]}
    assert a["demographics"]["gender"] == {"F": {"suppressed": True, "lt": 5}, "M": 6}
    assert a["demographics"]["stays_in_window"] == 9 and b["demographics"] is None
    assert a["directions_url"] == "geo:30.0,-97.0?q=30.0,-97.0" and a["location_precision"] == "exact"
    assert b["population"]["ice_fy_adp_total"] == 3.25 and a["population"]["ice_fy_adp_total"] is None
    assert b["avg_length_of_stay_days"] == 30.0 and b["adp"] is None and docs["C"]["properties"]["adp"] == 0.0
    assert not docs["C"]["properties"]["has_ice_attributes"] and b["has_ice_attributes"]
    assert b["population"]["ddp_figure_stale"] is None

    assert checks.check_shipped_suppression(spark, path).isEmpty()
    assert checks.records_checked(lines).first().facilities_checked == 1
    expected = checks.expected_population(attached)
    fields = [c for c in expected.columns if c != "code"]
    assert checks.check_fidelity(checks.shipped_population(lines), expected, fields).isEmpty()
    flat = {r.code: r for r in load_release(spark, path).collect()}
    assert flat["B"].last_rating == "Pass" and flat["A"].as_of == "2026-08-01" and flat["C"].adp == 0.0


def test_stale_figure_is_flagged(spark):
    registry = spark.createDataFrame([("A", 0.2, 1234.0)], "code string, average_daily_population_last_year double, "
                                     "max_daily_population_last_year double")
    registry = registry.withColumn("attributes", F.struct(F.lit(2000.0).alias("Male Crim")))
    note = asm.assemble(registry).first().properties.population.ddp_figure_stale
    assert "held at most 1,234," in note


def test_shipped_small_cell_is_found_with_its_path(spark):
    doc = {"properties": {"code": "A", "demographics": {
        "stays_in_window": 2, "suppression_threshold": 5, "age_median": 3, "age_known": 4,
        "gender": {"F": {"suppressed": True, "lt": 5}, "M": 1, "X": 0, "Y": 5},
        "bond": {"n_set": 2, "median_set": 3.0, "deep": {"x": 1}}}}}
    lines = spark.createDataFrame([(json.dumps(doc),)], "value string")
    found = {r.key for r in checks.check_suppression(lines).collect()}
    assert found == {"A.age_known", "A.gender.M", "A.bond.n_set", "A.bond.deep.x"}


def test_fidelity_reports_presence_and_values(spark):
    shipped = spark.createDataFrame([("A", 1.0), ("B", None), ("C", 2.0)], "code string, x double")
    source = spark.createDataFrame([("A", 1.5), ("B", None), ("D", 2.0)], "code string, x double")
    found = {(r.rule, r.key) for r in checks.check_fidelity(shipped, source, ["x"]).collect()}
    assert found == {("fidelity.x", "A"), ("fidelity.presence", "C"), ("fidelity.presence", "D")}


def test_publish_moves_the_pointer_only_when_gates_pass(spark, tmp_path):
    target = str(tmp_path / "site")
    assert current_version(spark, target) is None
    ids = spark.range(3)
    no_rows = {"never": lambda staged: staged["ids"].filter("id < 0")}
    first = publish(spark, {"ids": ids}, no_rows, target)
    assert current_version(spark, target) == first
    with pytest.raises(checks.GateFailure):
        publish(spark, {"ids": spark.range(9)}, {"fails": lambda staged: staged["ids"].filter("id > 7")}, target)
    assert read_published(spark, target, "ids").count() == 3
    second = publish(spark, {"ids": spark.range(4)}, no_rows, target)
    assert current_version(spark, target) == second and read_published(spark, target, "ids").count() == 4


def test_sorting_keeps_missing_last_both_ways(spark):
    df = spark.createDataFrame([("b", 2.0), ("", None), ("C", 0.0), ("a", 1.0), (None, None)], "t string, v double")
    assert [r.t for r in frames.sort_missing_last(df, "t").collect()][:3] == ["a", "b", "C"]
    assert [r.t for r in frames.sort_missing_last(df, "t", "desc").collect()][:3] == ["C", "b", "a"]
    assert [r.v for r in frames.sort_missing_last(df, "v", "desc").collect()] == [2.0, 1.0, 0.0, None, None]


def test_small_frame_operators(spark):
    df = spark.createDataFrame([("x", 1.0, 5), ("x", 1.0, 3), ("x", 0.5, 1), ("y", None, 2)], "k string, v double, i int")
    assert {(r.k, r.i) for r in frames.argmax_by(df.filter("v is not null"), ["k"], "v", "i").collect()} == {("x", 3)}
    assert {(r.k, r.v) for r in frames.first_in_order(df, ["k"], "i").collect()} == {("x", 0.5), ("y", None)}
    assert [r.i for r in frames.top_n(df, "v", "i", n=3).collect()] == [3, 5, 1]
    assert frames.duplicate_keys(df, "k").first().duplicates == 2
    nan = spark.createDataFrame([(float("nan"), "2026-01-02")], "v double, d string").select("v", F.col("d").cast("date"))
    assert tuple(frames.clean(nan).first()) == (None, "2026-01-02")


def test_display_distribution_with_suppressed_cells(spark):
    cells = spark.createDataFrame([("A", "g", "x", 3), ("A", "g", "y", 6), ("A", "g", "z", 2), ("B", "g", "x", 1)],
                                  "code string, dim string, value string, n long").withColumn("n", suppress("n"))
    rows = {(r.code, r.value): r.share for r in serve.display_distribution(cells, ["code", "dim"], limit=2).collect()}
    assert rows == {("A", "y"): 1.0, ("A", "x"): 0.0, ("B", "x"): 0.0}


def test_filter_registry_criteria(spark):
    df = spark.createDataFrame(
        [("A", "Lake", "TX", "IGSA", "Pass", 0, 1.0, 1.0), ("B", "Hill", "TX", "CDF", None, 1, 1.0, 1.0),
         ("C", "Moor", "NM", "CDF", "", 0, 1.0, 1.0), ("D", "Lake", "TX", "IGSA", "Pass", 0, None, None)],
        "code string, name string, state string, contract string, rating string, approx int, latitude double, longitude double")

    def codes(**criteria):
        found = serve.filter_registry(df, text_columns=("name", "state", "code"), **criteria)
        return "".join(sorted(r.code for r in found.collect()))

    assert codes() == "ABC" and codes(text="lake tx") == "A" and codes(state="TX") == "AB"
    assert codes(rating=serve.NO_RATING) == "BC" and codes(rating="pass") == "" and codes(rating="Pas") == "A"
    assert codes(exact_only=True) == "AC" and codes(contract="CDF", state="NM") == "C"


def test_empty_listing_fails_the_match_rate(spark):
    matches = spark.createDataFrame([], "l_name string, state string, code string")
    assert [r.detail for r in checks.check_match_rate(matches).collect()] == ["the listing is empty"]


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_small_cells_are_found_at_any_depth(spark, depth):
    cell = "3"
    for level in range(depth):
        cell = '{"k%d": %s, "big%d": 40}' % (level, cell, level)
    line = '{"properties": {"code": "A", "demographics": %s}}' % cell
    found = checks.check_suppression(spark.createDataFrame([(line,)], "value string")).collect()
    assert [r.key for r in found] == [".".join(["A", *(f"k{i}" for i in reversed(range(depth)))])]
