import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.operators import frames, profile
from rosterline.operators.quantiles import group_quantiles


def test_group_quantiles_match_brute_force(spark):
    rng = random.Random(7)
    rows = [("hot", rng.choice([rng.gauss(0, 50), float(rng.randint(-3, 3))])) for _ in range(30_000)]
    rows += [("b", 1.0), ("c", 4.0), ("c", 7.0), ("d", None)]
    rows += [("e", float(i % 5)) for i in range(999)]
    # One coarse bucket, far from zero, of both signs; and values of very different sizes.
    rows += [("near", 1e6 + i * 1e-3) for i in range(500)] + [("near", -1e6 - i * 1e-3) for i in range(500)]
    rows += [("wide", s * 10.0 ** e) for e in range(-300, 300, 7) for s in (-1, 1)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    qs = [0.0, 0.5, 0.9, 1.0]
    got = {r.k: r for r in group_quantiles(df, ["k"], ["v"], qs).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None:
            groups[k].append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n == len(values)
        for i, q in enumerate(qs):
            assert got[k][f"q_{i}"] == pytest.approx(np.quantile(values, q), abs=1e-9, rel=1e-12), (k, q)


def test_upper_median_takes_the_element_at_half(spark):
    for n in (1, 2, 5, 6):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "v double")
        row = group_quantiles(df, [], ["v"], [0.5], method="upper").first()
        assert row.q_0 == sorted(range(n))[n // 2]


def stays(spark, rows):
    return spark.createDataFrame(
        rows, "code string, person string, book_in string, book_out string, birth_year int, gender string, "
        "country string, amount_set double, amount_posted double",
    ).withColumns({c: F.col(c).try_cast("timestamp") for c in ("book_in", "book_out")})


def random_stays(seed=3, n=600):
    rng = random.Random(seed)
    for _ in range(n):
        start = f"2026-0{rng.randint(1, 6)}-{rng.randint(10, 28)} 0{rng.randint(0, 9)}:00:00"
        end = rng.choice([None, f"2026-07-{rng.randint(10, 28)} 00:00:00"])
        amount = rng.choice([None, float(rng.randint(1, 40) * 500)])
        yield (rng.choice(["A", "A", "A", "B", "C", "", None]), rng.choice([None, *[f"p{i}" for i in range(60)]]),
               start, end, rng.choice([None, 1900, 1950, 1980, 2000, 2015]), rng.choice(["F", "M", None]),
               rng.choice("UVWXYZ"), amount, rng.choice([None, 1.0, 2.0]))


def full_profile(spark, rows):
    derived = profile.derive_stay_columns(stays(spark, rows), "book_in", "book_out", "birth_year")
    return profile.profile(derived, "code", "person", {"gender": "gender"}, {"top": "country"},
                           "amount_set", "amount_posted", k=2)


def test_profile_matches_brute_force(spark):
    rows = list(random_stays())
    stats, cells = full_profile(spark, rows)
    got = {r.code: r for r in stats.collect()}
    long = {(r.code, r.dim, r.value): r.n for r in cells.collect()}
    assert set(got) == {"A", "B", "C"}
    for code in "ABC":
        mine = [r for r in rows if r[0] == code]
        row = got[code]
        assert row.stays_in_window == len(mine)
        lowest = {}
        for r in mine:
            if r[1] is not None and r[7] is not None:
                lowest[r[1]] = min(lowest.get(r[1], r[7]), r[7])
        people = len({r[1] for r in mine if r[1]})
        assert row.unique_people.n == people
        assert row.people_with_recorded_set.n == len(lowest)
        assert row.person_median_set == statistics.median(lowest.values())
        assert row.person_recorded_set_share == round(len(lowest) / people, 3)
        assert row.median_set == statistics.median(r[7] for r in mine if r[7] is not None)
        genders = Counter(r[5] for r in mine if r[5])
        for value, n in genders.items():
            cell = long[code, "gender", value]
            assert (cell.n, cell.suppressed) == ((n, False) if n >= 5 else (None, True))
        top = sorted(Counter(r[6] for r in mine).items(), key=lambda kv: (-kv[1], kv[0]))[:2]
        assert {v for c, d, v in long if c == code and d == "top"} == {v for v, _ in top}


def test_no_visible_small_cell_ever(spark):
    for seed in (1, 2):
        stats, cells = full_profile(spark, list(random_stays(seed, n=80)))
        assert cells.filter("n.n between 1 and 4").isEmpty()
        assert stats.filter("age_known.n between 1 and 4 or unique_people.n between 1 and 4").isEmpty()


def test_counts_of_four_and_five_around_the_threshold(spark):
    rows = [("A", f"p{i}", "2026-01-01", None, 1990, "F" if i < 4 else "M", "U", 100.0, None) for i in range(9)]
    stats, cells = full_profile(spark, rows)
    gender = {r.value: r.n for r in cells.filter("dim = 'gender'").collect()}
    assert gender["F"].suppressed and gender["M"].n == 5
    row = stats.first()
    assert row.n_completed.n == 0 and row.los_median is None and row.age_median == 36.0


def test_trailing_window_alignments(spark):
    rows = [("2026-08-01 12:00:00",), ("2025-08-01 00:00:00",), ("2025-08-01 11:59:59",), ("2025-07-31 23:59:59",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("t"))
    for kind in ("timestamp", "timestamp_ntz"):
        typed = df.select(F.col("t").cast(kind).alias("t"))
        assert frames.trailing_window(typed, "t").count() == 3
        assert frames.trailing_window(typed, "t", align="instant").count() == 1


def test_window_bound_reaches_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = frames.trailing_window(lines, "l_shipdate").select("l_suppkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,ScalarSubquery" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_windowed_profile_of_the_source_columns(spark):
    columns = ("unique_identifier string, detention_facility_code_first string, detention_facility_code_longest string, "
               "detention_facility_code_last string, stay_book_in_date_time timestamp, stay_book_out_date_time timestamp, "
               "birth_year int, gender string, citizenship_country string, stay_release_reason string, "
               "book_in_criminality string, detainee_classification string, initial_bond_set_amount_lowest_seen double, "
               "bond_posted_amount_lowest_seen double")
    from datetime import datetime

    rows = [(f"p{i}", "F", "L", "Z", datetime(2026, 1, 1 + i), datetime(2026, 2, 1 + i), 1990, "M", "X", "r", "c", "d",
             1000.0, None) for i in range(6)]
    rows.append(("old", "F", "L", "Z", datetime(2020, 1, 1), None, 1990, "M", "X", "r", "c", "d", 1000.0, None))
    events = spark.createDataFrame(rows, columns)
    for basis, code in (("longest", "L"), ("first", "F"), ("last", "Z")):
        stats, cells = profile.windowed_profile(events, basis)
        row = stats.first()
        assert (row.code, row.stays_in_window, row.los_median) == (code, 6, 31.0)
        assert {r.dim for r in cells.collect()} == {
            "age_bands", "gender", "release_reason", "book_in_criminality", "classification", "top_citizenship"}
    meta = profile.window_metadata(events, "stay_book_in_date_time").first()
    assert (meta.rows_total, meta.data_cutoff, meta.window_start) == (7, "2026-01-06", "2025-01-06")


def test_value_frequency(spark):
    df = spark.createDataFrame([("A", 5.0), ("A", 5.0), ("A", 7.0), ("A", None), ("B", 1.0)], "k string, v double")
    rows = profile.value_frequency(df, "k", "A", "v").collect()
    assert [tuple(r) for r in rows] == [(5.0, 2, 3, 5.0), (7.0, 1, 3, 5.0)]
    with pytest.raises(ValueError):
        profile.value_frequency(df, "k", "nobody", "v")
