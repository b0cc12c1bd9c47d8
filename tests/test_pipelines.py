"""The whole refresh on small source files."""

import json
import shutil
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rosterline.constants import CAMPAIGN_FIELDS
from rosterline.operators.checks import GateFailure
from rosterline.operators import geocode
from rosterline.operators.release import release_diff
from rosterline.plans import pipelines
from rosterline.sources import (
    Source, changed_sources, current_version, file_manifest, load_counties, load_release, publish, published_path,
    read_published, source_states, table_fingerprint,
)
from rosterline.sources.contract import needs_build

TOWNS = ["Webb", "Karnes", "Brooks", "Polk", "Essex", "Otero", "Torrance", "Calhoun", "Pike", "Cass"]


@pytest.fixture
def paths(spark, tmp_path):
    registry = [
        (f"F{i:02d}" if i else None, f"{t} County Detention Center", "1 Road", None, t, t, "TX", f"7800{i}",
         30.0 + i if i != 3 else None, -97.0 if i != 3 else None, 100.0 + i, 150.0 + i, 365.0, None)
        for i, t in enumerate(TOWNS)
    ]
    spark.createDataFrame(
        registry,
        "detention_facility_code string, name string, address string, address_full string, city string, county string, "
        "state string, zip string, latitude double, longitude double, average_daily_population_last_year double, "
        "max_daily_population_last_year double, days_with_detentions_daily_last_year double, geometry binary",
    ).coalesce(1).write.parquet(str(tmp_path / "registry"))
    lines = ["Facilities of the year,,,,,,,,", ",,,,,,,,",
             "Name,Address,State,Zip,Male Crim,Male Non-Crim,Female Crim,Female Non-Crim,Mandatory,FY26 ALOS,Last Final Rating"]
    for i, t in enumerate(TOWNS):
        lines.append(f'"{t.upper()} CO DET CTR",1 Road,tx,7800{i},{50 + i},40,,2.5,{i},20.5,Pass')
    (tmp_path / "listing.csv").write_text("\n".join(lines) + "\n")
    start = datetime(2026, 1, 1)
    stays = []
    for n in range(120):
        code = "F01" if n % 3 else "F02"
        stays.append((f"p{n % 40}", code, code, code, str(start + timedelta(days=n)),
                      str(start + timedelta(days=n + 10 + n % 7)) if n % 5 else None, 1950 + n % 60, "FM"[n % 2], f"C{n % 9}",
                      "removed", "none", "level" if n % 50 else "rare", 500.0 * (n % 11) if n % 4 else None, None))
    spark.createDataFrame(stays, ", ".join(
        f"{c} " + ("int" if c == "birth_year" else "double" if "amount" in c else "string") for c in pipelines.STAY_COLUMNS
    )).write.parquet(str(tmp_path / "stays"))
    head = "USPS\tNAME\tALAND\tINTPTLAT\tINTPTLONG\n"
    (tmp_path / "places.txt").write_text(head + "TX\tPolk city\t10\t30.7\t-94.9\n")
    (tmp_path / "counties.txt").write_text(head + "TX\tTravis County\t1\t30\t-97\nTX\tHarris County\t1\t29\t-95\n")
    (tmp_path / "keys.csv").write_text("ice_name,state,detention_facility_code,evidence\n")
    (tmp_path / "points.csv").write_text("name,state,latitude,longitude,precision,matched_to,evidence\n")
    good = ["BF-Q41XZR", "Ohio", "4200", "900", "not_reported", "2026-08-01", "2026-08-08", "Anonymous.",
            "https://fund.example/a", "Harbor Aid", "https://give.example/rules", "accepting", "TRUE"]
    (tmp_path / "campaigns.csv").write_text(",".join(CAMPAIGN_FIELDS) + "\n" + ",".join(good) + "\n")
    names = {"registry": "registry", "listing": "listing.csv", "stays": "stays", "places": "places.txt",
             "counties": "counties.txt", "key_overrides": "keys.csv", "location_overrides": "points.csv",
             "campaigns": "campaigns.csv"}
    return pipelines.SourcePaths(**{k: str(tmp_path / v) for k, v in names.items()})


FLOORS = pipelines.RowFloors(5, 5, 50)


def test_refresh_publishes_once_and_reacts_to_changes(spark, paths, tmp_path):
    target = str(tmp_path / "site")
    with pytest.raises(ValueError, match="at least"):
        pipelines.refresh(spark, paths, target, "2026-08-01")
    first = pipelines.refresh(spark, paths, target, "2026-08-01", floors=FLOORS)
    assert first == current_version(spark, target)
    docs = {r.code: json.loads(r.value)["properties"] for r in read_published(spark, target, "features").collect()}
    assert len(docs) == 10 and "SYNTH-WEBB-COUNTY-DETENTION-CENTER" in docs
    one = docs["F01"]
    assert one["adp"] == 101.0 and one["population"]["ice_fy_adp_total"] == 93.5
    assert one["demographics"]["stays_in_window"] == 80 and one["demographics"]["window_end"] == "2026-04-30"
    assert one["demographics"]["classification"]["rare"] == {"suppressed": True, "lt": 5}
    assert docs["F03"]["location_precision"] == "city_centroid" and docs["F03"]["location_matched_to"] == "Polk, TX"
    report = {(r.section, r.figure): r.value for r in read_published(spark, target, "report").collect()}
    assert report["counts", "with_ice_attributes"] == 10 and report["methods", "exact-name"] == 10
    assert report["counts", "approximate_location"] == 1 and report["crosswalk", "rate"] == 1.0
    assert read_published(spark, target, "feed").first().status == "accepting"
    assert read_published(spark, target, "unmatched").isEmpty()
    assert read_published(spark, target, "window").first().asDict()["data_cutoff"] == "2026-04-30"
    release = {r.code: r for r in load_release(spark, published_path(spark, target, "release")).collect()}
    assert len(release) == 10 and release["F01"].adp == 101.0 and release["F01"].as_of == "2026-08-01"

    assert pipelines.refresh(spark, paths, target, "2026-08-01", floors=FLOORS) is None
    with open(paths.key_overrides, "a") as handle:
        handle.write('"WEBB CO DET CTR",TX,F01,wrong on purpose\n')
    with pytest.raises(GateFailure, match="collisions"):
        pipelines.refresh(spark, paths, target, "2026-08-01", floors=FLOORS)
    assert current_version(spark, target) == first


def test_two_publications_are_read_and_compared(spark, paths, tmp_path):
    target = str(tmp_path / "site")
    pipelines.refresh(spark, paths, target, "2026-08-01", floors=FLOORS)
    before = load_release(spark, published_path(spark, target, "release"))
    rows = spark.read.parquet(paths.registry).collect()
    schema = spark.read.parquet(paths.registry).schema
    changed = [r.asDict() | {"average_daily_population_last_year": 500.0} if r.name.startswith("Brooks") else r.asDict()
               for r in rows if not r.name.startswith("Cass")]
    moved = str(tmp_path / "registry-2")
    spark.createDataFrame(changed, schema).coalesce(1).write.parquet(moved)
    listing = open(paths.listing).read().splitlines()
    with open(paths.listing, "w") as handle:
        handle.write("\n".join(x for x in listing if "CASS" not in x) + "\n")
    second = pipelines.refresh(spark, replace(paths, registry=moved), target, "2026-08-08", floors=FLOORS)
    assert second == current_version(spark, target)
    after = load_release(spark, published_path(spark, target, "release"))
    found = {(r.code, r.change_type) for r in release_diff(before, after).collect()}
    assert {c for c, kind in found if kind == "removed"} == {"F09"}
    assert any(c == "F02" for c, _ in found)
    # A publication that lost a part is not readable, and the next refresh builds it again.
    shutil.rmtree(published_path(spark, target, "matches"))
    with pytest.raises(ValueError, match="not whole"):
        read_published(spark, target, "features")
    third = pipelines.refresh(spark, replace(paths, registry=moved), target, "2026-08-08", floors=FLOORS)
    assert third not in (None, second) and read_published(spark, target, "matches").count() == 9


def test_files_altered_after_staging_are_refused(spark, tmp_path):
    target = str(tmp_path / "site")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int")

    def tampering(staged):
        folder = staged["rows"].inputFiles()[0].rsplit("/", 1)[0]
        spark.createDataFrame([("c", 3)], "code string, n int").write.mode("append").parquet(folder)
        return staged["rows"].filter("n < 0")

    with pytest.raises(GateFailure, match="staged_file_altered"):
        publish(spark, {"rows": rows}, {"odd": tampering}, target)
    assert current_version(spark, target) is None
    version = publish(spark, {"rows": rows}, {}, target)
    assert current_version(spark, target) == version and read_published(spark, target, "rows").count() == 2


def test_manifest_reads_only_files_that_differ(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        for i in range(n):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"part {i}.csv").write_text("".join(f"{name},{i},{k}\n" for k in range(5)))
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    sources = {
        "a": Source(str(tmp_path / "a"), url="https://x/a"), "b": Source(str(tmp_path / "b"), published="2026-01-01"),
        "t": Source(str(tmp_path / "t"), "parquet"), "gone": Source(None), "lost": Source(str(tmp_path / "no")),
    }
    first = file_manifest(spark, sources, None, {"as_of": "2026-08-01"}).cache()
    assert first.filter("hashed").count() == 7 and first.count() == 8
    states = {r.source: r for r in source_states(first).collect()}
    assert states["a"].rows == 15 and states["t"].rows == 10 and set(states) == {"a", "b", "t", "input:as_of"}
    assert states["t"].fingerprint == table_fingerprint(spark.read.parquet(str(tmp_path / "t"))).first().fingerprint
    again = file_manifest(spark, sources, first, {"as_of": "2026-08-01"})
    assert again.filter("hashed").isEmpty()
    assert not needs_build(source_states(first), source_states(again))

    (tmp_path / "a" / "part 1.csv").write_text("other\n")
    moved = sources | {"b": Source(str(tmp_path / "b"), url="https://x/b", published="2026-02-01")}
    third = file_manifest(spark, moved, first, {"as_of": "2026-08-02"}).cache()
    assert [r.path.rsplit("/", 1)[1] for r in third.filter("hashed").collect()] == ["part 1.csv"]
    changes = {r.source: (r.state, r.reasons) for r in changed_sources(source_states(first), source_states(third)).collect()}
    assert changes == {
        "a": ("changed", "content"), "b": ("changed", "url,published"), "t": ("unchanged", ""),
        "input:as_of": ("changed", "content"),
    }


def test_cross_checks_report(spark, paths):
    registry = pipelines.load_registry(spark, paths.registry, 5)
    listing = pipelines.load_listing(spark, paths.listing, 5)
    overrides = spark.createDataFrame([], "name_key string, state string, code string")
    matches = pipelines.link(listing, registry, overrides)
    stats, _, _ = pipelines.profile_stays(pipelines.load_stays(spark, paths.stays, 50))
    complete = listing.withColumn("Female Crim", F.lit(10.0))
    counties = geocode.county_points(load_counties(spark, paths.counties))
    found = pipelines.cross_checks(matches, complete, registry, stats, counties)
    assert found["population"].first().n == 10 and found["population"].first().correlation > 0.99
    assert found["stay length"].first().n == 2 and found["orphans"].isEmpty()
    # In ten names every token is generic, so no pair rests on a distinctive one.
    assert found["weak matches"].count() == 10
    assert found["stale"].isEmpty() and found["divergent"].count() == 6
    assert {r.code for r in found["outside state"].collect()} == {"F02", "F04", "F05", "F06", "F07", "F08", "F09"}
    assert pipelines.cross_checks(matches, listing, registry, stats, counties)["population"].first().n == 0
