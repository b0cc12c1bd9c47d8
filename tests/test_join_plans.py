"""Tables that grow with the input are joined by shuffle, and rows are spread before they multiply."""

import pytest

from rosterline.operators import assemble, frames, geocode, linkage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    """Rows read from files: Spark reckons such a table by the size of the files, as it does real ones."""
    count = iter(range(99))

    def write(rows, kind):
        path = str(tmp_path / f"t{next(count)}")
        spark.createDataFrame(rows, kind).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture
def sides(table):
    listing = table(
        [(1, "Alpha North Site", "TX", "1"), (2, "Beta South Site", "TX", "2")], "l_id long, name string, state string, zip string"
    )
    registry = table(
        [("A", "Alpha North Site", "TX", "1", 1), ("B", "Beta East Site", "TX", "2", 2), ("C", "Gamma Site", "TX", "2", 3)],
        "code string, name string, state string, zip string, r_order long",
    )
    return listing, registry


@pytest.mark.parametrize("link", [
    linkage.link_key_token, linkage.link_exact, linkage.link_containment, linkage.link_strict_winner,
    lambda left, right: linkage.link_fuzzy(left, right, method="levenshtein"),
    lambda left, right: linkage.link_fuzzy(left, right, method="difflib"),
])
def test_links_do_not_broadcast_names(sides, link):
    left, right = linkage.prepare(*sides, max_df=0.9)
    # Only the chunk counts of long posting lists and the bare states are broadcast, after a count.
    text = plan(link(left, right))
    joins = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftOuter" in line for line in joins), text
    assert "SortMergeJoin" in text


def test_overrides_and_reports_do_not_broadcast(table, sides):
    left, right = linkage.prepare(*sides, max_df=0.9)
    overrides = table([("ALPHA NORTH SITE", "TX", "A")], "name_key string, state string, code string")
    found = linkage.link_override(left, overrides)
    assert "BroadcastHashJoin" not in plan(found)
    assert [(r.l_id, r.code) for r in found.collect()] == [(1, "A")]
    matches = table([(1, "x", "A", "m"), (2, "y", "A", "m")], "l_id long, l_name string, code string, method string")
    assert "BroadcastHashJoin" not in plan(linkage.collisions(matches))
    assert "BroadcastHashJoin" not in plan(linkage.weak_matches(matches, sides[1]))


def test_prepared_sides_are_spread(table, sides):
    listing, registry = sides
    left, right = linkage.prepare(listing.coalesce(1), registry.coalesce(1), keep=False)
    for side in (left, right):
        assert "hashpartitioning" in plan(side)


def test_geocode_broadcasts_states_only(table):
    rows = table(
        [(1, "Austin Annex", "TX", None, None)], "code long, name string, state string, latitude double, longitude double"
    )
    places = table(
        [("TX", "Austin city", 1.0, 30.0, -97.0, 1)],
        "state string, name string, area double, latitude double, longitude double, row_id long",
    )
    counties = table(
        [("TX", "Travis County", 30.0, -98.0, 1)], "state string, name string, latitude double, longitude double, row_id long"
    )
    overrides = table([], f"name_key string, state string, located {geocode.LOCATED}")
    placed = geocode.geocode(rows, geocode.gazetteer(places), geocode.county_points(counties), overrides)
    text = plan(placed)
    assert sum("BroadcastHashJoin" in line for line in text.splitlines()) <= 1, text
    assert [r.located.latitude for r in placed.collect()] == [30.0]


def test_assembly_and_fill_do_not_broadcast(table):
    registry = table([(1,), (2,)], "code long")
    matches = table([(7, 1)], "l_id long, code long")
    listing = table([(7, 3.0)], "l_id long, n double")
    whole = assemble.attach_profiles(
        assemble.attach_attributes(registry, matches, listing),
        table([(2, "d")], "code long, demographics string"),
    )
    assert "BroadcastHashJoin" not in plan(whole)
    assert {(r.code, r.attributes and r.attributes.n, r.demographics) for r in whole.collect()} == {(1, 3.0, None), (2, None, "d")}
    assert "BroadcastHashJoin" not in plan(frames.union_prefer(registry, registry, ["code"]))
