import pytest

from rosterline.functions import places


@pytest.mark.parametrize(
    "name, expected",
    [("Indianapolis city ", "Indianapolis"), ("Juneau city and borough", "Juneau"), ("Foo town city", "Foo"),
     ("City", "City"), ("Boise City", "Boise"), ("Townville", "Townville")],
)
def test_strip_designator(one, name, expected):
    assert one(places.strip_designator, name) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Indianapolis city (balance)", ["indianapolis"]),
        ("Nashville-Davidson metropolitan government (balance)", ["nashville davidson", "nashville"]),
        ("Boise City", ["boise"]),
        ("Carson City (x) CDP", ["carson"]),
        ("Pecos City-Reeves CDP", ["pecos city reeves", "pecos"]),
        ("Town of Pecos City", ["town of pecos", "pecos"]),
        ("Town of City of Rome", ["town of city of rome", "city of rome", "rome"]),
        ("()", []),
    ],
)
def test_place_keys(one, name, expected):
    assert one(places.place_keys, name) == expected


@pytest.mark.parametrize(
    "name, state, expected",
    [
        ("Austin Detention and Removal Operations Hold Room", "TX", ["austin"]),
        ("Athens, TX Hold Room", "TX", ["athens"]),
        ("ERO Hold Room (Springfield MO)", "MO", ["springfield"]),
        ("South Texas/Pearsall Hold Room", "TX",
         ["south texas pearsall", "south texas", "texas pearsall", "south", "texas", "pearsall"]),
        ("TX Hold Room", "TX", ["tx"]),
        ("Hold Room", "TX", []),
        (None, "TX", []),
    ],
)
def test_candidate_places(one, name, state, expected):
    assert one(places.candidate_places, name, state) == expected


def test_normalize_place(one):
    assert one(places.normalize_place, "  St. Mary's\tPARISH é ") == "st mary s parish"
