import pytest

from rosterline.functions import text


@pytest.mark.parametrize(
    "name, expected",
    [
        ("North  Hold/Room #2 (annex)", "SYNTH-NORTH-HOLD-ROOM-2-ANNEX"),
        (None, "SYNTH-UNKNOWN"),
        ("x" * 60, "SYNTH-" + "X" * 40),
    ],
)
def test_slug_key(one, name, expected):
    assert one(text.slug_key, name) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("The Lake Co. Det. Ctr. (North)", ["LAKE", "COUNTY", "DETENTION", "CENTER", "NORTH"]),
        ("Dept of Corr", ["CORRECTIONAL"]),
        ("Peñasco-Río", ["PEÑASCO", "RÍO"]),
        ("  ", []),
        (None, []),
    ],
)
def test_normalize_tokens(one, name, expected):
    assert one(text.normalize_tokens, name) == expected


def test_normal_name_and_distinct_tokens(one):
    assert one(text.normalize_name, "the Lake lake CTR") == "LAKE LAKE CENTER"
    assert one(text.distinct_tokens, "Lake lake ctr Center") == ["LAKE", "CENTER"]


@pytest.mark.parametrize(
    "value, expected",
    [("07001", "07001"), ("7001", "07001"), ("78118-1234", "78118"), ("n/a", None), (None, None)],
)
def test_zip5(one, value, expected):
    assert one(text.zip5, value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Case A123456789 needs support.", True),
        ("case a-12345678", True),
        ("A 123456789", True),
        ("A1234567", False),
        ("A1234567890", False),
        ("XA123456789", False),
    ],
)
def test_contains_identifier(one, value, expected):
    assert one(text.contains_identifier, value) is expected


@pytest.mark.parametrize(
    "url, safe",
    [
        ("https://fund.example/terms", True),
        ("HTTPS://fund.example", True),
        ("http://fund.example", False),
        ("https:///path", False),
        ("https://user@fund.example", False),
        ("https://user:pw@fund.example/x", False),
        ("https://:pw@fund.example/x", False),
        ("https://fund.example/@me", True),
        ("", False),
        (None, False),
    ],
)
def test_is_safe_https(one, url, safe):
    assert one(text.is_safe_https, url) is safe


def test_matches_text_skips_empty_fields(one):
    assert one(lambda a, b, c: text.matches_text(" lake TX ", a, b, c), "Lake", "", "TX") is True
    assert one(lambda a, b, c: text.matches_text("lake  tx", a, b, c), "Lake", "", "TX") is False
    assert one(lambda a: text.matches_text("  ", a), "anything") is True
    assert one(lambda a, b: text.matches_text("x", a, b), None, None) is False
