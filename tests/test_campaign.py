import pytest

from rosterline.constants import CAMPAIGN_FIELDS
from rosterline.operators import campaign
from rosterline.operators.checks import GateFailure, enforce
from rosterline.sources import read_contract_csv, write_feed

TODAY = "2026-08-01"
GOOD = {
    "case_id": "BF-Q41XZR", "region": "Ohio", "bond_amount": "4200", "amount_raised": "900",
    "booking_category": "pending_charge_reported", "verified_on": "2026-07-30",
    "verification_expires_on": "2026-08-19", "public_summary": "Family asks for help, no names.",
    "contribution_url": "https://give.example/c/17", "contribution_recipient": "Harbor Aid",
    "terms_url": "https://give.example/rules", "status": "accepting", "consent_confirmed": "TRUE",
}


def rows(spark, *changes):
    data = [(i, *[{**GOOD, **c}[f] for f in CAMPAIGN_FIELDS]) for i, c in enumerate(changes)]
    return spark.createDataFrame(data, "row_id long, " + ", ".join(f"{f} string" for f in CAMPAIGN_FIELDS))


def test_good_row_publishes_only_its_fields(spark):
    df = rows(spark, {})
    enforce({"campaigns": campaign.check_campaigns(df, TODAY)})
    feed = campaign.campaign_feed(df, TODAY)
    case = feed.first()
    assert case.bond_amount == 4200 and case.booking_category.code == "pending_charge_reported"
    assert set(feed.columns) == set(CAMPAIGN_FIELDS) - {"consent_confirmed"}


def test_expired_verification_closes_the_link(spark):
    df = rows(spark, {"verified_on": "2026-07-24", "verification_expires_on": "2026-07-31"})
    case = campaign.campaign_feed(df, TODAY).first()
    assert case.status == "verification_expired" and case.contribution_url is None


@pytest.mark.parametrize(
    "change, field",
    [
        ({"consent_confirmed": "FALSE"}, "consent_confirmed"),
        ({"public_summary": "Case A123456789 needs support."}, "public_summary"),
        ({"public_summary": "x" * 361}, "public_summary"),
        ({"case_id": "BF-abc"}, "case_id"),
        ({"bond_amount": "0"}, "bond_amount"),
        ({"bond_amount": "12.5"}, "bond_amount"),
        ({"amount_raised": "-1"}, "amount_raised"),
        ({"booking_category": "other"}, "booking_category"),
        ({"status": "closed"}, "status"),
        ({"verified_on": "2026-08-02"}, "verified_on"),
        ({"verified_on": "1 August"}, "verified_on"),
        ({"verification_expires_on": "2026-07-01"}, "verification_expires_on"),
        ({"contribution_url": "http://fund.example"}, "contribution_url"),
        ({"terms_url": "https://me:pw@fund.example"}, "terms_url"),
        ({"contribution_recipient": ""}, "contribution_recipient"),
        ({"contribution_recipient": None}, "contribution_recipient"),
        ({"consent_confirmed": None}, "consent_confirmed"),
        ({"status": None}, "status"),
        ({"booking_category": None}, "booking_category"),
        ({"case_id": None}, "case_id"),
        ({"terms_url": None}, "terms_url"),
    ],
)
def test_each_rule_is_found(spark, change, field):
    found = campaign.check_campaigns(rows(spark, change), TODAY).collect()
    assert [r.field for r in found] == [field]


def test_all_violations_of_all_rows_are_listed(spark):
    df = rows(spark, {"status": "x", "consent_confirmed": ""}, {}, {}, {"case_id": "BF-OTHER1"})
    found = {(r.row_id, r.field, r.rule) for r in campaign.check_campaigns(df, TODAY).collect()}
    assert {(i, f) for i, f, _ in found} == {(0, "status"), (0, "consent_confirmed"), (1, "case_id"), (2, "case_id")}
    with pytest.raises(GateFailure, match="consent_confirmed"):
        enforce({"campaigns": campaign.check_campaigns(df, TODAY)})


def test_contract_csv(spark, tmp_path):
    path = tmp_path / "campaigns.csv"
    line = ",".join(f'"{v}"' for v in {**GOOD, "region": ""}.values())
    path.write_text(",".join(CAMPAIGN_FIELDS) + "\n" + line.replace("4200", " 4200 ") + "\n" + "," * 12 + "\n")
    df = read_contract_csv(spark, str(path), CAMPAIGN_FIELDS)
    assert df.count() == 1 and df.first().bond_amount == "4200"
    assert campaign.campaign_feed(df, TODAY).first().region is None
    path2 = tmp_path / "swapped.csv"
    path2.write_text(",".join(reversed(CAMPAIGN_FIELDS)) + "\n")
    with pytest.raises(ValueError, match="exactly match"):
        read_contract_csv(spark, str(path2), CAMPAIGN_FIELDS)


def test_feed_order_and_totals(spark, tmp_path):
    df = rows(spark, {"case_id": "BF-000003"}, {"case_id": "BF-000001", "status": "funded"}, {"case_id": "BF-000002"})
    feed = campaign.campaign_feed(df, TODAY)
    assert [r.case_id for r in campaign.order_feed(feed).collect()] == ["BF-000002", "BF-000003", "BF-000001"]
    assert tuple(campaign.feed_totals(feed).first()) == (2, 8400, 1800)
    assert tuple(campaign.feed_totals(feed.limit(0)).first()) == (0, 0, 0)
    write_feed(feed, str(tmp_path / "feed"))
    assert spark.read.json(str(tmp_path / "feed")).count() == 3
