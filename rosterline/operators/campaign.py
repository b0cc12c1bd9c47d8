"""The consent-gated campaign feed: row contract, derived status and totals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BOOKING_CATEGORIES, CAMPAIGN_ID_PATTERN, CAMPAIGN_STATUSES, IDENTIFIER_PATTERN,
    MAX_SUMMARY_CHARS,
)
from ..functions.base import blank_to_null
from ..functions.dates import public_status, strict_iso_date
from ..functions.numeric import whole_dollars
from ..functions.records import category_struct
from ..functions.text import contains_identifier, is_safe_https
from .frames import explode_rows


def _unknown_or(value: Column, broken: Column) -> Column:
    """Broken, or not readable at all."""
    return value.isNull() | broken


def _refused(good: Column) -> Column:
    """A value is refused unless it is known to be good: null breaks the rule."""
    return ~F.coalesce(good, F.lit(False))


def campaign_rules(
    as_of: date | str, identifier: str = IDENTIFIER_PATTERN
) -> list[tuple[str, str, Column]]:
    """``(field, rule, condition that breaks it)`` for every rule on a single row."""
    today = F.lit(str(as_of)).cast("date")
    goal, raised = whole_dollars("bond_amount"), whole_dollars("amount_raised")
    verified, expires = strict_iso_date("verified_on"), strict_iso_date("verification_expires_on")
    return [
        ("case_id", "format", _refused(F.col("case_id").rlike(CAMPAIGN_ID_PATTERN))),
        ("consent_confirmed", "must be TRUE", _refused(F.upper("consent_confirmed") == "TRUE")),
        ("public_summary", "contains an identifier", contains_identifier("public_summary", identifier)),
        ("public_summary", "too long", F.length("public_summary") > MAX_SUMMARY_CHARS),
        ("bond_amount", "must be a whole amount above zero", _unknown_or(goal, goal <= 0)),
        ("amount_raised", "must be a whole amount", raised.isNull()),
        ("booking_category", "unknown category", _refused(F.col("booking_category").isin(*BOOKING_CATEGORIES))),
        ("status", "unknown status", _refused(F.col("status").isin(*CAMPAIGN_STATUSES))),
        ("verified_on", "must be YYYY-MM-DD", verified.isNull()),
        ("verification_expires_on", "must be YYYY-MM-DD", expires.isNull()),
        ("verified_on", "in the future", verified > today),
        ("verification_expires_on", "before verified_on", expires < verified),
        ("contribution_url", "must be a safe https address", _refused(is_safe_https("contribution_url"))),
        ("terms_url", "must be a safe https address", _refused(is_safe_https("terms_url"))),
        ("contribution_recipient", "required", _refused(F.col("contribution_recipient") != "")),
    ]


def check_campaigns(
    df: DataFrame, as_of: date | str, identifier: str = IDENTIFIER_PATTERN
) -> DataFrame:
    """All broken rules of all rows: ``row_id, case_id, field, rule``.

    A repeated case id is reported on every row after the first.
    """
    broken = F.array(
        *[
            F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
            for field, rule, bad in campaign_rules(as_of, identifier)
        ]
    )
    per_row = explode_rows(df, ["row_id", "case_id"], broken, "b").select("row_id", "case_id", "b.*")
    first = df.groupBy("case_id").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"))
    repeats = df.join(first.filter("n > 1"), "case_id").filter("row_id > first_row").select(
        "row_id", "case_id", F.lit("case_id").alias("field"), F.lit("duplicate").alias("rule")
    )
    return per_row.unionByName(repeats)


def campaign_feed(df: DataFrame, as_of: date | str) -> DataFrame:
    """The published record of rows that passed the contract.

    An accepting case past its verification is shown as expired, and only accepting cases
    keep their contribution link.
    """
    typed = df.withColumns(
        {
            "verified_on": strict_iso_date("verified_on"),
            "verification_expires_on": strict_iso_date("verification_expires_on"),
        }
    ).withColumn("status", public_status("status", "verification_expires_on", as_of))
    return typed.select(
        "case_id",
        blank_to_null("region").alias("region"),
        whole_dollars("bond_amount").alias("bond_amount"),
        whole_dollars("amount_raised").alias("amount_raised"),
        category_struct("booking_category").alias("booking_category"),
        F.date_format("verified_on", "yyyy-MM-dd").alias("verified_on"),
        F.date_format("verification_expires_on", "yyyy-MM-dd").alias("verification_expires_on"),
        blank_to_null("public_summary").alias("public_summary"),
        F.when(F.col("status") == "accepting", F.col("contribution_url")).alias("contribution_url"),
        "contribution_recipient",
        "terms_url",
        "status",
    )


def order_feed(feed: DataFrame) -> DataFrame:
    """Open cases first, then by id."""
    return feed.orderBy(F.col("status") != "accepting", "case_id")


def feed_totals(feed: DataFrame) -> DataFrame:
    """Open cases with the sums of their goals and of what was raised."""
    return feed.filter(F.col("status") == "accepting").agg(
        F.count(F.lit(1)).alias("open_cases"),
        F.coalesce(F.sum("bond_amount"), F.lit(0)).alias("total_goal"),
        F.coalesce(F.sum("amount_raised"), F.lit(0)).alias("total_raised"),
    )
