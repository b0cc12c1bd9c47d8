"""Totals, suppression, gated figures and distances."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_MILES, SUPPRESSION_THRESHOLD
from .base import as_col


def null_if_nan(value: Column | str) -> Column:
    """Null means not published; NaN says the same and becomes null."""
    col = as_col(value)
    return F.when(~F.isnan(col), col)


def total_skip_null(*parts: Column | str, digits: int = 2) -> Column:
    """Sum of the parts that are known; null only when none is."""
    cols = [as_col(p).cast("double") for p in parts]
    known = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), F.bround(known, digits))


def total_strict(*parts: Column | str) -> Column:
    """Sum of the parts; null when any is missing."""
    return reduce(add, [as_col(p).cast("double") for p in parts])


def suppress(count: Column | str, threshold: int = SUPPRESSION_THRESHOLD) -> Column:
    """A publishable count: ``n`` is null, and only ``lt`` is told, for 1..threshold-1."""
    n = as_col(count).cast("bigint")
    hidden = (n > 0) & (n < threshold)
    return F.struct(
        F.when(~hidden, n).alias("n"),
        F.coalesce(hidden, F.lit(False)).alias("suppressed"),
        F.when(hidden, F.lit(threshold)).alias("lt"),
    )


def gated_ratio(
    numerator: Column | str,
    denominator: Column | str,
    threshold: int = SUPPRESSION_THRESHOLD,
    digits: int = 3,
) -> Column:
    top, bottom = as_col(numerator), as_col(denominator)
    return F.when(
        (top >= threshold) & (bottom >= threshold), F.bround(F.try_divide(top, bottom), digits)
    )


def haversine_miles(
    lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str
) -> Column:
    """Straight-line distance on a sphere."""
    phi1, phi2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_phi = (phi2 - phi1) / 2
    half_lambda = F.radians(as_col(lon2) - as_col(lon1)) / 2
    chord = F.pow(F.sin(half_phi), 2) + F.pow(F.sin(half_lambda), 2) * F.cos(phi1) * F.cos(phi2)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(chord))


def funding_progress(goal: Column | str, raised: Column | str) -> Column:
    """What is still missing, and the funded share in whole percent, capped at 100."""
    goal, raised = as_col(goal), as_col(raised)
    percent = F.round(F.try_divide(raised, goal) * 100, 0)
    return F.struct(
        F.greatest(F.lit(0), goal - raised).alias("remaining"),
        F.coalesce(F.least(F.lit(100), percent.cast("int")), F.lit(0)).alias("percent"),
    )


def is_stale(total: Column | str, peak: Column | str) -> Column:
    """A newer total above the highest value ever observed in the older window."""
    total, peak = as_col(total), as_col(peak)
    return F.coalesce((total != 0) & (peak > 0) & (total > peak), F.lit(False))


def whole_dollars(text: Column | str) -> Column:
    """A non-negative whole number, else null.  Digit separators are refused."""
    amount = as_col(text).try_cast("bigint")
    return F.when(amount >= 0, amount)
