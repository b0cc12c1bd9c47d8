"""Dates, ages and durations.  ``as_of`` is always passed in; nothing reads the clock."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AGE_BANDS
from .base import as_col


def to_instant(value: Column | str) -> Column:
    """Zone-less or zoned timestamp, or text, as an instant; unreadable text is null."""
    return as_col(value).try_cast("timestamp")


def age_at(ts: Column | str, birth_year: Column | str) -> Column:
    age = F.year(as_col(ts)) - as_col(birth_year)
    return F.when(age.between(0, 120), age)


def band(value: Column | str, bands: Sequence[tuple[float, float, str]] = AGE_BANDS) -> Column:
    """Label of the first band whose inclusive bounds hold the value."""
    value = as_col(value)
    labelled = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        labelled = F.when(value.between(low, high), F.lit(label)).otherwise(labelled)
    return labelled


def duration_days(start: Column | str, end: Column | str) -> Column:
    """Fractional days; negative durations are kept, an open end gives null."""
    micros = F.unix_micros(to_instant(end)) - F.unix_micros(to_instant(start))
    return micros / F.lit(86_400_000_000.0)


def release_date(file_name: Column | str, extension: str = "xlsx") -> Column:
    """The date in ``...MMDDYYYY.<extension>``; null when absent or impossible."""
    digits = F.regexp_extract(as_col(file_name), rf"(\d{{8}})\.{extension}$", 1)
    return F.try_to_date(F.when(digits != "", digits), "MMddyyyy")


def strict_iso_date(text: Column | str) -> Column:
    """``YYYY-MM-DD`` and a real calendar day, else null."""
    col = as_col(text)
    return F.try_to_date(F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), col), "yyyy-MM-dd")


def public_status(status: Column | str, expires: Column | str, as_of: date | str) -> Column:
    status = as_col(status)
    lapsed = (status == "accepting") & (as_col(expires) < F.lit(str(as_of)).cast("date"))
    return F.when(lapsed, F.lit("verification_expired")).otherwise(status)
