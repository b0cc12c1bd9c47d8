"""Labels and figures as they are shown; rounding happens only here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CONTRACT_LABELS, NOT_REPORTED, RATING_FAIL_PATTERN, RATING_PASS_PATTERN, TITLE_ACRONYMS,
)
from .base import as_col, literal_map


def _capitalise_runs(text: Column, word_class: str) -> Column:
    """Upper-case each a-z letter that no character of ``word_class`` precedes."""
    pieces = F.split(F.lower(text), f"(?<![{word_class}])(?=[a-z])")
    raised = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
        ).otherwise(p),
    )
    return F.array_join(raised, "")


def title_case(text: Column | str, acronyms: Sequence[str] = TITLE_ACRONYMS) -> Column:
    """Words capitalised, with the given acronyms put back in capitals."""
    shown = _capitalise_runs(as_col(text), "a-z0-9_")
    for word in acronyms:
        edge = f"(?<![A-Za-z0-9_]){word.capitalize()}(?![A-Za-z0-9_])"
        shown = F.regexp_replace(shown, edge, word)
    return shown


def python_title(text: Column | str) -> Column:
    """Every run of ASCII letters capitalised, also after a digit or an apostrophe."""
    return _capitalise_runs(as_col(text), "a-z")


def code_label(code: Column | str, labels: Mapping[str, str] = CONTRACT_LABELS) -> Column:
    """The label of a code; unknown codes pass through, missing ones say so."""
    code = as_col(code)
    known = F.coalesce(F.try_element_at(literal_map(labels), code), code)
    return F.when(code.isNull() | (code == ""), F.lit(NOT_REPORTED)).otherwise(known)


def rating_class(rating: Column | str) -> Column:
    """pass / fail / none by wording in any case; failure is looked for first."""
    rating = as_col(rating)
    return (
        F.when(rating.rlike("(?i)" + RATING_FAIL_PATTERN), "fail")
        .when(rating.rlike("(?i)" + RATING_PASS_PATTERN), "pass")
        .otherwise("none")
    )


def rating_paint(rating: Column | str) -> Column:
    """The stricter rule of the map colours: exact-case ``Fail`` and ``Pass`` only."""
    rating = as_col(rating)
    return (
        F.when(rating.contains("Fail"), "fail").when(rating.contains("Pass"), "pass").otherwise("none")
    )


def display_avg(value: Column | str, style: str = "web") -> Column:
    """An average as text; a small non-zero figure keeps three decimals.

    ``web`` shows one decimal elsewhere; ``report`` one below 10 and none from 10 on.
    """
    value = as_col(value).cast("double")
    size = F.abs(value)
    if style == "web":
        three = F.regexp_replace(F.format_number(F.round(value, 3), 3), r"\.?0+$", "")
        shown = F.when(size < 0.1, three).otherwise(F.format_number(F.round(value, 1), 1))
    elif style == "report":
        shown = (
            F.when(size < 0.1, F.format_number(value, 3))
            .when(size < 10, F.format_number(value, 1))
            .otherwise(F.format_number(value, 0))
        )
    else:
        raise ValueError(f"unknown display style {style!r}")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(NOT_REPORTED))
        .when(size == 0, F.lit("0"))
        .otherwise(shown)
    )
