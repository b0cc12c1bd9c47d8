"""Keys, tokens and text predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ABBREVIATIONS, IDENTIFIER_PATTERN, STOPWORDS
from .base import as_col, blank_to_null, literal_map


def slug_key(name: Column | str, prefix: str = "SYNTH-", length: int = 40) -> Column:
    """A stand-in key for a row without one, made from its name."""
    upper = F.upper(F.coalesce(as_col(name), F.lit("unknown")))
    dashed = F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", "-"), F.lit("-"))
    return F.concat(F.lit(prefix), F.substring(dashed, 1, length))


def _raw_words(name: Column | str) -> Column:
    return F.split(F.upper(as_col(name)), r"[^\p{L}\p{N}]+")


def _spelled_out(
    words: Column, abbreviations: Mapping[str, str], stopwords: Sequence[str]
) -> Column:
    expansions = literal_map(abbreviations)
    spelled = F.transform(words, lambda w: F.coalesce(F.try_element_at(expansions, w), w))
    kept = F.filter(spelled, lambda w: ~w.isin("", *stopwords))
    return F.coalesce(kept, F.array().cast("array<string>"))


def normalize_tokens(
    name: Column | str,
    abbreviations: Mapping[str, str] = ABBREVIATIONS,
    stopwords: Sequence[str] = STOPWORDS,
) -> Column:
    """Upper-case words of a name, abbreviations spelled out, filler words gone."""
    return _spelled_out(_raw_words(name), abbreviations, stopwords)


def distinct_tokens(
    name: Column | str,
    abbreviations: Mapping[str, str] = ABBREVIATIONS,
    stopwords: Sequence[str] = STOPWORDS,
) -> Column:
    """The set of normal tokens; repeats go first, so a long text costs its vocabulary only."""
    words = F.array_distinct(_raw_words(name))
    return F.array_distinct(_spelled_out(words, abbreviations, stopwords))


def normalize_name(name: Column | str, **kwargs) -> Column:
    return F.array_join(normalize_tokens(name, **kwargs), " ")


def zip5(value: Column | str) -> Column:
    """First five digits of a postal code held as text; null when there is no digit."""
    digits = F.regexp_replace(as_col(value).cast("string"), r"\P{Nd}+", "")
    return F.when(digits != "", F.lpad(F.substring(digits, 1, 5), 5, "0"))


def contains_identifier(text: Column | str, pattern: str = IDENTIFIER_PATTERN) -> Column:
    return as_col(text).rlike("(?i)" + pattern)


def is_safe_https(url: Column | str) -> Column:
    """An https address with a host and without a user name or password; null is unsafe."""
    text = F.coalesce(as_col(url), F.lit(""))
    authority = F.regexp_extract(text, "^(?i:https)://([^/?#]*)", 1)
    userinfo = F.regexp_extract(authority, "^(.*)@", 1)
    return (authority != "") & userinfo.isin("", ":")


def matches_text(query: str, *columns: Column | str) -> Column:
    """Is the trimmed, lower-cased query part of the joined non-empty fields?"""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    haystack = F.lower(F.concat_ws(" ", *[blank_to_null(c) for c in columns]))
    return F.contains(haystack, F.lit(needle))


def shared_tokens(left: Column | str, right: Column | str) -> Column:
    return F.array_intersect(as_col(left), as_col(right))


def ordered_distinct(values: Column | str) -> Column:
    """Distinct elements, each at the position of its first occurrence."""
    return F.array_distinct(as_col(values))
