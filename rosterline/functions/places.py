"""Place names: normal form, lookup keys of a gazetteer entry, candidates inside a name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PLACE_DESIGNATORS, PLACE_PREFIXES, ROLE_WORDS
from .base import as_col, bind

PARENTHESISED = r"\((.*?)\)"


def normalize_place(name: Column | str) -> Column:
    ascii_only = F.regexp_replace(F.lower(as_col(name)), "[^a-z0-9]+", " ")
    return F.trim(ascii_only)


def strip_designator(name: Column | str, designators: Sequence[str] = PLACE_DESIGNATORS) -> Column:
    """Remove every trailing designator; a name that is nothing but one stays."""
    tail = r"(?i)(?:\s* (?:" + "|".join(designators) + r"))+\s*$"
    return F.regexp_replace(as_col(name), tail, "")


def _without_suffix(text: Column, suffix: str) -> Column:
    """``text`` minus ``suffix``, or null when it does not end that way."""
    return F.when(
        text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))
    )


def _with_stems(prefix: str) -> Callable[[Column], Column]:
    """Keys extended by what follows ``prefix`` in those that start with it."""

    def extend(known: Column) -> Column:
        start = F.lit(len(prefix) + 1)
        stems = F.transform(
            F.filter(known, lambda key: key.startswith(prefix)),
            lambda key: F.substring(key, start, F.length(key)),
        )
        shorter = F.transform(
            stems, lambda stem: F.array_compact(F.array(stem, _without_suffix(stem, " city")))
        )
        return F.concat(known, F.flatten(shorter))

    return extend


def place_keys(
    name: Column | str,
    designators: Sequence[str] = PLACE_DESIGNATORS,
    prefixes: Sequence[str] = PLACE_PREFIXES,
) -> Column:
    """Lookup keys of one gazetteer entry: its own name first, then what people call it."""

    def from_base(base: Column) -> Column:
        norm = normalize_place(base)
        before_dash = F.when(
            F.contains(base, F.lit("-")),
            normalize_place(strip_designator(F.substring_index(base, "-", 1), designators)),
        )
        keys = F.array_compact(F.array(norm, before_dash, _without_suffix(norm, " city")))
        for prefix in prefixes:
            keys = bind(keys, _with_stems(prefix))
        return F.filter(F.array_distinct(keys), lambda key: key != "")

    without_notes = F.regexp_replace(as_col(name), PARENTHESISED, " ")
    return bind(strip_designator(without_notes, designators), from_base)


def candidate_places(
    name: Column | str, state: Column | str | None = None, roles: Sequence[str] = ROLE_WORDS
) -> Column:
    """Word runs of an entity name that may be its place, most specific first.

    Text in parentheses comes before the rest.  Role words are blanked in one pass; that
    equals removing them one after another as long as no role starts with the word another
    role ends with, which holds for the default list.
    """
    name = as_col(name)
    alternation = "|".join(sorted(roles, key=len, reverse=True))
    code = F.lit("") if state is None else F.lower(F.trim(F.coalesce(as_col(state), F.lit(""))))

    def words_of(fragment: Column) -> Column:
        bare = F.regexp_replace(normalize_place(fragment), rf"\b(?:{alternation})\b", " ")
        return F.filter(F.split(bare, r"\s+"), lambda w: w != "")

    def drop_state(words: Column) -> Column:
        trailing = (F.size(words) > 1) & (code != "") & (F.element_at(words, -1) == code)
        return F.when(trailing, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)

    def runs(words: Column) -> Column:
        count = F.size(words)
        by_size = F.transform(
            F.sequence(count, F.lit(1), F.lit(-1)),
            lambda size: F.transform(
                F.sequence(F.lit(1), count - size + 1),
                lambda start: F.array_join(F.slice(words, start, size), " "),
            ),
        )
        return F.when(count > 0, F.flatten(by_size)).otherwise(F.array().cast("array<string>"))

    fragments = F.concat(
        F.regexp_extract_all(name, F.lit(PARENTHESISED), F.lit(1)),
        F.array(F.regexp_replace(name, PARENTHESISED, " ")),
    )
    per_fragment = F.transform(
        fragments, lambda f: bind(bind(words_of(f), drop_state), runs)
    )
    found = F.array_distinct(F.flatten(per_fragment))
    return F.coalesce(found, F.array().cast("array<string>"))
