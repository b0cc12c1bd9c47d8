"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, like a let-binding."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def blank_to_null(value: Column | str) -> Column:
    col = as_col(value)
    return F.when(col != "", col)
