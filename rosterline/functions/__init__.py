"""Pure column expressions: nothing here reads data or triggers a job."""

from .dates import (
    age_at, band, duration_days, public_status, release_date, strict_iso_date, to_instant,
)
from .display import code_label, display_avg, python_title, rating_class, rating_paint, title_case
from .numeric import (
    funding_progress, gated_ratio, haversine_miles, is_stale, null_if_nan, suppress,
    total_skip_null, total_strict, whole_dollars,
)
from .places import candidate_places, normalize_place, place_keys, strip_designator
from .records import category_struct, geo_uri, location_fields
from .text import (
    contains_identifier, distinct_tokens, is_safe_https, matches_text, normalize_name, normalize_tokens,
    ordered_distinct, shared_tokens, slug_key, zip5,
)

__all__ = [
    "age_at", "band", "candidate_places", "category_struct", "code_label",
    "contains_identifier", "display_avg", "distinct_tokens", "duration_days", "funding_progress",
    "gated_ratio", "geo_uri", "haversine_miles", "is_safe_https", "is_stale",
    "location_fields", "matches_text", "normalize_name", "normalize_place",
    "normalize_tokens", "null_if_nan", "ordered_distinct", "place_keys", "public_status",
    "python_title", "rating_class", "rating_paint", "release_date", "shared_tokens",
    "slug_key", "strict_iso_date", "strip_designator", "suppress", "title_case",
    "to_instant", "total_skip_null", "total_strict", "whole_dollars", "zip5",
]
