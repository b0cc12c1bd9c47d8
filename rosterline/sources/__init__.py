from .contract import (
    changed_sources, provenance, require_contract, table_fingerprint,
)
from .manifest import Source, file_manifest, source_states
from .readers import (
    load_counties, load_events, load_key_overrides, load_location_overrides, load_places,
    load_registry, load_release, newest_release, read_contract_csv, read_located_header,
    release_files,
)
from .sinks import (
    current_version, publish, published_path, read_published, split_placed, write_diff, write_features,
    write_feed, write_profiles,
)

__all__ = [
    "Source", "changed_sources", "current_version", "file_manifest", "source_states", "published_path", "load_counties", "load_events",
    "load_key_overrides", "load_location_overrides", "load_places", "load_registry",
    "load_release", "newest_release", "provenance", "publish", "read_contract_csv",
    "read_located_header", "read_published", "release_files", "require_contract",
    "split_placed", "table_fingerprint", "write_diff", "write_features", "write_feed",
    "write_profiles",
]
