from .releases import ingest_releases
from .usage import drain, engagement_stream, sessions_stream, usage_windows

__all__ = ["drain", "engagement_stream", "ingest_releases", "sessions_stream", "usage_windows"]
