"""Structured Streaming versions of the incremental jobs."""

from .listings import (
    merge_upserts, read_upserts, start_append, start_suitable, start_upsert, stream_latest, stream_new_listings,
    stream_suitable,
)
from .seeded import stream_unseen_listings

__all__ = [
    "merge_upserts", "read_upserts", "start_append", "start_suitable", "start_upsert", "stream_latest", "stream_new_listings",
    "stream_suitable",
    "stream_unseen_listings",
]
