"""Readers and writers. Layouts are declared, never inferred."""

from .readers import (
    read_journeys, read_listings, read_location_matches, read_named_map, read_places,
    read_postcode_centroids, read_price_caps, read_regions, read_search_places, read_snapshots,
    read_station_feed_attribution, read_station_feed_header, read_station_feed_styles, read_stations,
    split_journeys, split_listings, stream_snapshots,
)
from .tables import (
    append_unseen, current_table, publish_table, write_keyed_table, write_listings, write_regions,
    write_snapshots,
)

__all__ = [
    "append_unseen", "current_table", "publish_table", "read_journeys", "read_listings",
    "read_location_matches", "read_named_map", "read_places", "read_postcode_centroids",
    "read_price_caps", "read_regions", "read_search_places", "read_snapshots",
    "read_station_feed_attribution", "read_station_feed_header", "read_station_feed_styles",
    "read_stations", "split_journeys", "split_listings", "stream_snapshots", "write_keyed_table", "write_listings", "write_regions",
    "write_snapshots",
]
