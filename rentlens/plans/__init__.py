"""End-to-end jobs built from the operators, and the workload over the sample tables."""

from .jobs import accepted_listings, judged_listings, merged_snapshots, place_results, postcode_cells, rent_map

__all__ = ["accepted_listings", "judged_listings", "merged_snapshots", "place_results", "postcode_cells", "rent_map"]
