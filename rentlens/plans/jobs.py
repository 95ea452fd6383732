"""The end-to-end jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..operators.cells import Envelope, cell_edges, ring_from_edges, site_cells
from ..operators.commute import commute_ok
from ..operators.postcodes import distinct_sites, fan_out, split_valid_postcodes
from ..operators.batches import paged
from ..operators.regions import assign_regions, orient_clockwise, rent_by_region, rent_map_table, within_miles
from ..operators.rules import (
    Rule, classify, exclude_seen, rule_available, rule_commute, rule_has_price, rule_max_rent, rule_min_area,
    rule_recent, rule_residential, suitable, with_price_cap,
)
from ..operators.search import ListingQuery, matching, with_review_rank
from ..operators.snapshots import latest_per_listing
from ..schemas import LIST_CAP
from ..session import cut_lineage


def _cheap_rules(df: DataFrame, now: dt.datetime, max_rent: int | str, max_days: int | None, min_sqm: int) -> list[Rule]:
    date_type = dict(df.dtypes)["first_visible_date"]
    return [
        rule_residential(), rule_has_price(), rule_min_area(min_sqm), rule_available(),
        rule_max_rent(max_rent), rule_recent(now, max_days, date_type),
    ]


def judged_listings(
    listings: DataFrame, places: DataFrame, journeys: DataFrame, now: dt.datetime,
    max_rent: int | str = 2200, max_days: int | None = 7, max_minutes: int = 45, min_sqm: int = 0,
    history: DataFrame | None = None, origin=("id",), destination=("name",),
) -> DataFrame:
    """Every unseen listing with the first rule that turns it away, the commute rule last.

    Only listings that passed the other rules meet the journeys.
    """
    fresh = exclude_seen(listings, history)
    judged = classify(fresh, _cheap_rules(fresh, now, max_rent, max_days, min_sqm))
    passed = commute_ok(judged.where("skip_rule is null"), places, journeys, max_minutes, origin, destination)
    checked = classify(passed, [rule_commute()]).drop("commute_ok")
    return checked.unionByName(judged.where("skip_rule is not null"))


def accepted_listings(
    listings: DataFrame, places: DataFrame, journeys: DataFrame, now: dt.datetime,
    max_rent: int | str = 2200, max_days: int | None = 7, max_minutes: int = 45, min_sqm: int = 0,
    history: DataFrame | None = None, origin=("id",), destination=("name",),
    centre: tuple[float, float] | None = None,
) -> DataFrame:
    """The suitable listings in review order, with their ``rank`` from 1.

    No verdicts are needed, so the cheap rules are filters that reach the scan.
    """
    fresh = exclude_seen(listings, history)
    passed = suitable(fresh, _cheap_rules(fresh, now, max_rent, max_days, min_sqm))
    reached = suitable(commute_ok(passed, places, journeys, max_minutes, origin, destination), [rule_commute()])
    return with_review_rank(reached.drop("commute_ok"), centre)


def place_results(
    listings: DataFrame, places: DataFrame, caps: DataFrame, query: ListingQuery, default_cap: int = 2200,
    as_of: dt.datetime | None = None, regions: DataFrame | None = None, cap: int = LIST_CAP,
) -> DataFrame:
    """The result list of every search place at once, in pages per place (column ``name``).

    Listings within the query's radius of a place and within the place's price cap (or
    ``default_cap``) that meet the criteria, in the query's order; nearest is by miles.
    """
    near = within_miles(listings, places, query.radius, regions)
    capped = with_price_cap(near, caps, default_cap)
    found = matching(capped, query, as_of).where(F.col("monthly_rent") <= F.col("cap"))
    return paged(found.withColumn("distance", F.col("miles_away")), query.order(), query.page_size, cap, by=["name"])


def merged_snapshots(snapshots: DataFrame, **kwargs) -> DataFrame:
    """The newest record of each listing over all snapshots."""
    return latest_per_listing(snapshots, **kwargs)


def rent_map(listings: DataFrame, regions: DataFrame, max_price: float | None = None) -> DataFrame:
    """The map table of mean monthly rent per region."""
    # A row per region, written so that the cap and the join do not each read the listings.
    means = cut_lineage(rent_by_region(assign_regions(listings, regions)))
    return rent_map_table(regions, means, max_price)


def postcode_cells(
    centroids: DataFrame, envelope: Envelope | None = None, strict: bool = False
) -> DataFrame:
    """The ring of every valid postcode: region (the postcode), part, ring_no, ring, clockwise.

    Postcodes at one coordinate share its cell.
    """
    valid, _ = split_valid_postcodes(centroids, strict=strict)
    cells = site_cells(distinct_sites(valid), envelope)
    rings = ring_from_edges(cell_edges(cells)).join(cells.select("site_id", "x", "y"), "site_id")
    spots = valid.withColumns({"longitude": F.col("longitude").cast("double"), "latitude": F.col("latitude").cast("double")})
    per_postcode = fan_out(rings.select("x", "y", "ring"), spots)
    return orient_clockwise(
        per_postcode.select(F.col("postcode").alias("region"), F.lit(0).alias("part"), F.lit(0).alias("ring_no"), "ring")
    )
