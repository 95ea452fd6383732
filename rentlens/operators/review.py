"""Review sheet: the links a person opens for each accepted listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import listing_link, route_link
from .commute import od_pairs


def review_sheet(listings: DataFrame, places: DataFrame, host: str, provider: str = "google") -> DataFrame:
    """One row per link: the listing's own, and a route from each commute place to it.

    A listing without a link of its own has only routes. Columns: id, kind, place, link.
    """
    adverts = listings.select(
        "id", F.lit("advert").alias("kind"), F.lit(None).cast("string").alias("place"),
        listing_link("property_url", host).alias("link"),
    ).where("link is not null")
    routes = od_pairs(listings, places).select(
        "id", F.lit("route").alias("kind"), F.col("name").alias("place"),
        route_link("dst_lat", "dst_lon", "src_lat", "src_lon", provider).alias("link"),
    )
    return adverts.unionByName(routes)
