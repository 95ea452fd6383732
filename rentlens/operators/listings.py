"""Flat columns over the nested listing record, and derived columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions import floor_area_sqft, floor_area_sqm, monthly_rent
from ..schemas import LET_AGREED


def with_listing_columns(df: DataFrame, property_types: Mapping[str, str] | None = None) -> DataFrame:
    """Add the flat columns the operators use to nested listing records.

    ``property_types`` names the property type of sub-types, both in lower case; a sub-type it
    does not name is its own type. On Parquet only the nested fields a query needs are read.
    """
    let_agreed = F.coalesce(
        F.exists("lozengeModel.matchingLozenges", lambda tag: tag["type"] == LET_AGREED), F.lit(False)
    )
    sub_type = F.lower("propertySubType")
    if property_types:
        names = F.create_map(*[F.lit(text) for pair in property_types.items() for text in pair])
        sub_type = F.coalesce(F.try_element_at(names, sub_type), sub_type)
    return df.withColumns({
        "amount": F.col("price.amount"),
        "frequency": F.col("price.frequency"),
        "latitude": F.col("location.latitude"),
        "longitude": F.col("location.longitude"),
        "let_agreed": let_agreed,
        "display_size": F.col("displaySize"),
        "display_address": F.col("displayAddress"),
        "property_type": sub_type,
        "property_url": F.col("propertyUrl"),
        "agent_id": F.col("customer.branchId"),
        "first_visible_date": F.col("firstVisibleDate"),
    })


def with_monthly_rent(df: DataFrame, on_error: str = "raise") -> DataFrame:
    """Add ``monthly_rent``."""
    return df.withColumn("monthly_rent", monthly_rent(on_error=on_error))


def with_floor_area(df: DataFrame, on_error: str = "raise") -> DataFrame:
    """Add ``square_feet`` and ``square_metres``."""
    return df.withColumn("square_feet", floor_area_sqft(on_error=on_error)).withColumn(
        "square_metres", floor_area_sqm("square_feet")
    )


def map_listing_location(df: DataFrame) -> DataFrame:
    """The slim record: id and location only."""
    if "location" in df.columns:
        return df.select("id", "location")
    return df.select("id", F.struct("latitude", "longitude").alias("location"))
