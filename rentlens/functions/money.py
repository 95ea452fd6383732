"""Rent and floor-area columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import SQFT_SUFFIX, SQM_PER_SQFT


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _fail(*parts) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def monthly_rent(amount="amount", frequency="frequency", on_error: str = "raise") -> Column:
    """Rent per calendar month as double; null without an amount.

    An unknown frequency fails the query, or gives null with ``on_error="null"``.
    """
    amount, frequency = as_column(amount).cast("double"), as_column(frequency)
    unknown = F.lit(None) if on_error == "null" else _fail(
        "unknown price frequency: ", F.coalesce(frequency, F.lit("null"))
    )
    return (
        F.when(amount.isNull(), F.lit(None))
        .when(frequency == "monthly", amount)
        .when(frequency == "weekly", amount * 52 / 12)
        .when(frequency == "daily", amount * 365 / 12)
        .when(frequency == "yearly", amount / 12)
        .otherwise(unknown.cast("double"))
    )


def floor_area_sqft(display_size="display_size", on_error: str = "raise") -> Column:
    """Whole square feet from text such as ``1,234 sq. ft.``; null for other units or no text."""
    size = as_column(display_size)
    digits = F.replace(F.regexp_extract(size, r"^(.*) sq\. ft\.$", 1), F.lit(","), F.lit(""))
    feet = F.trim(digits).try_cast("int")
    if on_error != "null":
        feet = F.coalesce(feet, _fail("size is not a whole number: ", size).cast("int"))
    return F.when(F.endswith(size, F.lit(SQFT_SUFFIX)), feet)


def floor_area_sqm(square_feet) -> Column:
    """Whole square metres, cut towards zero."""
    return (as_column(square_feet) * F.lit(SQM_PER_SQFT)).cast("int")
