"""Postcode hierarchy, validity, shared coordinates, roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import postcode_parts, postcode_problem
from ..session import cut_lineage
from .joins import lookup_join

LEVELS = ("area", "district", "sub_district", "sector", "canonical")


def with_postcode_hierarchy(df: DataFrame, column: str = "postcode") -> DataFrame:
    """Add canonical, outward, inward, area, district, sub_district, sector and unit."""
    return df.withColumns(postcode_parts(column))


def check_postcodes(df: DataFrame, column: str = "postcode", strict: bool = False) -> DataFrame:
    """Add ``problem``: the reason a postcode is not valid, null when it is."""
    return df.withColumn("problem", postcode_problem(column, strict))


def split_valid_postcodes(
    df: DataFrame, column: str = "postcode", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their ``problem``."""
    checked = check_postcodes(df, column, strict)
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def distinct_sites(
    df: DataFrame, column: str = "postcode", x: str = "longitude", y: str = "latitude"
) -> DataFrame:
    """One row per exact coordinate: x, y, site_id, first_code, n_codes.

    ``site_id`` is the coordinate as text, ``first_code`` its first postcode. Postcodes are
    counted, not gathered, so a coordinate that very many share stays one small row;
    :func:`fan_out` brings every postcode back by an equi join.
    """
    sites = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.min(column).alias("first_code"), F.count_distinct(column).alias("n_codes")
    )
    return sites.withColumn("site_id", F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string")))


def fan_out(per_site: DataFrame, df: DataFrame, column: str = "postcode", x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Give every postcode the values of its coordinate's row."""
    members = df.select(F.col(column).alias("postcode"), F.col(x).alias("x"), F.col(y).alias("y"))
    # Written once: the size check and the join both read it.
    return lookup_join(members, cut_lineage(per_site), ["x", "y"])


def rollup_by_postcode(df: DataFrame, metrics: Sequence[Column], column: str = "postcode") -> DataFrame:
    """Metrics at each step of the hierarchy: area, district, sub-district, sector, postcode.

    ``df`` has valid postcodes. ``level`` names the step and ``code`` is its code. Rows of a
    district without sub-districts have no sub-district row.
    """
    parts = postcode_parts(column)
    with_codes = df.withColumns({f"_{level}": parts[level] for level in LEVELS})
    steps = F.array(*[
        F.struct(F.lit("postcode" if level == "canonical" else level).alias("level"), F.col(f"_{level}").alias("code"))
        for level in LEVELS
    ])
    return (
        with_codes.withColumn("_step", F.explode(steps))
        .where("_step.code is not null")
        .groupBy(F.col("_step.level").alias("level"), F.col("_step.code").alias("code"))
        .agg(*metrics)
    )
