"""Review links as text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import ROUTE_LINKS
from .money import as_column


def listing_link(path, host: str) -> Column:
    """Absolute link of a listing; null when the listing has no link of its own."""
    path = as_column(path)
    return F.when(path.isNotNull() & (path != ""), F.concat(F.lit(host), path))


def _number(column) -> Column:
    """Shortest decimal text that reads back as the same number, without an exponent."""
    value = as_column(column).cast("double")
    text = value.cast("string")
    plain = F.regexp_replace(text.cast("decimal(38,24)").cast("string"), "0+$", "")
    return F.when((F.abs(value) < 1e-3) & (value != 0), plain).otherwise(text)


def route_link(src_lat, src_lon, dst_lat, dst_lon, provider: str = "google") -> Column:
    """Public-transport route link between two coordinates."""
    head, middle, tail = ROUTE_LINKS[provider]
    source = F.url_encode(F.concat(_number(src_lat), F.lit(","), _number(src_lon)))
    target = F.url_encode(F.concat(_number(dst_lat), F.lit(","), _number(dst_lon)))
    return F.concat(F.lit(head), source, F.lit(middle), target, F.lit(tail))
