"""Postcode hierarchy and validity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .money import as_column


def _packed(postcode) -> Column:
    """Upper case without any space."""
    return F.replace(F.upper(F.trim(as_column(postcode))), F.lit(" "), F.lit(""))


def _outward(packed: Column) -> Column:
    return F.substring(packed, F.lit(1), F.greatest(F.length(packed) - 3, F.lit(0)))


def postcode_parts(postcode) -> dict[str, Column]:
    """The canonical text and its seven codes, from the whole to the parts.

    area ``SW``, district ``SW1``, sub-district ``SW1A`` (null when there is none),
    sector ``SW1A 2``, unit ``AA``, outward ``SW1A``, inward ``2AA``.
    """
    packed = _packed(postcode)
    outward, inward = _outward(packed), F.right(packed, F.lit(3))
    district = F.regexp_extract(outward, r"^(.*[0-9])", 1)
    sub_district = F.regexp_extract(outward, r"^(.*[0-9].?)", 1)
    return {
        "canonical": F.concat(outward, F.lit(" "), inward),
        "outward": outward,
        "inward": inward,
        "area": F.regexp_extract(packed, r"^([^0-9]*)", 1),
        "district": district,
        "sub_district": F.nullif(sub_district, district),
        "sector": F.concat(outward, F.lit(" "), F.left(inward, F.lit(1))),
        "unit": F.right(packed, F.lit(2)),
    }


def postcode_problem(postcode, strict: bool = False) -> Column:
    """Why the postcode is not valid; null when it is.

    ``strict`` additionally demands a letter or digit as fifth character of the canonical
    text, which turns away every postcode with a four-character outward code.
    """
    packed = _packed(postcode)
    outward, inward = _outward(packed), F.right(packed, F.lit(3))
    canonical = F.concat(outward, F.lit(" "), inward)
    fifth = r"[\p{L}\p{N}]" if strict else r"[\p{L}\p{N} ]"
    positions = rf"^\p{{L}}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}} ][\p{{L}}\p{{N}} ]{fifth}[\p{{L}}\p{{N}}]{{1,3}}$"
    return (
        F.when(packed.isNull(), "missing")
        .when(F.length(inward) != 3, "inward length")
        .when(~F.length(outward).between(2, 4), "outward length")
        .when(~F.rlike(outward, F.lit(r"^\p{L}")), "outward start")
        .when(~F.rlike(outward, F.lit("[0-9]")), "outward digit")
        .when(~F.rlike(inward, F.lit("^[0-9]")), "inward start")
        .when(~F.rlike(canonical, F.lit(positions)), "position")
    )
