import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rentlens.functions import (
    floor_area_sqft, floor_area_sqm, listing_link, monthly_rent, postcode_parts, postcode_problem, route_link,
    signed_turns, target_arrival, whole_days_between,
)
from rentlens.operators.search import highlight


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("amount, frequency, rent", [
    (1200, "monthly", 1200.0), (300, "weekly", 300 * 52 / 12), (50, "daily", 50 * 365 / 12),
    (12000, "yearly", 1000.0), (None, "monthly", None), (None, "hourly", None), (0, "monthly", 0.0),
])
def test_monthly_rent(spark, amount, frequency, rent):
    assert one(spark, monthly_rent(F.lit(amount).cast("int"), F.lit(frequency))) == rent


def test_unknown_frequency(spark):
    with pytest.raises(PySparkException, match="unknown price frequency: hourly"):
        one(spark, monthly_rent(F.lit(5), F.lit("hourly")))
    assert one(spark, monthly_rent(F.lit(5), F.lit("hourly"), on_error="null")) is None


@pytest.mark.parametrize("text, feet, metres", [
    ("1,234 sq. ft.", 1234, int(1234 * 0.092903)), ("300 sq. ft.", 300, 27), ("55 sq. m.", None, None),
    (None, None, None), ("", None, None), ("sq. ft.", None, None), ("10,000,000 sq. ft.", 10000000, 929030),
])
def test_floor_area(spark, text, feet, metres):
    size = F.lit(text).cast("string")
    assert one(spark, floor_area_sqft(size)) == feet
    assert one(spark, floor_area_sqm(floor_area_sqft(size))) == metres


def test_size_that_is_no_number(spark):
    with pytest.raises(PySparkException, match="size is not a whole number"):
        one(spark, floor_area_sqft(F.lit("about 500 sq. ft.")))
    assert one(spark, floor_area_sqft(F.lit("about 500 sq. ft."), on_error="null")) is None


def spelled_postcode(letters, digits, suffix, inward):
    """A postcode and its parts, from the pieces it is put together of."""
    district = letters + digits
    outward = district + suffix
    return outward + " " + inward, {
        "canonical": f"{outward} {inward}", "outward": outward, "inward": inward, "area": letters, "district": district,
        "sub_district": outward if suffix else None, "sector": f"{outward} {inward[0]}", "unit": inward[1:],
    }


@pytest.mark.parametrize("letters", ["M", "KT"])
@pytest.mark.parametrize("digits", ["3", "27"])
@pytest.mark.parametrize("suffix", ["", "P"])
@pytest.mark.parametrize("style", [str, str.lower, lambda text: f"  {text.replace(' ', '')} "])
def test_postcode_parts(spark, letters, digits, suffix, style):
    if len(digits) == 2 and suffix:
        return  # no postcode has both
    text, wanted = spelled_postcode(letters, digits, suffix, "4QX")
    parts = {name: one(spark, column) for name, column in postcode_parts(F.lit(style(text))).items()}
    assert parts == wanted


@pytest.mark.parametrize("text, lax, strict", [
    ("A9 9AA", None, None), ("AA99 9AA", None, "position"), ("SW1A 2AA", None, "position"),
    ("9AA", "outward length", "outward length"), ("AA", "inward length", "inward length"),
    ("ABCDE9AA", "outward length", "outward length"), ("99 9AA", "outward start", "outward start"),
    ("AA 9AA", "outward digit", "outward digit"), ("A9 AAA", "inward start", "inward start"),
    ("A9 9A-", "position", "position"), (None, "missing", "missing"),
])
def test_postcode_problem(spark, text, lax, strict):
    assert one(spark, postcode_problem(F.lit(text).cast("string"))) == lax
    assert one(spark, postcode_problem(F.lit(text).cast("string"), strict=True)) == strict


@pytest.mark.parametrize("as_of, expected", [
    ("2024-06-06 12:00:00", "2024-06-07 08:00:00"),   # Thursday, summer time
    ("2024-06-07 12:00:00", "2024-06-10 08:00:00"),   # Friday to Monday
    ("2024-06-08 12:00:00", "2024-06-10 08:00:00"),   # Saturday
    ("2024-06-09 22:59:00", "2024-06-10 08:00:00"),   # Sunday evening
    ("2024-06-09 23:30:00", "2024-06-11 08:00:00"),   # already Monday in London
    ("2024-12-02 12:00:00", "2024-12-03 09:00:00"),   # winter time
])
def test_target_arrival(spark, as_of, expected):
    assert one(spark, target_arrival(F.lit(as_of).cast("timestamp_ntz"))) == dt.datetime.fromisoformat(expected)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moment = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        assert one(spark, whole_days_between(moment, dt.datetime(2024, 1, 8), "timestamp_ntz")) == 7
        assert one(spark, whole_days_between(moment, dt.datetime(2024, 1, 7, 23, 59, 59), "timestamp_ntz")) == 6
        assert one(spark, whole_days_between(moment, dt.datetime(2023, 12, 31, 23), "timestamp_ntz")) == -1
        arrival = target_arrival(F.lit("2024-06-06 12:00:00").cast("timestamp_ntz"))
        assert one(spark, arrival) == dt.datetime(2024, 6, 7, 8)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_winding(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    ring = lambda points: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])
    assert one(spark, signed_turns(ring(square))) == 2.0
    assert one(spark, signed_turns(ring(square[::-1]))) == -2.0
    assert one(spark, signed_turns(ring(square + square[:1]))) == 2.0


def test_links(spark):
    assert one(spark, listing_link(F.lit("/properties/7"), "https://h.example")) == "https://h.example/properties/7"
    assert one(spark, listing_link(F.lit(None).cast("string"), "https://h.example")) is None
    numbers = [F.lit(v) for v in (51.5007, -0.1246, 51.0, 0.00012)]
    assert one(spark, route_link(*numbers)) == (
        "https://www.google.com/maps/dir/?api=1&origin=51.5007%2C-0.1246&destination=51.0%2C0.00012&travelmode=transit"
    )
    assert one(spark, route_link(*numbers, provider="apple")) == (
        "https://maps.apple.com/?saddr=51.5007%2C-0.1246&daddr=51.0%2C0.00012&dirflg=r"
    )


@pytest.mark.parametrize("text, query, spans", [
    ("Barbican Station", "barbican station", [("Barbican Station", True)]),
    ("Barbican Station", "bar", [("Bar", True), ("bican Station", False)]),
    ("Old Street Old", "old", [("Old", True), (" Street ", False), ("Old", True)]),
    ("a.b.c", ".", [("a", False), (".", True), ("b", False), (".", True), ("c", False)]),
])
def test_highlight(spark, text, query, spans):
    found = one(spark, highlight(F.lit(text), F.lit(query)))
    assert [(s.text, s.highlighted) for s in found] == spans
