import random
import re

from pyspark.sql import functions as F

from rentlens.operators import postcodes as P
from rentlens.plans import postcode_cells


def test_split(spark, rows):
    codes = spark.createDataFrame([("SW1A 2AA",), ("bad",), ("E1 6AN",), (None,)], "postcode string")
    good, bad = P.split_valid_postcodes(codes)
    assert rows(good) == [("E1 6AN",), ("SW1A 2AA",)]
    assert rows(bad) == [("bad", "outward length"), (None, "missing")]
    strict, _ = P.split_valid_postcodes(codes, strict=True)
    assert rows(strict) == [("E1 6AN",)]


def test_rollup(spark):
    codes = spark.createDataFrame([("SW1A 2AA", 1), ("sw1a2ab", 3), ("SW1 2AA", 5), ("E1 6AN", 7)], "postcode string, rent int")
    found = {(r.level, r.code): (r.n, r.mean) for r in P.rollup_by_postcode(codes, [F.count("*").alias("n"), F.avg("rent").alias("mean")]).collect()}
    assert found[("area", "SW")] == (3, 3.0) and found[("district", "SW1")] == (3, 3.0)
    assert found[("sub_district", "SW1A")] == (2, 2.0) and ("sub_district", "E1") not in found
    assert found[("sector", "SW1A 2")] == (2, 2.0) and found[("postcode", "SW1A 2AB")] == (1, 3.0)
    assert found[("area", "E")] == (1, 7.0)


def test_shared_coordinates(spark, rows):
    codes = spark.createDataFrame([("B", 1.0, 2.0), ("A", 1.0, 2.0), ("A", 1.0, 2.0), ("C", 1.0, 2.0000001)], "postcode string, longitude double, latitude double")
    sites = P.distinct_sites(codes)
    assert rows(sites) == [(1.0, 2.0, "A", 2, "1.0,2.0"), (1.0, 2.0000001, "C", 1, "1.0,2.0000001")]
    assert rows(P.fan_out(sites.select("x", "y", "first_code"), codes).select("postcode", "first_code")) == [("A", "A"), ("A", "A"), ("B", "A"), ("C", "C")]


def test_every_valid_postcode_gets_its_cell(spark):
    codes = spark.createDataFrame(
        [("E1 6AN", "0.1", "51.1"), ("E1 6AP", "0.1", "51.1"), ("SW1A 2AA", "0.3", "51.2"), ("N1 9AA", "0.2", "51.3"), ("bad", "0.2", "51.2")],
        "postcode string, longitude string, latitude string",
    ).withColumns({"longitude": F.col("longitude").cast("decimal(9,6)"), "latitude": F.col("latitude").cast("decimal(9,6)")})
    rings = {r.region: r.ring for r in postcode_cells(codes).collect()}
    assert set(rings) == {"E1 6AN", "E1 6AP", "SW1A 2AA", "N1 9AA"}
    # One text at two coordinates is two sites.
    twice = postcode_cells(codes.where("postcode <> 'bad'").withColumn("postcode", F.lit("E1 6AN"))).collect()
    assert len({str(r.ring) for r in twice}) == 3
    assert rings["E1 6AN"] == rings["E1 6AP"] != rings["N1 9AA"]
    assert all(ring[0] == ring[-1] and len(ring) >= 4 for ring in rings.values())


def test_random_texts_against_a_pattern(spark):
    rng = random.Random(11)
    texts = sorted({"".join(rng.choice("AB19 x") for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    texts += [f"{a}{n}{x} {i}" for a in ("E", "SW") for n in (1, 12) for x in ("", "A") for i in ("2AA", "9ZZ")]
    found = P.with_postcode_hierarchy(P.check_postcodes(spark.createDataFrame([(t,) for t in texts], "postcode string")))
    # Outward: a letter first, a digit somewhere, 2 to 4 characters; inward: a digit and two more.
    shape = re.compile(r"(?=.{5,7}$)(?=[A-Z][^0-9]*[0-9].*.{3}$)([A-Z].{1,3})([0-9].{2})")
    for row in found.collect():
        packed = row.postcode.upper().strip().replace(" ", "")
        match = shape.fullmatch(packed)
        valid = match is not None and any(c.isdigit() for c in match[1])
        assert (row.problem is None) == valid, row
        if valid:
            last_digit = max(i for i, c in enumerate(match[1]) if c.isdigit())
            first_digit = min(i for i, c in enumerate(match[1]) if c.isdigit())
            assert (row.outward, row.inward, row.unit) == (match[1], match[2], match[2][1:])
            assert row.area == match[1][:first_digit] and row.district == match[1][: last_digit + 1]
            following = match[1][last_digit + 1: last_digit + 2]
            assert row.sub_district == (row.district + following if following else None)
            assert row.sector == f"{match[1]} {match[2][0]}" and row.canonical == f"{match[1]} {match[2]}"
