import math
import random

import pytest
from pyspark.sql import functions as F

from rentlens.operators import joins, regions as R

POINT = "array<struct<x: double, y: double>>"


def region_table(spark, rings):
    return spark.createDataFrame(
        [(region, part, n, [(float(x), float(y)) for x, y in ring]) for region, part, n, ring in rings],
        f"region string, part int, ring_no int, ring {POINT}",
    )


def point_table(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, longitude double, latitude double")


def odd_crossings(ring, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def assigned(points, regions, **options):
    return sorted((row.id, row.region) for row in R.assign_regions(points, regions, **options).collect())


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]


def test_concave_parts_holes_and_overlap(spark):
    regions = region_table(spark, [
        ("concave", 0, 0, [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]),
        ("parts", 0, 0, [(10, 0), (11, 0), (11, 1), (10, 1)]), ("parts", 1, 0, [(20, 5), (21, 5), (21, 6), (20, 6)]),
        ("holed", 0, 0, SQUARE), ("holed", 0, 1, HOLE), ("empty", 0, 0, [(50, 50), (51, 50), (51, 51)]),
    ])
    points = point_table(spark, [(2, 3), (0.5, 3), (10.5, 0.5), (20.5, 5.5), (15, 3), (2, 2), (0.5, 0.2)])
    expected = [(0, "holed"), (1, "concave"), (1, "holed"), (2, "parts"), (3, "parts"), (5, "holed"), (6, "concave"), (6, "holed")]
    assert assigned(points, regions) == expected
    # Counted together, the inner ring is a hole: two crossings make an outside.
    in_hole = [(0, "holed"), (5, "holed")]
    assert assigned(points, regions, rule="even_odd") == [pair for pair in expected if pair not in in_hole[1:]]
    with pytest.raises(ValueError):
        R.region_cells(regions, rule="other")


def test_borders_are_half_open(spark):
    regions = region_table(spark, [("box", 0, 0, SQUARE), ("turned", 0, 0, SQUARE[::-1])])
    points = point_table(spark, [(0, 0), (0, 2), (2, 0), (4, 2), (2, 4), (4, 4)])
    assert assigned(points, regions) == [(i, r) for i in (0, 1, 2) for r in ("box", "turned")]


def test_neighbours_share_no_point(spark):
    left, right = [(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (2, 0), (2, 1), (1, 1)]
    regions = region_table(spark, [("left", 0, 0, left), ("right", 0, 0, right)])
    assert assigned(point_table(spark, [(1, 0.5)]), regions) == [(0, "right")]


@pytest.mark.parametrize("max_broadcast", [R.BROADCAST_SIDES, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_rings_of_very_different_sizes(spark, seed, max_broadcast):
    rng = random.Random(seed)
    rings = []
    for n in range(25):
        size = 10 ** rng.uniform(-3, 1.5)
        cx, cy, corners = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([3, 5, 12, 200])
        ring = []
        for k in range(corners):
            angle, radius = 2 * math.pi * k / corners, size * rng.uniform(0.2, 1)
            ring.append((cx + radius * math.cos(angle), cy + radius * math.sin(angle)))
        rings.append((f"r{n}", 0, 0, ring))
    points = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(600)]
    points += [(rng.gauss(r[3][0][0], 0.01), rng.gauss(r[3][0][1], 0.01)) for r in rings for _ in range(8)]
    expected = sorted((i, name) for i, (x, y) in enumerate(points) for name, _, _, ring in rings if odd_crossings(ring, x, y))
    found = assigned(point_table(spark, points), region_table(spark, rings), max_broadcast=max_broadcast)
    assert found == expected and len(found) > 500


def test_saved_cells_give_the_same_result(spark, tmp_path):
    regions = region_table(spark, [("a", 0, 0, SQUARE), ("b", 0, 0, HOLE)])
    points = point_table(spark, [(x / 3, y / 3) for x in range(-2, 16) for y in range(-2, 16)])
    R.region_cells(regions).write.parquet(str(tmp_path / "cells"))
    saved = spark.read.parquet(str(tmp_path / "cells"))
    assert assigned(points, None, cells=saved) == assigned(points, regions)


def test_points_without_coordinates_and_no_regions(spark):
    points = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 1.0)], "id long, longitude double, latitude double")
    assert assigned(points, region_table(spark, [("a", 0, 0, SQUARE)])) == [(2, "a")]
    assert assigned(points, region_table(spark, [("a", 0, 0, SQUARE)]).limit(0)) == []


def test_rents_and_map(spark):
    listings = spark.createDataFrame(
        [("a", 1000, "monthly"), ("a", 240, "weekly"), ("a", None, None), ("b", None, None), ("c", 24000, "yearly")],
        "region string, amount int, frequency string",
    )
    means = R.rent_by_region(listings)
    assert {r.region: (r.mean_rent, r.priced, r.unpriced) for r in means.collect()} == {"a": (1020.0, 2, 1), "c": (2000.0, 1, 0)}
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "region string")
    table = {r.region: (r.shade, r.label) for r in R.rent_map_table(every, means, 1500.0).collect()}
    assert table == {"a": (1020 / 1500, "a\n£1020.00 pcm"), "b": (None, "b"), "c": (1.0, "c\n£2000.00 pcm")}
    assert R.rent_map_table(every, means).where("region = 'a'").first().shade == 0.51
    assert R.rent_range(means).first().asDict() == {"min_price": 1020.0, "observed_max": 2000.0, "max_price": 2000.0}
    assert R.rent_range(means.limit(0)).count() == 0


def test_boxes_and_winding(spark):
    regions = region_table(spark, [("a", 0, 0, SQUARE), ("a", 1, 0, [(9, 9), (10, 9), (10, 12)])])
    box = R.bounding_boxes(regions).first()
    assert (box.min_x, box.min_y, box.max_x, box.max_y) == (0, 0, 10, 12)
    assert [tuple(p) for p in box.box] == [(0, 0), (10, 0), (10, 12), (0, 12), (0, 0)]
    turned = R.orient_clockwise(R.orient_clockwise(regions)).where("part = 0").first()
    assert [tuple(p) for p in turned.ring] == [tuple(map(float, p)) for p in SQUARE[::-1]]


def test_edges_close_each_ring(spark):
    regions = region_table(spark, [("open", 0, 0, [(0, 0), (1, 0), (1, 1)]), ("closed", 0, 0, SQUARE), ("none", 0, 0, [])])
    counts = {r.region: r["count"] for r in R.region_edges(regions).groupBy("region").count().collect()}
    assert counts == {"open": 3, "closed": 4}


def test_radius(spark):
    places = spark.createDataFrame([("centre", 51.5, 0.0), ("pole", 89.99, 0.0)], "name string, latitude double, longitude double")
    rng = random.Random(3)
    spots = [(rng.uniform(-0.3, 0.3), rng.uniform(51.3, 51.7)) for _ in range(400)] + [(170.0, 89.99)]
    found = {(r.id, r.name) for r in R.within_miles(point_table(spark, spots), places, 5.0).collect()}

    def miles(x, y, lat, lon):
        a, b = math.radians(lat), math.radians(y)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x - lon) / 2) ** 2
        return 2 * 3958.7613 * math.asin(math.sqrt(h))

    expected = {(i, name) for i, (x, y) in enumerate(spots) for name, lat, lon in (("centre", 51.5, 0.0), ("pole", 89.99, 0.0)) if miles(x, y, lat, lon) <= 5}
    assert found == expected and (400, "pole") in found and 10 < len(found) < 400
    with pytest.raises(ValueError):
        R.within_miles(point_table(spark, spots), places, 0)


def test_circles_over_the_180th_meridian(spark):
    places = spark.createDataFrame([("east", 10.0, 179.99), ("west", -10.0, -179.99)], "name string, latitude double, longitude double")
    spots = [(-179.99, 10.0), (179.99, 10.0), (179.98, -10.0), (-179.98, -10.0), (0.0, 10.0), (170.0, -10.0)]
    found = R.within_miles(point_table(spark, spots), places, 5.0).collect()
    assert sorted((r.id, r.name) for r in found) == [(0, "east"), (1, "east"), (2, "west"), (3, "west")]
    assert all(r.miles_away < 5 for r in found)


@pytest.mark.parametrize("vertices", [2_000, 20_000, 200_000])
def test_index_grows_with_the_sides(spark, vertices):
    """A row is a side in a cell, and their number stays in proportion."""
    ring = [(math.cos(2 * math.pi * n / vertices), math.sin(2 * math.pi * n / vertices)) for n in range(vertices)]
    cells = R.region_cells(region_table(spark, [("a", 0, 0, ring)])).cache()
    assert cells.count() < 4 * vertices and cells.where("x1 is null").count() < 2 * vertices
    rng = random.Random(3)
    spots = [(rng.uniform(-1.1, 1.1), rng.uniform(-1.1, 1.1)) for _ in range(200)]
    found = {r.id for r in R.assign_regions(point_table(spark, spots), cells=cells).collect()}
    assert found == {n for n, (x, y) in enumerate(spots) if math.hypot(x, y) < 1 - 1e-6}
    cells.unpersist()


@pytest.mark.parametrize("seed", range(6))
def test_wild_rings_by_hand(spark, seed):
    """Rings that cross themselves, have level and upright sides, and vertices and points on lines of the grid."""
    rng = random.Random(seed)
    grid = lambda: rng.choice([rng.randrange(-8, 9) / 4, rng.uniform(-2, 2), rng.randrange(-2, 3)])
    rings = []
    for region in range(5):
        for part in range(rng.choice([1, 1, 3])):
            ring = [(grid(), grid()) for _ in range(rng.randrange(3, 25))]
            for n in range(1, len(ring)):
                if rng.random() < 0.3:
                    ring[n] = rng.choice([(ring[n - 1][0], ring[n][1]), (ring[n][0], ring[n - 1][1])])
            rings.append((f"r{region}", part, 0, ring))
    spots = [(grid(), grid()) for _ in range(300)] + [rng.choice(rng.choice(rings)[3]) for _ in range(60)] + [(0.0, 0.0)] * 5

    def up(ring):
        """Sides from the lower end, as the index has them."""
        return [tuple(sorted(side, key=lambda p: p[1])) if side[0][1] != side[1][1] else side for side in zip(ring, ring[1:] + ring[:1])]

    def count(ring, x, y):
        return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in up(ring))

    table, points = region_table(spark, rings), point_table(spark, spots)
    for rule in ("union", "even_odd"):
        expected = []
        for name in sorted({r[0] for r in rings}):
            for n, (x, y) in enumerate(spots):
                counts = [count(ring, x, y) for region, _, _, ring in rings if region == name]
                if any(c % 2 for c in counts) if rule == "union" else sum(counts) % 2:
                    expected.append((n, name))
        assert assigned(points, table, rule=rule) == sorted(expected)


def test_a_third_of_the_points_in_one_spot(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_SALT", 50)
    rng = random.Random(9)
    spots = [(1.5, 1.5)] * 400 + [(rng.uniform(-1, 5), rng.uniform(-1, 5)) for _ in range(800)]
    regions = region_table(spark, [("a", 0, 0, SQUARE), ("b", 0, 0, HOLE)])
    expected = sorted((i, name) for i, (x, y) in enumerate(spots) for name, ring in (("a", SQUARE), ("b", HOLE)) if odd_crossings(ring, x, y))
    assert assigned(point_table(spark, spots), regions, max_broadcast=0) == expected
