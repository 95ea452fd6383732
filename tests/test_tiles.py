import random

import pytest

from rentlens.operators import tiles as T


def boxes(spark, *rows):
    return spark.createDataFrame([(r, *map(float, b)) for r, *b in rows], "region string, min_x double, min_y double, max_x double, max_y double")


def points(spark, spots):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "id long, longitude double, latitude double")


@pytest.mark.parametrize("cap", [1000, 60, 7])
def test_tiles_hold_every_point_once(spark, cap):
    rng = random.Random(4)
    # A third of the points in one small corner, some on the border of the box.
    spots = [(rng.uniform(0, 0.01), rng.uniform(0, 0.01)) for _ in range(200)]
    spots += [(rng.random(), rng.random()) for _ in range(380)] + [(1.0, 1.0)] * 5 + [(0.0, 0.5), (0.5, 0.5)]
    box = boxes(spark, ("a", 0, 0, 1, 1))
    tiles = T.adaptive_tiles(points(spark, spots), box, cap=cap, max_depth=14).collect()
    assert sum(t.n for t in tiles) == len(spots)
    assert all(t.n <= cap and not t.overflow for t in tiles)
    for t in tiles:
        held = [
            p for p in spots if t.tile_min_x <= p[0] and t.tile_min_y <= p[1]
            and (p[0] < t.tile_max_x or t.tile_max_x == 1 == p[0]) and (p[1] < t.tile_max_y or t.tile_max_y == 1 == p[1])
        ]
        assert len(held) == t.n
        if t.depth:  # its parent holds too many
            side = 2.0 ** (1 - t.depth)
            x, y = t.ix // 2 * side, t.iy // 2 * side
            parent = [p for p in spots if x <= min(p[0], 1 - 1e-12) < x + side and y <= min(p[1], 1 - 1e-12) < y + side]
            assert len(parent) > cap


def test_points_that_cannot_be_parted(spark):
    tiles = T.adaptive_tiles(points(spark, [(0.3, 0.3)] * 20 + [(0.9, 0.9)]), boxes(spark, ("a", 0, 0, 1, 1)), cap=5, max_depth=4).collect()
    assert sorted((t.n, t.overflow, t.depth) for t in tiles) == [(1, False, 1), (20, True, 4)]


def test_distinct_points_never_overflow(spark):
    """A thousand points within a millionth of the box, some a billionth apart, at the default depth."""
    rng = random.Random(8)
    spots = [(0.3 + rng.random() * 1e-6, 0.7 + rng.random() * 1e-6) for _ in range(990)]
    spots += [(0.5 + n * 1e-9, 0.5) for n in range(10)]
    tiles = T.adaptive_tiles(points(spark, spots), boxes(spark, ("a", 0, 0, 1, 1)), cap=4).collect()
    assert sum(t.n for t in tiles) == 1000 and all(t.n <= 4 and not t.overflow for t in tiles)
    assert max(t.depth for t in tiles) > 2 * T.STEP
    same = T.adaptive_tiles(points(spark, [(0.3, 0.3)] * 20), boxes(spark, ("a", 0, 0, 1, 1)), cap=5).collect()
    assert [(t.n, t.overflow) for t in same] == [(20, True)]


def test_overlapping_and_empty_boxes(spark, rows):
    spots = [(x / 10, x / 10) for x in range(10)]
    found = boxes(spark, ("a", 0, 0, 0.55, 0.55), ("b", 0.35, 0.35, 1, 1), ("none", 5, 5, 6, 6), ("flat", 0.2, 0.2, 0.2, 0.2))
    tiles = T.adaptive_tiles(points(spark, spots), found, cap=3, max_depth=8)
    totals = {r.region: r.n for r in tiles.groupBy("region").sum("n").toDF("region", "n").collect()}
    assert totals == {"a": 6, "b": 6, "flat": 1}
    assert rows(T.tile_ids(points(spark, spots), found)) == [(n,) for n in range(10)]
