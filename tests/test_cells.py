import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rentlens.functions.clipping import nearest_part
from rentlens.operators import cells as C


def site_table(spark, sites):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "site_id long, x double, y double")


def area(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))) / 2


def cluster(rng, n):
    """A third in a tiny spot, the rest spread out."""
    spot = [(0.3 + rng.uniform(0, 1e-4), 0.7 + rng.uniform(0, 1e-4)) for _ in range(n // 3)]
    return spot + [(rng.random(), rng.random()) for _ in range(n - len(spot))]


CASES = {
    "random": lambda rng: [(rng.random(), rng.random()) for _ in range(300)],
    "cluster": lambda rng: cluster(rng, 300),
    "lattice": lambda rng: [(x / 10, y / 7) for x in range(12) for y in range(9)],
    "line": lambda rng: [(x / 10, x / 10) for x in range(30)],
    "circle": lambda rng: [(math.cos(a / 10), math.sin(a / 10)) for a in range(60)] + [(0.0, 0.0)],
    "one": lambda rng: [(0.5, 0.5)],
    "two": lambda rng: [(0.0, 0.0), (1.0, 0.0)],
}


@pytest.mark.parametrize("case", CASES)
def test_cells_equal_full_clipping_and_fill_the_envelope(spark, case):
    sites = CASES[case](random.Random(5))
    west, south, east, north = C.envelope_of((site_table(spark, sites), "x", "y"))
    found = {r.site_id: list(zip(r.vx, r.vy)) for r in C.site_cells(site_table(spark, sites)).collect()}
    assert sorted(found) == list(range(len(sites)))
    whole = (east - west) * (north - south)
    assert math.isclose(sum(map(area, found.values())), whole, rel_tol=1e-9)
    frame = [(west, south), (east, south), (east, north), (west, north)]
    for n, (x, y) in enumerate(sites):
        full = nearest_part(frame, x, y, np.array([s[0] for s in sites], float), np.array([s[1] for s in sites], float))
        assert math.isclose(area(found[n]), area(full), rel_tol=1e-7, abs_tol=1e-13 * whole)


def test_many_cuts_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "CUTS_PER_ROUND", 3)
    monkeypatch.setattr(C, "LEAF_SITES", 2)
    test_cells_equal_full_clipping_and_fill_the_envelope(spark, "circle")
    test_cells_equal_full_clipping_and_fill_the_envelope(spark, "cluster")


def test_sites_too_close_for_the_deepest_cell(spark, monkeypatch):
    monkeypatch.setattr(C, "DEEPEST", 3)
    monkeypatch.setattr(C, "LEAF_SITES", 8)
    test_cells_equal_full_clipping_and_fill_the_envelope(spark, "cluster")


@pytest.mark.parametrize("case", ["random", "lattice", "circle", "one"])
def test_rings_are_closed_and_clockwise(spark, case):
    sites = CASES[case](random.Random(6))
    cells = C.site_cells(site_table(spark, sites))
    rings = C.ring_from_edges(C.cell_edges(cells)).collect()
    assert len(rings) == len(sites)
    for row in rings:
        ring = [tuple(p) for p in row.ring]
        assert ring[0] == ring[-1]
        # Seen from the centre of gravity of a convex ring, every side of a clockwise one turns right.
        cx, cy = (sum(p[axis] for p in ring[1:]) / (len(ring) - 1) for axis in (0, 1))
        turns = [(p[0] - cx) * (q[1] - cy) - (p[1] - cy) * (q[0] - cx) for p, q in zip(ring, ring[1:])]
        assert max(turns) <= 1e-9 and min(turns) < 0


def edge_table(spark, edges):
    return spark.createDataFrame([(1, *map(float, e)) for e in edges], "site_id int, x1 double, y1 double, x2 double, y2 double")


def test_open_and_broken_cells(spark):
    three_sides = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1)]
    ring = C.ring_from_edges(edge_table(spark, three_sides)).first().ring
    assert len(ring) == 5 and {tuple(p) for p in ring} == {(0, 0), (1, 0), (1, 1), (0, 1)}
    broken = [(0, 0, 1, 0), (1, 1, 0, 1)]
    with pytest.raises(PySparkException, match="cell with 4 loose ends"):
        C.ring_from_edges(edge_table(spark, broken)).collect()


@pytest.mark.parametrize("case", ["random", "cluster", "lattice", "line", "circle", "one"])
def test_nearest_site(spark, case):
    rng = random.Random(7)
    sites = CASES[case](rng)
    spots = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(150)]
    spots += sites[:40] + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(sites, sites[1:60])]
    spots += [spots[0]] * 100
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(spots)], "id long, longitude double, latitude double")
    found = {r.id: (r.site_id, r.site_distance) for r in C.nearest_site(points, site_table(spark, sites)).collect()}
    assert len(found) == len(spots)
    for i, (x, y) in enumerate(spots):
        best = min(((x - sx) * (x - sx) + (y - sy) * (y - sy), n) for n, (sx, sy) in enumerate(sites))
        assert found[i][0] == best[1]
        assert math.isclose(found[i][1], math.sqrt(best[0]), rel_tol=1e-12)


def test_no_sites(spark):
    none = site_table(spark, [(0, 0)]).limit(0)
    assert C.site_cells(none).count() == 0
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, longitude double, latitude double")
    assert C.nearest_site(points, none).count() == 0


def test_text_site_ids(spark):
    sites = site_table(spark, CASES["random"](random.Random(8))).withColumn("site_id", F.concat(F.lit("s"), F.col("site_id").cast("string")))
    assert C.site_cells(sites).where("site_id like 's%'").count() == 300


def test_tasks_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from rentlens.session import local_session\n"
        "from rentlens.operators.cells import site_cells\n"
        "spark = local_session('2')\n"
        "sites = spark.range(5).selectExpr('id AS site_id', 'id / 3.0D AS x', 'id * id / 7.0D AS y')\n"
        "assert site_cells(sites).count() == 5\n"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, check=True, timeout=300)


def test_sites_must_differ(spark):
    for sites in ([(1, 0.0, 0.0), (1, 1.0, 1.0)], [(1, 0.0, 0.0), (2, 0.0, 0.0)]):
        with pytest.raises(ValueError):
            C.site_cells(spark.createDataFrame(sites, "site_id int, x double, y double"))
