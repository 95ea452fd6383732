"""Every query beside its SQL counterpart, and what its plan must not hold."""

import contextlib
import io

import pytest

import check
from __spark_entry__ import entry
from conftest import SMALLEST
from rentlens.plans.oracles import ORACLES
from rentlens.plans.queries import QUERIES

@pytest.fixture(scope="module")
def connection():
    return check.oracle_connection(SMALLEST)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    assert check.compare(spark, connection, SMALLEST, name) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", [
    "rent_by_region", "rent_map_table", "suitable", "assign_regions_diamond",
    "lookup", "within_miles", "adaptive_tiles", "nearest_site", "price_caps", "postcode_rollup",
])
def test_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALLEST))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(QUERIES["rent_by_region"](spark, SMALLEST))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in plan


def test_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["map_total"](spark, SMALLEST))
    assert "o_custkey" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = plan_of(QUERIES["suitable"](spark, SMALLEST))
    assert "IsNull(o_orderdate)" in plan and "GreaterThan(o_orderdate" in plan
    plan = plan_of(QUERIES["search_most_recent"](spark, SMALLEST))
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_latest_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["latest_per_listing"](spark, SMALLEST))
    assert plan.count("WindowGroupLimit") >= 2


def test_place_results_are_limited_before_the_shuffle(spark):
    """Also at the library's own cap, which is above Spark's limit for one group."""
    assert plan_of(QUERIES["place_results"](spark, SMALLEST)).count("WindowGroupLimit") >= 8


def test_criteria_of_the_accepted_list_reach_the_scan(spark):
    plan = plan_of(QUERIES["accepted_listings"](spark, SMALLEST))
    assert "IsNull(o_orderdate)" in plan and "GreaterThan(o_orderdate" in plan


def test_snapshots_are_written_by_all_tasks(spark, monkeypatch):
    from rentlens.plans import queries
    from rentlens.plans.views import Workload

    listings, write, tasks = Workload.listings, queries.tables.write_listings, []
    monkeypatch.setattr(Workload, "listings", lambda w: listings(w).repartition(3, "id"))
    monkeypatch.setattr(queries.tables, "write_listings", lambda df, *a: (tasks.append(df.rdd.getNumPartitions()), write(df, *a)))
    found = QUERIES["snapshot_json"](spark, SMALLEST)
    assert tasks == [3, 3, 3] and found.count() == spark.read.parquet(f"{SMALLEST}/orders.parquet").count()


def test_growing_map_is_many_objects(spark, tmp_path):
    import json

    from rentlens.plans.queries import MAP_ENTRIES, map_objects
    from rentlens.sources import read_search_places

    rows = spark.range(2500).selectExpr("concat('at ', id) AS name", "cast(id AS string) AS identifier", "id AS position")
    map_objects(rows, "name", rows["identifier"], "position").write.text(str(tmp_path / "map"))
    sizes = [len(json.loads(r["value"])) for r in spark.read.text(str(tmp_path / "map")).collect()]
    assert sorted(sizes) == [500, MAP_ENTRIES, MAP_ENTRIES]
    found = read_search_places(spark, str(tmp_path / "map"), lines=True)
    assert {(r["name"], r["identifier"]) for r in found.collect()} == {(f"at {n}", str(n)) for n in range(2500)}


def test_tiles_split_as_deep_as_needed(spark, monkeypatch):
    from rentlens.plans.views import Workload

    # All within one tile of depth 6.
    points = spark.range(500).selectExpr("id", "-0.9 + id * 1e-9 AS longitude", "51.1 + id * 1e-9 AS latitude")
    monkeypatch.setattr(Workload, "listings", lambda w: points)
    found = QUERIES["adaptive_tiles"](spark, SMALLEST).collect()
    assert sum(r["n"] for r in found) == 500 and max(r["depth"] for r in found) > 6
    assert all(r["n"] <= 120 and not r["overflow"] for r in found)
