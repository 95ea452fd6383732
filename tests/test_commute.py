import pytest
from pyspark.sql import functions as F

from rentlens.operators import commute as C, snapshots as S


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "name string, latitude double, longitude double")


def test_best_journey_takes_the_first_of_equal_ones(spark, rows):
    journeys = spark.createDataFrame(
        [(1, "a", 2, 30), (1, "a", 1, 30), (1, "a", 0, 31), (1, "b", 0, 5)], "id long, name string, position int, duration int"
    )
    assert rows(C.best_journeys(journeys, ["id", "name"])) == [(1, "a", 1, 30), (1, "b", 0, 5)]


def test_pairs_and_missing_journeys(spark, places, rows):
    listings = spark.createDataFrame([(1, 9.0, 8.0), (2, 7.0, 6.0)], "id long, latitude double, longitude double")
    pairs = C.od_pairs(listings, places)
    assert rows(pairs) == [(1, 9.0, 8.0, "a", 1.0, 2.0), (1, 9.0, 8.0, "b", 3.0, 4.0), (2, 7.0, 6.0, "a", 1.0, 2.0), (2, 7.0, 6.0, "b", 3.0, 4.0)]
    stored = spark.createDataFrame([(9.0, 8.0, 1.0, 2.0), (9.0, 8.0, 1.0, 2.0), (7.0000001, 6.0, 3.0, 4.0)], "src_lat double, src_lon double, dst_lat double, dst_lon double")
    key = list(S.PAIR)
    assert rows(C.missing_pairs(pairs, stored, key).select("id", "name")) == [(1, "b"), (2, "a"), (2, "b")]
    close = C.missing_pairs(C.rounded(pairs, key, 4), C.rounded(stored, key, 4), key)
    assert rows(close.select("id", "name")) == [(1, "b"), (2, "a")]


def test_missing_journeys_are_the_missing_pairs(spark, places, rows):
    origins = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long")
    stored = spark.createDataFrame([(1, "a"), (1, "a"), (1, "elsewhere"), (2, "a"), (2, "b"), (9, "a")], "id long, name string")
    assert rows(C.missing_journeys(origins, places, stored)) == [(1, "b"), (3, "a"), (3, "b")]
    assert rows(C.missing_journeys(origins, places.limit(0), stored)) == []


def test_best_journey_has_a_duration(spark, rows):
    journeys = spark.createDataFrame([(1, "a", 0, None), (1, "a", 1, 30), (2, "a", 0, None)], "id long, name string, position int, duration int")
    assert rows(C.best_journeys(journeys, ["id", "name"])) == [(1, "a", 1, 30), (2, "a", 0, None)]


def test_commute_by_coordinates(spark, places):
    listings = spark.createDataFrame([(1, 9.0, 8.0), (2, 9.0, 8.0), (3, 7.0, 6.0)], "id long, src_lat double, src_lon double")
    journeys = spark.createDataFrame([(9.0, 8.0, "a", 45), (9.0, 8.0, "b", 20), (7.0, 6.0, "a", 45)], "src_lat double, src_lon double, name string, duration int")
    checked = C.commute_ok(listings, places, journeys, 45, origin=("src_lat", "src_lon"))
    assert {r.id: r.commute_ok for r in checked.collect()} == {1: True, 2: True, 3: False}


def test_gate(spark, places):
    searched = spark.createDataFrame([("s1", "STATION^1"), ("s2", "STATION^2"), ("r", "REGION^3")], "name string, identifier string")
    journeys = spark.createDataFrame([("s1", "a", 10), ("s1", "b", 10), ("s2", "a", 10)], "name string, destination string, duration int")
    gated = C.gate_places(searched, places.withColumnRenamed("name", "destination"), journeys, 30)
    assert {r.name for r in gated.collect()} == {"s1", "r"}


def test_merging_journeys(spark):
    cache = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0, [30]), (1.0, 1.0, 3.0, 3.0, [40]), (5.0, 5.0, 5.0, 5.0, None)], "src_lat double, src_lon double, dst_lat double, dst_lon double, journeys array<int>")
    updates = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0, [30]), (1.0, 1.0, 3.0, 3.0, [39, 50]), (4.0, 4.0, 4.0, 4.0, [9])], cache.schema)
    merged = {(r.src_lat, r.dst_lat): (r.journeys, r.change) for r in S.merge_journeys(cache, updates).collect()}
    assert merged == {(1, 2): ([30], "same"), (1, 3): ([39, 50], "changed"), (4, 4): ([9], "new"), (5, 5): (None, "kept")}
    assert S.changed_journeys(cache, updates).count() == 2


def test_updates_with_equal_keys(spark):
    schema = "src_lat double, src_lon double, dst_lat double, dst_lon double, journeys array<int>, no int"
    cache = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0, [30], 0)], schema)
    updates = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0, [5], 1), (1.0, 1.0, 2.0, 2.0, [6], 2), (1.0, 1.0, 2.0, 2.0, [7], None)], schema)
    with pytest.raises(Exception, match="key given twice"):
        S.merge_journeys(cache, updates).collect()
    assert [r.journeys for r in S.merge_journeys(cache, updates, order=["no"]).collect()] == [[6]]


def test_merging_places(spark):
    existing = spark.createDataFrame([("one", "STATION^1", 0), ("two", "STATION^2", 1)], "name string, identifier string, position int")
    updates = spark.createDataFrame([("two", "STATION^9"), ("three", "REGION^3")], "name string, identifier string")
    merged = {r.name: (r.identifier, r.position) for r in S.merge_search_places(existing, updates).collect()}
    assert merged == {"one": ("STATION^1", 0), "two": ("STATION^9", 1), "three": ("REGION^3", 2)}
    with pytest.raises(Exception, match="name given twice: t"):
        S.merge_search_places(existing, updates.unionByName(updates)).collect()


def test_latest_per_listing(spark, rows):
    snapshots = spark.createDataFrame(
        [(1, 100, "old"), (1, 200, "new"), (2, 100, "only"), (3, 200, "y"), (3, 200, "x"), (3, 100, "a")], "id long, snapshot_ts long, note string"
    )
    latest = S.latest_per_listing(snapshots, ties=["note"])
    assert rows(latest) == [(1, 200, "new"), (2, 100, "only"), (3, 200, "x")]
    assert rows(S.latest_per_listing(snapshots)) == rows(S.latest_per_listing(snapshots.orderBy("note")))


@pytest.mark.parametrize("bits", [63, 2])
@pytest.mark.parametrize("n_places", [1, 2, 3, 63, 64])
def test_every_place_must_be_reached(spark, monkeypatch, n_places, bits):
    monkeypatch.setattr(C, "BITS", bits)
    places = spark.range(n_places).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"))
    # Origin k has a short journey to the first k places, twice over, and a long one to all.
    journeys = spark.range(n_places + 2).withColumnRenamed("id", "k").join(spark.range(n_places + 1).withColumnRenamed("id", "p")).select(
        F.col("k").alias("id"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("name"),
        F.explode(F.array(F.lit(99), F.when(F.col("p") < F.col("k"), 10).otherwise(46), F.lit(46))).alias("duration"),
    )
    checked = C.commute_ok(spark.range(n_places + 3), places, journeys, 45)
    assert {r.id for r in checked.where("commute_ok").collect()} == {n_places, n_places + 1}


def test_very_many_new_places_are_numbered_by_many_tasks(spark, monkeypatch):
    from rentlens.operators import batches

    monkeypatch.setattr(batches, "SINGLE_TASK_ROWS", 7)
    existing = spark.createDataFrame([("b", "REGION^1", 0), ("a", "REGION^2", 1)], "name STRING, identifier STRING, position INT")
    updates = spark.range(40).selectExpr("concat('n', lpad(id, 2, '0')) AS name", "concat('STATION^', id) AS identifier")
    merged = {r.name: (r.identifier, r.position, r.change) for r in S.merge_search_places(existing, updates).collect()}
    assert merged == {
        "b": ("REGION^1", 0, "kept"), "a": ("REGION^2", 1, "kept"),
        **{f"n{n:02}": (f"STATION^{n}", 2 + n, "new") for n in range(40)}}


def test_numbers_may_have_any_name(spark, monkeypatch):
    from rentlens.operators import batches

    monkeypatch.setattr(batches, "SINGLE_TASK_ROWS", 7)
    keys = spark.range(30).withColumn("_part", -F.col("id"))
    for number in ("_place", "_rows", "_before", "_number_place"):
        found = batches.number_rows(keys, "id", number)
        assert found.columns == ["id", "_part", number]
        assert sorted(map(tuple, found.collect())) == [(n, -n, n + 1) for n in range(30)]
