"""Skewed joins, products and numbering give the same rows whichever way they run."""

import pytest
from pyspark.sql import functions as F

from rentlens.operators import batches, joins


@pytest.fixture(scope="module")
def facts(spark):
    # A third of all rows on key 0, some without a key.
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k")
    )


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(
        spark.createDataFrame([(0, -1)], "k long, v long")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(facts, dim, rows, how):
    expected = rows(facts.join(dim, ["k"], how))
    assert rows(joins.spread_join(facts, dim, ["k"], how, rows_per_salt=100)) == expected
    assert rows(joins.spread_join(facts, dim, ["k"], how, rows_per_salt=100, spread_by=["k", "id"])) == expected
    assert rows(joins.lookup_join(facts, dim, "k", how)) == expected
    assert rows(joins.lookup_join(facts, dim, "k", how, max_rows=3)) == expected


@pytest.mark.parametrize("bitmaps", [1, 4096])
def test_sieve_keeps_every_key_and_few_others(spark, monkeypatch, bitmaps):
    monkeypatch.setattr(joins, "BITMAPS", bitmaps)
    wide = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), F.col("id").alias("v"))
    keys = spark.range(0, 10_000).select(F.col("id").cast("int").alias("k"))
    flagged = joins.possible(wide, keys, ["k"], "flag")
    assert flagged.columns == ["k", "v", "flag"] and flagged.count() == 60_000
    of_keys, others = (flagged.where(F.col("k").between(0, 9_999) == inside).where("flag") for inside in (True, False))
    assert of_keys.count() == 30_000 and others.count() < (15_000 if bitmaps == 1 else 4_000)
    assert joins.possible(wide, keys.limit(0), ["k"], "flag").where("flag").count() == 0


@pytest.mark.parametrize("how", ["inner", "left_semi"])
@pytest.mark.parametrize("fits", [True, False])
def test_sieved_join_equals_plain_join(facts, dim, rows, monkeypatch, how, fits):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_, **__: fits)
    assert rows(joins.sieved_join(facts, dim, "k", how)) == rows(facts.join(dim, ["k"], how))


def test_hot_key_is_spread(spark, facts, dim):
    # Keep the shuffle's own partitions apart, small as they are here.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.spread_join(facts, dim, ["k"], rows_per_salt=100)
        hot = joined.where("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) > 4
    assert max(r["count"] for r in hot) < sum(r["count"] for r in hot) / 2


def test_size_check(spark):
    table = spark.range(100)
    assert joins.fits_broadcast(table, 100)
    assert not joins.fits_broadcast(table, 99)
    assert not joins.fits_broadcast(table, 100, weight=F.lit(2))
    assert joins.fits_broadcast(table.limit(0), 0)


def test_size_check_counts_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("text"), F.array_repeat(F.lit(1.5), 500).alias("numbers"))
    assert joins.fits_broadcast(wide, 100, max_bytes=100_000)
    assert not joins.fits_broadcast(wide, 100, max_bytes=20_000)


def test_beside_all(spark, rows):
    left, right = spark.range(7), spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert rows(joins.beside_all(left, right)) == rows(left.crossJoin(right))
    assert joins.beside_all(left, right.limit(0)).count() == 0
    with pytest.raises(ValueError):
        joins.beside_all(left, right, max_rows=2)


def test_rows_of_one_id_spread(spark):
    """A hot key whose rows share their id, as a join on the id itself has."""
    facts = spark.range(1000).select(F.lit(5).alias("id"), F.lit(1).alias("k"), F.col("id").alias("version"))
    dim = spark.createDataFrame([(1, "one")], "k int, name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.spread_join(facts, dim, ["k"], rows_per_salt=100)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in parts) == 1000 and len(parts) > 2


def test_number_rows_in_one_task_and_in_many(spark, rows, monkeypatch):
    keys = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("id"))
    expected = sorted((row.id, n + 1) for n, row in enumerate(sorted(keys.collect())))
    small = batches.number_rows(keys, "id")
    assert sorted(map(tuple, small.collect())) == expected
    monkeypatch.setattr(batches, "SINGLE_TASK_ROWS", 90)
    large = batches.number_rows(keys, "id")
    assert sorted(map(tuple, large.collect())) == expected


def test_batches_of_25(spark, monkeypatch):
    monkeypatch.setattr(batches, "SINGLE_TASK_ROWS", 13)
    ids = spark.range(60).unionByName(spark.range(10)).repartition(5)
    found = {row.batch_no: row for row in batches.batch_keys(ids).collect()}
    assert [found[n].n_keys for n in range(3)] == [25, 25, 10]
    assert found[1].keys == ",".join(str(n) for n in range(25, 50))
    assert (found[2].first_key, found[2].last_key) == (50, 59)


@pytest.mark.parametrize("total, held", [(5, 5), (999, 999), (1000, 1000), (1005, 1005), (1008, 1008), (1500, 1008)])
def test_pages_stop_after_the_cap(spark, total, held):
    pages = batches.paged(spark.range(total), ["id"], size=24, cap=1000)
    assert pages.count() == held
    last = pages.orderBy(F.desc("row_no")).first()
    assert (last.id, last.page_no, last.page_index) == (held - 1, (held - 1) // 24, (held - 1) // 24 * 24)


def test_pages_per_group(spark, rows):
    # Two thirds of the rows in one group.
    found = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 37 % 101).alias("v"))
    pages = batches.paged(found, ["v", "id"], size=10, cap=45, by=["g"])
    for group in ("a", "b"):
        expected = [row.id for row in found.where(F.col("g") == group).orderBy("v", "id").limit(50).collect()]
        held = pages.where(F.col("g") == group).orderBy("row_no").collect()
        assert [row.id for row in held] == expected
        assert [row.page_no for row in held] == [n // 10 for n in range(50)]


def test_more_rows_per_group_than_spark_limits(spark, monkeypatch):
    monkeypatch.setattr(batches, "GROUP_LIMIT", 7)
    found = spark.range(90).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("v")).where("g < 2 or id < 9")
    top = batches.top_per_group(found, ["g"], ["v", "id"], 18)
    for group in range(3):
        expected = [row.id for row in found.where(F.col("g") == group).orderBy("v", "id").limit(18).collect()]
        held = top.where(F.col("g") == group).orderBy("row_no").collect()
        assert [row.id for row in held] == expected and [row.row_no for row in held] == list(range(1, len(expected) + 1))


def test_page_size_limits(spark):
    for size in (0, 26):
        with pytest.raises(ValueError):
            batches.paged(spark.range(3), ["id"], size=size)
