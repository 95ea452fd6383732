import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentlens.operators import search as S

NOW = dt.datetime(2024, 6, 30, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def listings(spark):
    return spark.range(400).select(
        "id", (F.col("id") % 6).cast("int").alias("bedrooms"), (F.col("id") % 4 + 1).cast("int").alias("bathrooms"),
        (500 + F.col("id") * 10).cast("int").alias("amount"), F.lit("monthly").alias("frequency"),
        (51 + F.col("id") / 1000).alias("latitude"), F.lit(0.0).alias("longitude"), (F.col("id") % 10 == 0).alias("let_agreed"),
        (F.col("id") % 7 == 0).alias("students"), F.lit("flat").alias("property_type"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("garden"), F.lit("parking"), F.lit("furnished")))
        .when(F.col("id") % 3 == 1, F.array(F.lit("houseShare"), F.lit("unfurnished"))).alias("keywords"),
        F.expr("timestamp'2024-06-30 00:00:00' - make_interval(0, 0, 0, cast(id % 20 as int))").alias("first_visible_date"),
        F.when(F.col("id") < 300, "RENT").otherwise("BUY").alias("channel"),
    )


def ids(df):
    return [row.id for row in df.collect()]


def python_match(n, **limits):
    keywords = {0: {"garden", "parking", "furnished"}, 1: {"houseShare", "unfurnished"}, 2: set()}[n % 3]
    return (
        limits.get("low", 1) <= n % 6 <= 10 and 1 <= n % 4 + 1 <= 5 and n < 300 and n % 10 != 0 and n % 7 != 0
        and "houseShare" not in keywords and limits.get("must", set()) <= keywords
        and 500 + n * 10 <= limits.get("max_price", 10**9) and n % 20 <= limits.get("days", 99)
    )


def test_default_query(listings):
    found = S.search(listings, S.ListingQuery(sort="lowest_price"))
    assert ids(found.orderBy("row_no")) == [n for n in range(400) if python_match(n)]


def test_full_query(listings):
    query = S.ListingQuery(
        min_bedrooms=2, max_price=2000, must_have=("garden", "parking"), max_days_since_added=7, sort="most_recent", page_size=5,
    )
    expected = [n for n in range(400) if python_match(n, low=2, max_price=2000, must={"garden", "parking"}, days=7)]
    found = S.search(listings, query, as_of=NOW).orderBy("row_no").collect()
    assert [r.id for r in found] == sorted(expected, key=lambda n: (n % 20, n))
    assert [r.page_no for r in found] == [n // 5 for n in range(len(found))]


def test_zero_days_is_a_limit_but_zero_price_is_none(listings):
    today = S.ListingQuery(sort="oldest_listed", max_days_since_added=0)
    assert all(r.id % 20 == 0 for r in S.search(listings, today, as_of=NOW).collect())
    assert S.search(listings, S.ListingQuery(sort="oldest_listed", max_price=0)).count() == sum(map(python_match, range(400)))


def test_furnishing(listings):
    query = S.ListingQuery(sort="lowest_price", furnish_types=("furnished",))
    assert all(n % 3 == 0 for n in ids(S.search(listings, query)))


@pytest.mark.parametrize("sort, key", [
    ("lowest_price", lambda n: (n, n)), ("highest_price", lambda n: (-n, n)), ("nearest_first", lambda n: (abs(51 + n / 1000 - 51.1), n)),
    ("most_recent", lambda n: (n % 20, n)), ("oldest_listed", lambda n: (-(n % 20), n)),
])
def test_sort_orders(listings, sort, key):
    query = S.ListingQuery(sort=sort)
    found = ids(S.search(listings, query, centre=(51.1, 0.0)).orderBy("row_no"))
    assert found == sorted((n for n in range(400) if python_match(n)), key=key)


def test_map_page_and_total(listings):
    page, total = S.map_search(listings, S.ListingQuery(sort="lowest_price"), cap=10)
    assert page.count() == 10 and page.columns == ["id", "location"]
    assert total.first().total == sum(map(python_match, range(400)))


@pytest.mark.parametrize("wrong", [
    {"page_size": 0}, {"page_size": 26}, {"radius": -1}, {"sort": "best"}, {"channel": "SELL"}, {"must_have": ("pool",)},
    {"dont_show": ("boats",)}, {"furnish_types": ("half",)}, {"property_types": ("castle",)},
])
def test_criteria_are_checked(wrong):
    with pytest.raises(ValueError):
        S.ListingQuery(**wrong)


def test_review_order(spark):
    stamps = [None, "2024-01-02 00:00:00.000001", "2024-01-02 00:00:00", "2024-03-01 00:00:00"]
    found = spark.createDataFrame([(n, 51.0, 0.0, s) for n, s in enumerate(stamps)] + [(9, 50.0, 0.0, stamps[1])], "id long, latitude double, longitude double, d string")
    found = found.withColumn("first_visible_date", F.col("d").cast("timestamp"))
    assert ids(S.rank_for_review(found, (51.0, 0.0))) == [3, 1, 2, 0, 9]
    assert ids(S.rank_for_review(found)) == [3, 1, 9, 2, 0]


def test_lookup(spark):
    places = spark.createDataFrame(
        [("Barbican Station", "STATION^569"), ("Old Barbican", "REGION^1"), ("barbican", "REGION^2"), ("Angel", "STATION^245"), ("B", "X^1")],
        "name string, identifier string",
    )
    queries = spark.createDataFrame([("Barbican",), ("b",), ("an",), ("  ",), ("nothing here",)], "query string")
    found = S.lookup_places(queries, places).orderBy("query", "rank").collect()
    assert [(r.query, r.identifier, r.match_class) for r in found] == [
        ("Barbican", "REGION^2", 0), ("Barbican", "STATION^569", 1), ("Barbican", "REGION^1", 2),
        ("an", "STATION^245", 1), ("an", "STATION^569", 2), ("an", "REGION^1", 2), ("an", "REGION^2", 2),
        ("b", "X^1", 0), ("b", "STATION^569", 1), ("b", "REGION^2", 1), ("b", "REGION^1", 2),
    ]
    assert S.lookup_places(queries, places, limit=1).count() == 3


def test_ids_of_areas(spark, rows):
    a, b = spark.range(5), spark.range(3, 8)
    assert rows(S.distinct_ids(a, b, a)) == [(n,) for n in range(8)]
    assert rows(S.by_ids(spark.range(10), b.unionByName(b))) == [(n,) for n in range(3, 8)]


def test_furnishing_needs_keywords(spark):
    from rentlens.operators.search import ListingQuery

    with pytest.raises(ValueError, match="furnish_types needs a keywords column"):
        ListingQuery(furnish_types=("furnished",)).predicate(["id"])


def test_sub_types_map_to_types(spark):
    from rentlens.operators.listings import with_listing_columns
    from rentlens.schemas import LISTING

    rows = spark.createDataFrame([], LISTING).unionByName(
        spark.sql("select 1L as id, 'Maisonette' as propertySubType union all select 2L, 'Flat'"), allowMissingColumns=True)
    found = with_listing_columns(rows, {"maisonette": "flat"}).select("id", "property_type").collect()
    assert sorted(map(tuple, found)) == [(1, "flat"), (2, "flat")]
