"""Listing search: criteria compiled to a predicate, sort orders, pages, place lookup."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import instant_micros, moment, planar_distance
from ..schemas import (
    CHANNELS, DONT_SHOW, FURNISH_TYPES, LIST_CAP, LOOKUP_LIMIT, MAP_CAP, MUST_HAVE, PROPERTY_TYPES,
)
from .batches import number_rows, paged
from .joins import lookup_join
from .listings import map_listing_location, with_monthly_rent

SORT_TYPES = ("lowest_price", "highest_price", "nearest_first", "most_recent", "oldest_listed")


def _only(values: Sequence[str], known: Sequence[str], what: str) -> None:
    unknown = [v for v in values if v not in known]
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")


@dataclass(frozen=True)
class ListingQuery:
    """Search criteria. A zero or empty bound is no constraint."""

    # The defaults are the listing service's own.
    min_bedrooms: int = 1
    max_bedrooms: int = 10
    min_price: int = 0
    max_price: int | None = None
    min_bathrooms: int = 1
    max_bathrooms: int = 5
    page_size: int = 24
    radius: float = 0.0
    sort: str = "nearest_first"
    must_have: Sequence[str] = ()
    dont_show: Sequence[str] = DONT_SHOW
    furnish_types: Sequence[str] = FURNISH_TYPES
    property_types: Sequence[str] = ("flat", "detached", "semi-detached", "terraced")
    max_days_since_added: int | None = None
    channel: str = "RENT"
    include_let_agreed: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.page_size <= 25:
            raise ValueError("page_size must be from 1 to 25")
        if self.radius <= -1:
            raise ValueError("radius must be above -1")
        _only([self.sort], SORT_TYPES, "sort order")
        _only([self.channel], CHANNELS, "channel")
        _only(self.must_have, MUST_HAVE, "must-have")
        _only(self.dont_show, DONT_SHOW, "exclusion")
        _only(self.furnish_types, FURNISH_TYPES, "furnishing")
        _only(self.property_types, PROPERTY_TYPES, "property type")

    def predicate(self, columns: Sequence[str], as_of: dt.datetime | None = None, date_type: str = "timestamp") -> Column:
        """The criteria as one condition over a frame that has ``columns``."""
        price = F.col("monthly_rent") if self.channel == "RENT" else F.col("amount")
        terms = []
        for name, low, high in (
            (F.col("bedrooms"), self.min_bedrooms, self.max_bedrooms),
            (F.col("bathrooms"), self.min_bathrooms, self.max_bathrooms),
            (price, self.min_price, self.max_price),
        ):
            if low:
                terms.append(name >= low)
            if high:
                terms.append(name <= high)
        if self.property_types:
            terms.append(F.col("property_type").isin(*self.property_types))
        if "channel" in columns:
            terms.append(F.col("channel") == self.channel)
        if not self.include_let_agreed:
            terms.append(~F.coalesce("let_agreed", F.lit(False)))
        if self.max_days_since_added is not None:
            if as_of is None:
                raise ValueError("max_days_since_added needs as_of")
            oldest = moment(as_of - dt.timedelta(days=self.max_days_since_added), date_type)
            terms.append(F.col("first_visible_date") >= oldest)
        terms += self._keyword_terms("keywords" in columns)
        condition = F.lit(True)
        for term in terms:
            condition = condition & term
        return condition

    def _keyword_terms(self, has_keywords: bool) -> list[Column]:
        terms = []
        if "student" in self.dont_show:
            terms.append(~F.coalesce("students", F.lit(False)))
        words = F.coalesce("keywords", F.array().cast("array<string>")) if has_keywords else None
        if self.must_have and words is None:
            raise ValueError("must_have needs a keywords column")
        if words is None and self.furnish_types and set(self.furnish_types) != set(FURNISH_TYPES):
            raise ValueError("furnish_types needs a keywords column")
        if words is None:
            return terms
        terms += [F.array_contains(words, wanted) for wanted in self.must_have]
        if self.dont_show:
            terms.append(~F.arrays_overlap(words, F.array(*map(F.lit, self.dont_show))))
        if self.furnish_types and set(self.furnish_types) != set(FURNISH_TYPES):
            terms.append(F.arrays_overlap(words, F.array(*map(F.lit, self.furnish_types))))
        return terms

    def order(self) -> list[Column]:
        """Sort columns, id last so that the order is total."""
        first = {
            "lowest_price": F.col("monthly_rent").asc_nulls_last(),
            "highest_price": F.col("monthly_rent").desc_nulls_last(),
            "nearest_first": F.col("distance").asc_nulls_last(),
            "most_recent": F.col("first_visible_date").desc_nulls_last(),
            "oldest_listed": F.col("first_visible_date").asc_nulls_last(),
        }[self.sort]
        return [first, F.col("id").asc()]


def with_distance(df: DataFrame, centre: tuple[float, float] | None) -> DataFrame:
    """Add ``distance``: planar distance to ``centre`` (latitude, longitude); 0 without one."""
    if centre is None:
        return df.withColumn("distance", F.lit(0.0))
    latitude, longitude = centre
    return df.withColumn(
        "distance", planar_distance("latitude", "longitude", F.lit(float(latitude)), F.lit(float(longitude)))
    )


def matching(
    df: DataFrame, query: ListingQuery, as_of: dt.datetime | None = None,
    centre: tuple[float, float] | None = None,
) -> DataFrame:
    """All listings that meet the criteria, with ``monthly_rent`` and ``distance``."""
    if "monthly_rent" not in df.columns:
        df = with_monthly_rent(df)
    date_type = dict(df.dtypes).get("first_visible_date", "timestamp")
    return with_distance(df.where(query.predicate(df.columns, as_of, date_type)), centre)


def search(
    df: DataFrame, query: ListingQuery, as_of: dt.datetime | None = None,
    centre: tuple[float, float] | None = None, cap: int = LIST_CAP,
) -> DataFrame:
    """The result list: matching listings in the query's order, in pages up to ``cap``."""
    return paged(matching(df, query, as_of, centre), query.order(), query.page_size, cap)


def map_search(
    df: DataFrame, query: ListingQuery, as_of: dt.datetime | None = None,
    centre: tuple[float, float] | None = None, cap: int = MAP_CAP,
) -> tuple[DataFrame, DataFrame]:
    """The slim page (id, location; at most ``cap``) and a one-row frame with the total."""
    found = matching(df, query, as_of, centre)
    page = map_listing_location(found.orderBy(*query.order()).limit(cap))
    return page, found.agg(F.count("*").alias("total"))


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The listings with these ids; ids may repeat."""
    return df.join(ids.select("id"), "id", "left_semi")


def distinct_ids(*areas: DataFrame) -> DataFrame:
    """Ids found in any of the areas, each once."""
    union = areas[0].select("id")
    for area in areas[1:]:
        union = union.unionByName(area.select("id"))
    return union.distinct()


def _review_keys(df: DataFrame, centre: tuple[float, float] | None) -> DataFrame:
    date_type = dict(df.dtypes)["first_visible_date"]
    newest = F.coalesce(-instant_micros("first_visible_date", date_type), F.lit(0).cast("bigint"))
    return with_distance(df, centre).withColumn("recency_key", newest)


def with_review_rank(df: DataFrame, centre: tuple[float, float] | None = None) -> DataFrame:
    """Add distance, recency_key and ``rank``: the row's number in review order, from 1."""
    keyed = _review_keys(df, centre).withColumn("_order", F.struct("distance", "recency_key", "id"))
    return number_rows(keyed, "_order", "rank").drop("_order")


def rank_for_review(df: DataFrame, centre: tuple[float, float] | None = None) -> DataFrame:
    """Listings nearest to ``centre`` first, then newest first; no date counts as key 0.

    The sort is global: Spark range-partitions it, so it scales with the cluster.
    """
    return _review_keys(df, centre).orderBy("distance", "recency_key", "id")


def _grams(text: Column) -> Column:
    """The distinct runs of 1, 2 and 3 characters of a text."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.substring(text, at, F.lit(n)))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def highlight(text: Column, folded_query: Column) -> Column:
    """Cut ``text`` into spans, those equal to the query (ignoring case) marked."""
    between = F.split(F.replace(F.lower(text), folded_query, F.lit("\u0001")), F.lit("\u0001"), -1)
    size = F.length(folded_query)
    start_after = lambda i: F.aggregate(  # noqa: E731 - end of the spans before part i
        F.slice(between, F.lit(1), i), F.lit(0), lambda total, part: total + F.length(part) + size
    )
    spans = F.transform(between, lambda part, i: F.array(
        F.struct(F.substring(text, start_after(i) + 1, F.length(part)).alias("text"), F.lit(False).alias("highlighted")),
        F.struct(
            F.substring(text, start_after(i) + 1 + F.length(part), F.when(i < F.size(between) - 1, size).otherwise(0)).alias("text"),
            F.lit(True).alias("highlighted"),
        ),
    ))
    return F.filter(F.flatten(spans), lambda span: span["text"] != "")


def lookup_places(queries: DataFrame, places: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Places whose name contains the query text, best first, ``limit`` per query.

    ``queries(query)``, ``places(name, identifier)``. Exact match, then prefix, then
    anywhere; then by name. Both sides meet on a run of up to three characters: a name
    that contains the query contains the query's first run, so no pair outside a shared
    run is ever formed. The limit is the feature: the top matches of each query.
    """
    asked = queries.select("query").distinct().withColumn("_q", F.lower(F.trim("query"))).where("_q <> ''")
    asked = asked.withColumn("_gram", F.left("_q", F.lit(3)))
    named = places.select("name", "identifier").withColumn("_n", F.lower("name"))
    named = named.withColumn("_gram", F.explode(_grams(F.col("_n"))))
    met = lookup_join(named, asked, "_gram").where(F.contains("_n", "_q"))
    score = F.when(F.col("_n") == F.col("_q"), 0).when(F.startswith("_n", "_q"), 1).otherwise(2)
    met = met.withColumn("match_class", score)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("match_class", "name", "identifier"))
    return (
        met.withColumn("rank", rank).where(F.col("rank") <= limit)
        .withColumn("highlights", highlight(F.col("name"), F.col("_q")))
        .select("query", "rank", "name", "identifier", "match_class", "highlights")
    )
