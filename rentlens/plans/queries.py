"""One query per operator over the sample tables; names match ``oracles.ORACLES``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F

from ..operators import (
    batches, cells, commute, postcodes, regions, review, rules, search, snapshots, stations, tiles,
)
from ..operators.listings import with_floor_area, with_listing_columns, with_monthly_rent
from ..schemas import MODE_IDS
from ..session import scratch_path
from ..sources import changes, readers, tables
from ..streaming import (
    read_upserts, start_append, start_suitable, start_upsert, stream_latest, stream_new_listings, stream_unseen_listings,
)
from . import jobs
from .views import VIEWS, Workload

Query = Callable[[SparkSession, str], DataFrame]

NOW = dt.datetime(2000, 1, 1, 12)
CENTRE = (51.5, -0.5)
MAX_RENT, MAX_DAYS, MAX_MINUTES, MIN_SQM = 2200, 900, 45, 40
HOST = "https://listings.example"
ENVELOPE_MARGIN = 0.1
IDS_PER_FILE = 4000
# Journey results are much larger as JSON than in the table, so they are stored compressed; such a file is read by
# one task, so a task writes one per so many records.
RESULTS_PER_FILE = 100_000

QUERIES: dict[str, Query] = {}


def query(function: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[function.__name__] = lambda spark, folder: function(Workload(spark, folder))
    return function


def rounded(column: Column | str, name: str) -> Column:
    return F.round(column, 6).alias(name)


def number(name: str) -> Column:
    """A whole number that may be null, as double: clients show it alike in both engines."""
    return F.col(name).cast("double").alias(name)


def _regions(w: Workload) -> DataFrame:
    return regions.regions_from_boxes(w.view("wl_regions"))


# Regions and rents -------------------------------------------------------------------------

@query
def rent_by_region(w: Workload) -> DataFrame:
    means = regions.rent_by_region(regions.assign_regions(w.listings(), _regions(w)))
    return means.select("region", rounded("mean_rent", "mean_rent"), "priced", "unpriced")


@query
def assign_regions(w: Workload) -> DataFrame:
    return regions.assign_regions(w.listings(), _regions(w)).select("id", "region")


@query
def assign_regions_diamond(w: Workload) -> DataFrame:
    """Slanted, overlapping rings: a diamond twice as wide as each box."""
    box = w.view("wl_regions")
    mid_x, mid_y = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    # A reach at which no listing lies on a border; borders have tests of their own.
    reach = 0.2003
    points = [(mid_x - reach, mid_y), (mid_x, mid_y - reach), (mid_x + reach, mid_y), (mid_x, mid_y + reach)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])
    diamonds = box.select("region", F.lit(0).alias("part"), F.lit(0).alias("ring_no"), ring.alias("ring"))
    found = regions.assign_regions(w.listings(), diamonds)
    return found.groupBy("region").agg(F.count("*").alias("listings"), F.sum("id").alias("id_sum"))


@query
def assign_regions_holed(w: Workload) -> DataFrame:
    """Boxes with a hole of half their size, by both rules for rings."""
    box = w.view("wl_regions")
    inner = regions.box_ring(
        F.col("min_lon") + 0.05, F.col("min_lat") + 0.05, F.col("max_lon") - 0.05, F.col("max_lat") - 0.05
    )
    holes = box.select("region", F.lit(0).alias("part"), F.lit(1).alias("ring_no"), inner.alias("ring"))
    both = _regions(w).unionByName(holes)
    found = [
        regions.assign_regions(w.listings(), both, rule=rule).select("region", F.lit(rule).alias("rule"), "id")
        for rule in ("union", "even_odd")
    ]
    return found[0].unionByName(found[1]).groupBy("region", "rule").agg(
        F.count("*").alias("listings"), F.sum("id").alias("id_sum")
    )


@query
def rent_map_table(w: Workload) -> DataFrame:
    table = jobs.rent_map(w.listings(), _regions(w), 2000.0)
    return table.select("region", rounded("mean_rent", "mean_rent"), rounded("shade", "shade"), "label")


@query
def rent_range(w: Workload) -> DataFrame:
    means = regions.rent_by_region(regions.assign_regions(w.listings(), _regions(w)))
    row = regions.rent_range(means, 2000.0)
    return row.select(*[rounded(c, c) for c in ("min_price", "observed_max", "max_price")])


@query
def bounding_boxes(w: Workload) -> DataFrame:
    box = regions.bounding_boxes(_regions(w))
    ring = F.array_join(F.transform("box", lambda p: F.concat_ws(" ", p["x"].cast("decimal(9,6)").cast("string"), p["y"].cast("decimal(9,6)").cast("string"))), ",")
    return box.select("region", "min_x", "min_y", "max_x", "max_y", ring.alias("box"))


@query
def orient_clockwise(w: Workload) -> DataFrame:
    turned = regions.orient_clockwise(_regions(w))
    ring = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["x"].cast("decimal(9,6)").cast("string"), p["y"].cast("decimal(9,6)").cast("string"))), ",")
    return turned.select("region", ring.alias("ring"))


@query
def region_edges(w: Workload) -> DataFrame:
    return regions.region_edges(_regions(w)).select("region", "edge_no", "x1", "y1", "x2", "y2")


# Rents, sizes and rules --------------------------------------------------------------------

@query
def monthly_rent(w: Workload) -> DataFrame:
    return with_monthly_rent(w.listings()).select("id", rounded("monthly_rent", "monthly_rent"))


@query
def floor_area(w: Workload) -> DataFrame:
    return with_floor_area(w.listings()).select("id", number("square_feet"), number("square_metres"))


def _all_rules(w: Workload) -> list[rules.Rule]:
    return [
        rules.rule_residential(), rules.rule_has_price(), rules.rule_min_area(MIN_SQM), rules.rule_available(),
        rules.rule_max_rent(MAX_RENT), rules.rule_recent(NOW, MAX_DAYS, "timestamp_ntz"),
    ]


def _single_rule(position: int) -> Callable[[Workload], DataFrame]:
    def run(w: Workload) -> DataFrame:
        return rules.classify(w.listings(), [_all_rules(w)[position]]).select("id", "skip_rule", "skip_reason")
    return run


for _position, _name in enumerate(
    ("rule_residential", "rule_has_price", "rule_min_area", "rule_available", "rule_max_rent", "rule_recent")
):
    _run = _single_rule(_position)
    _run.__name__ = _name
    query(_run)


@query
def classify(w: Workload) -> DataFrame:
    return rules.classify(w.listings(), _all_rules(w)).select("id", "skip_rule", "skip_reason")


@query
def suitable(w: Workload) -> DataFrame:
    return rules.suitable(w.listings(), _all_rules(w)).select("id", "amount", "frequency")


@query
def funnel(w: Workload) -> DataFrame:
    return rules.funnel(rules.classify(rules.exclude_seen(w.listings(), w.view("wl_history")), _all_rules(w)))


@query
def exclude_seen(w: Workload) -> DataFrame:
    return rules.exclude_seen(w.listings(), w.view("wl_history")).select("id")


@query
def drop_let_agreed(w: Workload) -> DataFrame:
    return rules.drop_let_agreed(w.listings().select("id"), w.view("wl_history"))


@query
def price_caps(w: Workload) -> DataFrame:
    """Listings within the cap of their region, per region."""
    found = regions.assign_regions(with_monthly_rent(w.listings()), _regions(w)).withColumnRenamed("region", "name")
    capped = rules.with_price_cap(found, w.view("wl_caps"), MAX_RENT)
    judged = rules.classify(capped, [rules.rule_max_rent("cap")])
    return judged.groupBy("name", "cap").agg(
        F.count("*").alias("listings"), F.count_if(F.col("skip_rule").isNull()).alias("within_cap")
    )


# Commute -----------------------------------------------------------------------------------

@query
def suitable_with_commute(w: Workload) -> DataFrame:
    judged = jobs.judged_listings(
        w.listings(), w.view("wl_places"), w.journeys(), NOW, MAX_RENT, MAX_DAYS, MAX_MINUTES, MIN_SQM,
        history=w.view("wl_history"),
    )
    return judged.select("id", "skip_rule", "skip_reason")


@query
def accepted_listings(w: Workload) -> DataFrame:
    """The list a person reviews, in order."""
    accepted = jobs.accepted_listings(
        w.listings(), w.view("wl_places"), w.journeys(), NOW, MAX_RENT, MAX_DAYS, MAX_MINUTES, MIN_SQM,
        history=w.view("wl_history"), centre=CENTRE,
    )
    return accepted.select("rank", "id", rounded("distance", "distance"), "recency_key")


@query
def commute_ok(w: Workload) -> DataFrame:
    return commute.commute_ok(w.listings(), w.view("wl_places"), w.journeys(), MAX_MINUTES).select("id", "commute_ok")


@query
def best_journeys(w: Workload) -> DataFrame:
    best = commute.best_journeys(w.journeys(), ["id", "name"], ["duration", "position", "tie", "mode"])
    return best.select("id", "name", "duration", "position", "mode")


@query
def od_pairs(w: Workload) -> DataFrame:
    return commute.od_pairs(w.listings(), w.view("wl_places"))


@query
def missing_pairs(w: Workload) -> DataFrame:
    return commute.missing_journeys(w.listings(), w.view("wl_places"), w.journeys())


@query
def gate_places(w: Workload) -> DataFrame:
    gated = commute.gate_places(
        w.view("wl_search_places").withColumnRenamed("position", "station"),
        w.view("wl_places").withColumnRenamed("name", "place"),
        w.journeys().withColumnRenamed("name", "place"), 16, origin=("station",), destination=("place",),
    )
    return gated.select("station", "name", "identifier")


@query
def target_arrival(w: Workload) -> DataFrame:
    asked = w.listings().select(
        "id", F.expr("timestampadd(MINUTE, CAST(id % 1440 AS INT), first_visible_date)").alias("as_of")
    )
    return commute.with_target_arrival(asked)


# Snapshots, history, merges ----------------------------------------------------------------

_TIES = ["tie1", "tie2", "tie3", "amount"]


@query
def latest_per_listing(w: Workload) -> DataFrame:
    return jobs.merged_snapshots(w.view("wl_snapshots"), ties=_TIES)


@query
def append_unseen(w: Workload) -> DataFrame:
    """The history table after the listings were appended to it."""
    path = scratch_path(w.spark, "history")
    tables.append_unseen(w.view("wl_history"), path, reset=True)
    tables.append_unseen(w.listings().select("id", "let_agreed"), path)
    return w.spark.read.parquet(path).select("id", "let_agreed")


def _journey_sides(w: Workload) -> tuple[DataFrame, DataFrame]:
    def shortest(condition: str) -> DataFrame:
        return w.journeys().where(condition).groupBy("id", "name").agg(F.min("duration").alias("duration"))

    return shortest("position <= 4"), shortest("position >= 3")


@query
def merge_journeys(w: Workload) -> DataFrame:
    """The published journey cache after an update was merged into it."""
    cache, updates = _journey_sides(w)
    base = scratch_path(w.spark, "journeys")
    tables.publish_table(cache, base)
    merged = snapshots.merge_journeys(tables.current_table(w.spark, base), updates, ["id", "name"], ["duration"])
    tables.publish_table(merged, base)
    return tables.current_table(w.spark, base)


@query
def journey_updates(w: Workload) -> DataFrame:
    """The journey cache as a base, two updates as changes to it, and a fold between: every row and the version that wrote it."""
    cache, updates = _journey_sides(w)
    base = scratch_path(w.spark, "journey-changes")
    changes.publish_base(cache, base, ["id", "name"], n_ranges=8)
    changes.publish_changes(updates, base)
    changes.fold_changes(w.spark, base, share=0.0)
    late = updates.where("id % 50 = 0").withColumn("duration", F.col("duration") + 1)
    changes.publish_changes(late, base)
    return changes.current_rows(w.spark, base).select("id", "name", "duration", (F.col("version") == 4).alias("late"))


@query
def changed_journeys(w: Workload) -> DataFrame:
    cache, updates = _journey_sides(w)
    return snapshots.changed_journeys(cache, updates, ["id", "name"], ["duration"])


@query
def merge_places(w: Workload) -> DataFrame:
    known = w.view("wl_search_places").withColumn("name", F.concat(F.lit("P"), F.col("position").cast("string")))
    existing = known.where("position % 3 <> 0")
    updates = known.where("position % 2 = 0 or position % 3 = 0").select(
        "name", F.concat(F.lit("REGION^"), F.col("position").cast("string")).alias("identifier")
    )
    merged = snapshots.merge_search_places(existing, updates)
    return merged.select("name", "identifier", number("position"), "change")


@query
def ambiguous_places(w: Workload) -> DataFrame:
    found = search.lookup_places(w.view("wl_lookups"), w.view("wl_search_places"))
    return snapshots.ambiguous_places(found).select("query", "rank", "identifier")


# Search ------------------------------------------------------------------------------------

def _search(sort: str) -> Callable[[Workload], DataFrame]:
    def run(w: Workload) -> DataFrame:
        wanted = search.ListingQuery(
            min_bedrooms=2, max_bedrooms=4, min_price=1000, max_price=6000, max_bathrooms=3, sort=sort,
            max_days_since_added=MAX_DAYS,
        )
        page = search.search(w.listings(), wanted, NOW, CENTRE)
        return page.select(
            "row_no", "id", rounded("monthly_rent", "monthly_rent"), rounded("distance", "distance"), "first_visible_date")
    return run


for _sort in search.SORT_TYPES:
    _run = _search(_sort)
    _run.__name__ = f"search_{_sort}"
    query(_run)


@query
def place_results(w: Workload) -> DataFrame:
    """The first pages around every place, each within its own price cap."""
    wanted = search.ListingQuery(sort="nearest_first", radius=12.0)
    found = jobs.place_results(w.listings(), w.view("wl_places"), w.view("wl_place_caps"), wanted, MAX_RENT)
    return found.select("name", "row_no", "page_no", "id", rounded("distance", "miles_away"), "cap")


@query
def search_keywords(w: Workload) -> DataFrame:
    """Criteria met by keywords: must-haves, exclusions and furnishing."""
    key = F.col("id")
    words = F.array_compact(F.array(
        F.when(key % 2 == 0, "garden"), F.when(key % 3 == 0, "parking"), F.when(key % 7 == 0, "retirement"),
        F.when(key % 4 < 2, "furnished").otherwise("unfurnished"),
    ))
    tagged = w.listings().withColumn("keywords", F.when(key % 10 != 0, words)).withColumn(
        "channel", F.when(key % 6 == 0, "BUY").otherwise("RENT")
    )
    wanted = search.ListingQuery(must_have=("garden",), furnish_types=("furnished", "partFurnished"), sort="lowest_price")
    return search.matching(tagged, wanted).select("id", rounded("monthly_rent", "monthly_rent"))


@query
def search_pages(w: Workload) -> DataFrame:
    wanted = search.ListingQuery(sort="most_recent", page_size=24)
    return search.search(w.listings(), wanted).select("row_no", "page_no", "page_index", "id")


def _map_query() -> search.ListingQuery:
    return search.ListingQuery(sort="most_recent", include_let_agreed=True)


@query
def map_page(w: Workload) -> DataFrame:
    page, _ = search.map_search(w.listings(), _map_query())
    return page.select("id", F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"))


@query
def map_total(w: Workload) -> DataFrame:
    return search.map_search(w.listings(), _map_query())[1]


@query
def by_ids(w: Workload) -> DataFrame:
    return search.by_ids(w.listings(), w.view("wl_history").where("let_agreed")).select("id", number("amount"), "property_type")


@query
def area_ids(w: Workload) -> DataFrame:
    """Ids found around any of the places, each once."""
    near = regions.within_miles(w.listings(), w.view("wl_places"), 5.0)
    return search.distinct_ids(near, w.view("wl_history"))


@query
def within_miles(w: Workload) -> DataFrame:
    near = regions.within_miles(w.listings(), w.view("wl_places"), 5.0)
    return near.select("id", "name", rounded("miles_away", "miles_away"))


@query
def within_area(w: Workload) -> DataFrame:
    """Radius 0: only listings inside the place's own area."""
    areas = w.view("wl_caps").select("name")
    return regions.within_miles(w.listings(), areas, 0, _regions(w)).select("id", "name", "miles_away")


@query
def lookup(w: Workload) -> DataFrame:
    found = search.lookup_places(w.view("wl_lookups"), w.view("wl_search_places"))
    marked = F.array_join(F.transform("highlights", lambda s: F.when(
        s["highlighted"], F.concat(F.lit("["), s["text"], F.lit("]"))
    ).otherwise(s["text"])), "")
    return found.select("query", "rank", "name", "identifier", "match_class", marked.alias("marked"))


@query
def rank_for_review(w: Workload) -> DataFrame:
    ranked = search.with_review_rank(w.listings(), CENTRE)
    return ranked.select("id", rounded("distance", "distance"), "recency_key", "rank")


def _linked(w: Workload) -> DataFrame:
    return w.listings().withColumn("property_url", F.when(
        F.col("id") % 9 != 0, F.concat(F.lit("/properties/"), F.col("id").cast("string"))
    ))


@query
def review_sheet(w: Workload) -> DataFrame:
    return review.review_sheet(_linked(w), w.view("wl_places"), HOST)


# Postcodes and sites -----------------------------------------------------------------------

@query
def postcode_hierarchy(w: Workload) -> DataFrame:
    valid, _ = postcodes.split_valid_postcodes(w.view("wl_postcodes"))
    return postcodes.with_postcode_hierarchy(valid).select(
        "site_key", "canonical", "outward", "inward", "area", "district", "sub_district", "sector", "unit"
    )


@query
def postcode_validity(w: Workload) -> DataFrame:
    checked = postcodes.check_postcodes(w.view("wl_postcodes"))
    strict = postcodes.check_postcodes(checked.withColumnRenamed("problem", "lax_problem"), strict=True)
    return strict.select("site_key", "lax_problem", F.col("problem").alias("strict_problem"))


@query
def postcode_rollup(w: Workload) -> DataFrame:
    valid, _ = postcodes.split_valid_postcodes(w.view("wl_postcodes"))
    metrics = [F.count("*").alias("sites"), F.round(F.avg("latitude"), 6).alias("mean_latitude")]
    return postcodes.rollup_by_postcode(valid, metrics)


@query
def distinct_sites(w: Workload) -> DataFrame:
    return postcodes.distinct_sites(w.view("wl_postcodes")).drop("site_id")


@query
def site_fan_out(w: Workload) -> DataFrame:
    sites = postcodes.distinct_sites(w.view("wl_postcodes")).select("x", "y", "first_code")
    return postcodes.fan_out(sites, w.view("wl_postcodes")).select("postcode", "x", "y", "first_code")


@query
def postcode_directory(w: Workload) -> DataFrame:
    """The customers as a postcode directory CSV, written and read back with its filters."""
    key = F.col("site_key")
    directory = w.view("wl_postcodes").select(
        F.concat(F.lit(" "), "postcode", F.lit(" ")).alias("pcd"),
        F.when(key % 23 == 0, "100").otherwise(F.round("latitude", 6).cast("decimal(9,6)").cast("string")).alias("LAT"),
        F.when(key % 23 == 0, "0").otherwise(F.round("longitude", 6).cast("decimal(9,6)").cast("string")).alias("long"),
        F.when(key % 11 == 0, "201912").otherwise(F.lit("")).alias("DOTERM"),
        F.when(key % 13 == 0, "9").otherwise("1").alias("osgrdind"),
        F.when(key % 17 == 0, "1").otherwise("0").alias("USERTYPE"),
        F.concat(F.when(key % 19 == 0, "W").otherwise("E"), F.lpad((9000000 + key % 37).cast("string"), 8, "0")).alias("OSLAUA"),
    )
    path = scratch_path(w.spark, "directory")
    directory.write.option("header", True).csv(path)
    found = readers.read_postcode_centroids(w.spark, path, postcodes="skip")
    return found.select("postcode", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")])


# Geometry ----------------------------------------------------------------------------------

def _site_points(w: Workload) -> DataFrame:
    sites = postcodes.distinct_sites(w.view("wl_postcodes"), "site_key")
    return sites.select(F.col("first_code").alias("site_id"), "x", "y")


def _site_cells(w: Workload) -> DataFrame:
    sites = _site_points(w)
    return cells.site_cells(sites, cells.envelope_of((sites, "x", "y"), margin=ENVELOPE_MARGIN))


@query
def nearest_site(w: Workload) -> DataFrame:
    found = cells.nearest_site(w.listings().select("id", "longitude", "latitude"), _site_points(w))
    return found.select("id", "site_id", rounded("site_distance", "site_distance"))


@query
def site_cells(w: Workload) -> DataFrame:
    """The length of every cell's border, from its sides."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = cells.cell_edges(_site_cells(w))
    return sides.groupBy("site_id").agg(rounded(F.sum(F.sqrt(dx * dx + dy * dy)), "border"))


def _area(ring: Column) -> Column:
    """The area of a clockwise ring, in millionths."""
    return F.round(-regions.signed_turns(ring) / 2 * 1e6, 3).alias("area")


@query
def rings(w: Workload) -> DataFrame:
    """The stitched ring of every cell: its area, and that it is closed."""
    ring = F.col("ring")
    found = cells.ring_from_edges(cells.cell_edges(_site_cells(w)))
    return found.select("site_id", _area(ring), (ring[0] == F.element_at(ring, -1)).alias("closed"))


@query
def cell_cover(w: Workload) -> DataFrame:
    """Cells fill the envelope without overlap: their count, total area and ring shape."""
    ring = F.col("ring")
    turns = regions.signed_turns(ring)
    per_cell = cells.ring_from_edges(cells.cell_edges(_site_cells(w))).select(
        (-turns / 2).alias("area"), (turns < 0).alias("clockwise"),
        (ring[0] == F.element_at(ring, -1)).alias("closed"),
    )
    return per_cell.agg(
        F.count("*").alias("cells"), F.round(F.sum("area"), 6).alias("area"),
        F.count_if("clockwise").alias("clockwise"), F.count_if("closed").alias("closed"),
    )


@query
def postcode_rings(w: Workload) -> DataFrame:
    """Every valid postcode with the area of its cell; postcodes at one coordinate share it."""
    return jobs.postcode_cells(w.view("wl_postcodes")).select("region", _area(F.col("ring")))


def _tile_inputs(w: Workload) -> tuple[DataFrame, DataFrame]:
    return w.listings().select("id", "longitude", "latitude"), regions.bounding_boxes(_regions(w))


@query
def adaptive_tiles(w: Workload) -> DataFrame:
    points, boxes = _tile_inputs(w)
    found = tiles.adaptive_tiles(points, boxes, cap=120)
    edges = ("tile_min_x", "tile_min_y", "tile_max_x", "tile_max_y")
    return found.select("region", "depth", "ix", "iy", "n", "overflow", *[rounded(c, c) for c in edges])


@query
def tile_ids(w: Workload) -> DataFrame:
    points, boxes = _tile_inputs(w)
    return tiles.tile_ids(points, boxes)


@query
def batch_keys(w: Workload) -> DataFrame:
    return batches.batch_keys(w.listings(), "id")


# Files: written from the tables, read back by the readers ----------------------------------

def nested_listings(w: Workload) -> DataFrame:
    """The listings as nested records."""
    flat = w.listings()
    return flat.select(
        "id", "bedrooms", "bathrooms", F.concat(F.lit("Home no. "), F.col("id").cast("string")).alias("summary"),
        F.concat(F.col("agent_id").cast("string"), F.lit(" High Street")).alias("displayAddress"),
        F.struct("latitude", "longitude").alias("location"), F.col("property_type").alias("propertySubType"),
        F.when(F.col("amount").isNotNull(), F.struct("amount", "frequency", F.lit("GBP").alias("currencyCode"))).alias("price"),
        "commercial", "development", (~F.col("commercial")).alias("residential"), "students", "auction",
        F.col("display_size").alias("displaySize"), F.lit("RENT").alias("channel"),
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), "first_visible_date").cast("timestamp").alias("firstVisibleDate"),
        F.lit(False).alias("saved"), F.lit(False).alias("hidden"), F.lit("Homes to let").alias("heading"),
        F.struct(F.when(F.col("let_agreed"), F.array(F.struct(F.lit("LET_AGREED").alias("type"), F.lit(1).alias("priority")))).otherwise(
            F.array().cast("array<struct<type: string, priority: int>>")).alias("matchingLozenges")).alias("lozengeModel"),
    )


@query
def listing_records(w: Workload) -> DataFrame:
    """Nested listing JSON, written, read with its checks and flattened."""
    path = scratch_path(w.spark, "listings")
    tables.write_listings(nested_listings(w), path, "json")
    flat = with_listing_columns(readers.read_listings(w.spark, path))
    return flat.select(
        "id", "bedrooms", number("bathrooms"), number("amount"), "frequency", "latitude", "longitude", "let_agreed", "students",
        "display_size", "property_type", F.unix_micros("first_visible_date").alias("first_visible_micros"),
    )


@query
def bad_listings(w: Workload) -> DataFrame:
    """Listing JSON with broken records among it: how many are good, and what ails the others."""
    record = F.to_json(F.struct("*"))
    broken = F.when(F.col("id") % 17 == 0, F.replace(record, F.lit('"heading":"Homes to let"'), F.lit('"heading":null'))).when(
        F.col("id") % 19 == 0, F.replace(record, F.lit('"bedrooms":'), F.lit('"bedrooms":"many","was":'))).otherwise(record)
    path = scratch_path(w.spark, "records")
    nested_listings(w).select(broken.alias("value")).write.text(path)
    good, bad = readers.split_listings(w.spark, path, "lines")
    verdicts = good.select(F.lit("good").alias("problem")).unionByName(bad.select("problem"))
    return verdicts.groupBy("problem").agg(F.count("*").alias("records"))


@query
def bad_journeys(w: Workload) -> DataFrame:
    """Journey results with broken ones among them: how many are good, and what ails the others."""
    part = F.col("journeyVector.uri").cast("bigint")
    record = F.to_json(F.struct("*"))
    broken = F.when(part % 17 == 0, F.regexp_replace(record, '"fare":\\{"totalCost":[0-9]+\\}', '"fare":{}')).when(
        part % 19 == 0, F.replace(record, F.lit('"duration":'), F.lit('"duration":"long","was":'))).when(
        part % 23 == 0, F.replace(record, F.lit('"commonName":"There"'), F.lit('"commonName":null'))).otherwise(record)
    path = scratch_path(w.spark, "journey-records")
    _stored_results(_journey_results(w).select(broken.alias("value"))).text(path)
    # Only counted, so in one frame: apart, the good and the bad would each parse all records.
    verdicts = readers.split_journeys(w.spark, path, apart=False).select(F.coalesce("problem", F.lit("good")).alias("problem"))
    return verdicts.groupBy("problem").agg(F.count("*").alias("records"))


@query
def broken_json_files(w: Workload) -> DataFrame:
    """Listings as JSON texts of many forms, some files cut off: how many are good, and what ails the others.

    A file holds the ids of one range: an array, an array that ends inside its last record, or objects on end.
    """
    record = F.to_json(F.struct("*"))
    broken = F.when(F.col("id") % 17 == 0, F.replace(record, F.lit('"heading":"Homes to let"'), F.lit('"heading":null'))).when(
        F.col("id") % 19 == 0, F.replace(record, F.lit('"bedrooms":'), F.lit('"bedrooms":"many","was":'))).otherwise(record)
    part = F.floor(F.col("id") / IDS_PER_FILE).alias("part")
    # At most IDS_PER_FILE records to a text.
    texts = nested_listings(w).select(part, F.struct("id", broken.alias("record")).alias("r")).groupBy("part").agg(
        F.transform(F.array_sort(F.collect_list("r")), lambda r: r["record"]).alias("records"))
    array = F.concat(F.lit("["), F.array_join("records", ",\n"), F.lit("]"))
    text = F.when(F.col("part") % 3 == 0, array).when(
        F.col("part") % 3 == 1, F.substring(array, F.lit(1), F.length(array) - 9)).otherwise(F.array_join("records", ""))
    path = scratch_path(w.spark, "broken-json")
    texts.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    good, bad = readers.split_listings(w.spark, path)
    verdicts = good.select(F.lit("good").alias("problem"), "id").unionByName(bad.select("problem", F.lit(0).cast("bigint").alias("id")))
    return verdicts.groupBy("problem").agg(F.count("*").alias("records"), F.sum("id").alias("id_sum"))


@query
def snapshot_json(w: Workload) -> DataFrame:
    """Snapshots as files named by their time, an array per task in each: every order line number is a time."""
    folder = scratch_path(w.spark, "snapshot-json")
    records = nested_listings(w)
    files = [f"{folder}/{time}.json" for time in range(1, 4)]
    for time, file in enumerate(files, 1):
        tables.write_listings(records.where(f"id % {time} = 0").withColumn("bedrooms", F.lit(time)), file, "json")
    return jobs.merged_snapshots(readers.read_snapshots(w.spark, files)).select("id", "snapshot_ts", "bedrooms")


# Of a table that grows, so many positions make one JSON object.
MAP_ENTRIES = 1000


def map_objects(rows: DataFrame, key: str, value: Column, position: str | None = None) -> DataFrame:
    """JSON objects, one to a row: one per ``MAP_ENTRIES`` positions, or a single one for a short list without."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value.alias("value")))))
    parts = rows.groupBy(*([F.floor(F.col(position) / MAP_ENTRIES).alias("_part")] if position else []))
    return parts.agg(F.to_json(entries).alias("value")).select("value")


@query
def named_maps(w: Workload) -> DataFrame:
    """Commute places and price caps, each as one JSON object, and search places, as an object per line, written and read back."""
    def written(name: str, *map_of) -> str:
        path = scratch_path(w.spark, name)
        map_objects(*map_of).write.text(path)
        return path

    places = readers.read_places(w.spark, written("places", w.view("wl_places"), "name", F.array("latitude", "longitude")))
    searched = w.view("wl_search_places").select(F.concat("name", F.lit(" "), F.col("position").cast("string")).alias("name"), "identifier", "position")
    caps = readers.read_price_caps(w.spark, written("caps", w.view("wl_caps"), "name", F.col("cap")))
    found = readers.read_search_places(w.spark, written("searched", searched, "name", F.col("identifier"), "position"), lines=True)
    return (
        places.select(F.lit("place").alias("kind"), "name", F.concat_ws(" ", F.round("latitude", 6), F.round("longitude", 6)).alias("value"))
        .unionByName(caps.select(F.lit("cap").alias("kind"), "name", F.col("cap").cast("string").alias("value")))
        .unionByName(found.select(F.lit("search").alias("kind"), "name", F.col("identifier").alias("value")))
    )


@query
def region_maps(w: Workload) -> DataFrame:
    """Region boundaries as one map, of single rings and of parts of rings, written and read back."""
    rows = _regions(w)
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    out = []
    for kind, shape in (("ring", ring), ("multi", F.array(F.array(ring)))):
        path = scratch_path(w.spark, f"regions-{kind}")
        entries = F.map_from_entries(F.collect_list(F.struct("region", shape.alias("shape"))))
        rows.agg(F.to_json(entries).alias("value")).write.text(path)
        boxes = regions.bounding_boxes(readers.read_regions(w.spark, path, kind))
        out.append(boxes.select(F.lit(kind).alias("kind"), "region", *[rounded(c, c) for c in ("min_x", "min_y", "max_x", "max_y")]))
    return out[0].unionByName(out[1])


@query
def location_matches(w: Workload) -> DataFrame:
    """Lookup results as JSON, written and read back with their identifiers."""
    found = search.lookup_places(w.view("wl_lookups"), w.view("wl_search_places"))
    code = F.split("identifier", r"\^")
    match = F.struct(code[1].alias("id"), code[0].alias("type"), F.col("name").alias("displayName"),
                     F.lit("").alias("highlighting"), F.col("highlights"))
    # At most LOOKUP_LIMIT matches to a query.
    results = found.groupBy("query").agg(F.collect_list(match).alias("matches"))
    path = scratch_path(w.spark, "matches")
    results.select("matches").write.json(path)
    return readers.read_location_matches(w.spark, path, lines=True).select("identifier", F.col("displayName").alias("name"))


@query
def snapshot_files(w: Workload) -> DataFrame:
    """Order lines as snapshots of listings: written by time, read back, the newest kept."""
    line = w.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.lit(1).alias("bedrooms"), F.lit("Home").alias("summary"),
        F.struct(F.lit(51.5).alias("latitude"), F.lit(-0.1).alias("longitude")).alias("location"),
        F.struct(F.floor(F.col("l_extendedprice") / 100).cast("int").alias("amount"), F.lit("monthly").alias("frequency")).alias("price"),
        *[F.lit(False).alias(c) for c in ("commercial", "development", "students", "auction")], F.lit(True).alias("residential"),
        F.lit("RENT").alias("channel"), F.lit("Homes to let").alias("heading"),
        F.col("l_linenumber").cast("bigint").alias("snapshot_ts"),
    )
    path = scratch_path(w.spark, "snapshots")
    tables.write_snapshots(line, path)
    latest = jobs.merged_snapshots(readers.read_snapshots(w.spark, path, "parquet", by="folder"), ties=["price.amount"])
    return latest.select("id", "snapshot_ts", F.col("price.amount").alias("amount"))


@query
def region_files(w: Workload) -> DataFrame:
    """Region rings written, read back and used for the rent per region."""
    path = scratch_path(w.spark, "regions")
    tables.write_regions(_regions(w), path)
    means = regions.rent_by_region(regions.assign_regions(w.listings(), readers.read_regions(w.spark, path, "rows")))
    return means.select("region", rounded("mean_rent", "mean_rent"), "priced", "unpriced")


def _journey_results(w: Workload) -> DataFrame:
    """A journey result per order line: two journeys, of two legs and of one."""
    line = w.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    mode = lambda shift: F.element_at(F.array(*map(F.lit, MODE_IDS)), ((F.col("l_partkey") + shift) % len(MODE_IDS) + 1).cast("int"))
    minutes = lambda shift: (5 + (F.col("l_suppkey") * 7 + F.col("l_linenumber") + shift) % 40).cast("int")
    at = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")

    def leg(shift: int) -> Column:
        step = F.struct(F.lit("Walk on").alias("description"), F.concat(F.lit("Street "), F.col("l_suppkey").cast("string")).alias("streetName"),
                        (F.col("l_linenumber") * 10 + shift).cast("int").alias("distance"))
        return F.struct(
            minutes(shift).alias("duration"),
            F.struct(F.lit("Go").alias("summary"), F.array(step).alias("steps")).alias("instruction"),
            at.alias("departureTime"), F.concat(at, F.lit("+01:00")).alias("arrivalTime"),
            F.struct(F.concat(F.lit("Stop "), F.col("l_suppkey").cast("string")).alias("commonName")).alias("departurePoint"),
            F.struct(F.lit("There").alias("commonName")).alias("arrivalPoint"),
            F.struct(mode(shift).alias("id")).alias("mode"), F.lit(False).alias("isDisrupted"),
        )

    def journey(legs: list[Column], duration: Column) -> Column:
        return F.struct(at.alias("startDateTime"), at.alias("arrivalDateTime"), duration.alias("duration"), F.array(*legs).alias("legs"),
                        F.lit(False).alias("alternativeRoute"), F.struct((F.col("l_partkey") % 500).cast("int").alias("totalCost")).alias("fare"))

    none = F.array().cast("array<string>")
    return line.select(
        F.array(journey([leg(0), leg(1)], minutes(0) + minutes(1)), journey([leg(2)], minutes(2))).alias("journeys"),
        none.alias("lines"), none.alias("stopMessages"), F.lit(5).alias("recommendedMaxAgeMinutes"),
        F.struct(F.lit("Arriving").alias("dateTimeType")).alias("searchCriteria"),
        F.struct(F.col("l_orderkey").cast("string").alias("from"), F.col("l_linenumber").cast("string").alias("to"),
                 F.col("l_partkey").cast("string").alias("uri")).alias("journeyVector"),
    )


def _stored_results(records: DataFrame) -> DataFrameWriter:
    return records.write.option("compression", "gzip").option("maxRecordsPerFile", RESULTS_PER_FILE)


def _read_journey_results(w: Workload) -> DataFrame:
    path = scratch_path(w.spark, "journey-results")
    _stored_results(_journey_results(w)).json(path)
    results = readers.read_journeys(w.spark, path, lines=True)
    return results.select("journeys", F.col("journeyVector.from").cast("bigint").alias("id"),
                          F.col("journeyVector.to").cast("int").alias("line"), F.col("journeyVector.uri").cast("bigint").alias("part"))


@query
def journey_facts(w: Workload) -> DataFrame:
    facts = commute.journey_facts(_read_journey_results(w), ["id", "line", "part"])
    return facts.select("id", "line", "part", "position", "duration", "n_legs", "total_cost",
                        F.array_join("modes", ",").alias("modes"), F.unix_micros("start").alias("start_micros"))


@query
def leg_facts(w: Workload) -> DataFrame:
    facts = commute.leg_facts(_read_journey_results(w), ["id", "line", "part"])
    return facts.select("id", "line", "part", "position", "leg_no", "mode", "duration", "from_name",
                        F.unix_micros("departure").alias("departure_micros"), F.unix_micros("arrival").alias("arrival_micros"))


@query
def step_facts(w: Workload) -> DataFrame:
    facts = commute.step_facts(_read_journey_results(w), ["id", "line", "part"])
    return facts.select("id", "line", "part", "position", "leg_no", "step_no", "description", "street_name", "distance")


def _stations(w: Workload) -> DataFrame:
    """The suppliers as station records in XML, written and read back."""
    def element(tag: str, *body: Column | str) -> Column:
        parts = [F.lit(b) if isinstance(b, str) else b for b in body]
        return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag.split()[0]}>"))

    key = F.col("s_suppkey").cast("string")
    number = lambda column: F.col(column).cast("string")
    zone = element("zones", element("zone", (F.col("s_suppkey") % 6 + 1).cast("string")))
    lines = F.when(F.col("s_suppkey") % 4 != 0, element(
        "servingLines", element("servingLine", "Line ", number("s_nationkey")),
        F.when(F.col("s_suppkey") % 2 == 0, element("servingLine", " Second   Line ")).otherwise(""))).otherwise("")
    facilities = element("facilities", element('facility name="Lifts"', (F.col("s_suppkey") % 3).cast("string")),
                         element('facility name="WiFi"', F.when(F.col("s_suppkey") % 2 == 0, "yes").otherwise("no")))
    way = element("path", element("heading", "To platform"), element("pathDescription", "Stairs ", key))
    entrance = element("entrance", element("name", "Main ", key),
                       element("entranceToBookingHall", element("entranceToBookingHallSteps", (F.col("s_suppkey") % 30).cast("string"))),
                       element("bookingHallToPlatform", element("pointName", "Platform 1"), way),
                       element("platformToTrain", element("trainName", "Train ", key)))
    interval = element("timeInterval", element("from", "0500"), element("to", "2330"))
    hours = element("openingHours", element("openingHour", element("entrance", "Main ", key), element('timeIntervals type="weekday"', interval)))
    height = F.when(F.col("s_suppkey") % 2 == 0, ",12.5").otherwise("")
    mark = element("Placemark", element("name", "x"), element("Point", element(
        "coordinates", F.concat(F.lit("-0."), F.lpad(key, 6, "0"), F.lit(",51."), F.lpad(key, 6, "0"), height))))
    xml = F.concat(F.lit('<station id="'), key, F.lit('" type="tube">'), element("name", F.col("s_name")),
                   element("contactDetails", element("address", key, "  Station   Road"), element("phone", "0000")),
                   lines, zone, facilities, element("entrances", entrance), hours, mark, F.lit("</station>"))
    path = scratch_path(w.spark, "stations")
    w.table("supplier").select(xml.alias("value")).write.text(path)
    return readers.read_stations(w.spark, path, "lines")


def _key(column: str = "station_id") -> Column:
    return F.col(column).cast("bigint").alias("station_id")


@query
def station_dim(w: Workload) -> DataFrame:
    return stations.station_dim(_stations(w)).select(_key(), "name", "address", "longitude", "latitude", "altitude")


@query
def station_feed(w: Workload) -> DataFrame:
    """The stations as one feed document per file, read back by its elements."""
    path = scratch_path(w.spark, "feed")
    _stations(w).write.format("xml").option("rowTag", "station").option("rootTag", "stations").save(path)
    found = readers.read_stations(w.spark, path)
    return stations.station_dim(found).select(_key(), "name", "address", "longitude", "latitude", "altitude")


@query
def station_lines(w: Workload) -> DataFrame:
    return stations.station_lines(_stations(w)).select(_key(), "line")


@query
def station_zones(w: Workload) -> DataFrame:
    return stations.station_zones(_stations(w)).select(_key(), "zone")


@query
def station_facilities(w: Workload) -> DataFrame:
    return stations.station_facilities(_stations(w)).select(_key(), "facility", "value")


@query
def station_entrances(w: Workload) -> DataFrame:
    return stations.station_entrances(_stations(w)).select(_key(), "entrance_no", "entrance", "steps")


@query
def station_paths(w: Workload) -> DataFrame:
    return stations.station_paths(_stations(w)).select(_key(), "point_name", "heading", "path_description")


@query
def station_trains(w: Workload) -> DataFrame:
    return stations.station_trains(_stations(w)).select(_key(), "train")


@query
def station_hours(w: Workload) -> DataFrame:
    return stations.station_hours(_stations(w)).select(_key(), "entrance", "day_type", "from_time", "to_time")


# Streams: drained, then the sink is read ---------------------------------------------------

def _stream(w: Workload, table: str, view: str) -> DataFrame:
    """A view over a table that is read as a stream."""
    reader = w.spark.readStream.schema(w.table(table).schema).option("pathGlobFilter", f"{table}.parquet")
    source = reader.parquet(w.folder)
    return w.spark.sql(VIEWS[view], **{table: source})


def _drained(w: Workload, stream: DataFrame, name: str) -> str:
    path = scratch_path(w.spark, name)
    start_append(stream, path, f"{path}-state", drain=True).awaitTermination()
    return path


@query
def stream_new_ids(w: Workload) -> DataFrame:
    path = _drained(w, stream_new_listings(_stream(w, "lineitem", "wl_snapshots")).select("id"), "stream-new")
    return w.spark.read.parquet(path)


@query
def stream_unseen_ids(w: Workload) -> DataFrame:
    """Ids of a stream of snapshots that the stored history lacks, each once; the history is the stream's first state."""
    # A session of its own holds the setting that the state store needs.
    session = w.spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = Workload(session, w.folder)
    stream = _stream(own, "lineitem", "wl_snapshots").select("id")
    path = _drained(own, stream_unseen_listings(stream, own.view("wl_history")), "stream-unseen")
    return w.spark.read.schema("id BIGINT").parquet(path)


@query
def stream_latest_per_listing(w: Workload) -> DataFrame:
    order = ["snapshot_ts"] + [-F.col(c) for c in _TIES]
    updates = stream_latest(_stream(w, "lineitem", "wl_snapshots"), order)
    path = scratch_path(w.spark, "stream-latest")
    start_upsert(updates, path, f"{path}-state", drain=True).awaitTermination()
    return read_upserts(w.spark, path)


@query
def stream_suitable_listings(w: Workload) -> DataFrame:
    path = scratch_path(w.spark, "stream-suitable")
    start_suitable(
        _stream(w, "orders", "wl_listings"), path, f"{path}-state", rules=lambda now: _all_rules(w), clock=lambda: NOW,
        history=lambda: w.view("wl_history"), drain=True,
    ).awaitTermination()
    return w.spark.read.parquet(path).select("id", "amount", "frequency")
