"""Journeys: pairs to ask for, best journey, the for-all commute test, flat tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import target_arrival
from ..schemas import STATION_PREFIX
from .joins import beside_all, lookup_join, spread_join


def od_pairs(listings: DataFrame, places: DataFrame, key: str = "id") -> DataFrame:
    """Every listing with every destination, all pairs by definition; :func:`missing_journeys` needs none."""
    origins = listings.select(key, F.col("latitude").alias("src_lat"), F.col("longitude").alias("src_lon"))
    targets = places.select("name", F.col("latitude").alias("dst_lat"), F.col("longitude").alias("dst_lon"))
    return beside_all(origins, targets)


def rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """Round coordinate keys so that near-equal coordinates share journeys."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def missing_pairs(pairs: DataFrame, journeys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs without any stored journey: the list of journeys still to fetch.

    A pair with very many journeys is folded to one row per task before the shuffle.
    """
    return pairs.join(journeys.select(*key).distinct(), list(key), "left_anti")


def missing_journeys(
    origins: DataFrame, places: DataFrame, journeys: DataFrame,
    origin: Sequence[str] = ("id",), destination: Sequence[str] = ("name",),
) -> DataFrame:
    """Origin and destination of every journey still to fetch; only these pairs are ever made.

    Journeys are folded to the places each origin reaches (as many as there are places, at most),
    and origins that lack some are given those.
    """
    origin, destination = list(origin), list(destination)
    wanted = places.select(*destination).distinct()
    met = lookup_join(journeys.select(*origin, *destination), wanted, destination, "left_semi")
    reached = met.groupBy(*origin).agg(F.collect_set(F.struct(*destination)).alias("_reached"))
    starts = origins.select(*origin).distinct()
    # The list of places is a user's; it rides along as one array.
    every = wanted.agg(F.collect_set(F.struct(*destination)).alias("_every"))
    known = spread_join(starts, reached, origin, "left")
    nothing = F.array().cast(every.schema["_every"].dataType)
    lacking = beside_all(known, every, 1).withColumn(
        "_p", F.explode(F.array_except("_every", F.coalesce("_reached", nothing))))
    return lacking.select(*origin, *[F.col("_p")[c].alias(c) for c in destination])


def best_journeys(
    journeys: DataFrame, key: Sequence[str], order: Sequence[Column | str] | None = None
) -> DataFrame:
    """The shortest journey of each pair, one without a duration last; the first in ``order`` on equal ones."""
    order = order or (F.asc_nulls_last("duration"), F.col("position"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return journeys.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


# Places up to this many are told apart by the bits of one number.
BITS = 63


def _places_reached(
    journeys: DataFrame, wanted: DataFrame, places: int, origin: list[str], destination: list[str]
) -> DataFrame:
    """Per origin the number of distinct wanted destinations among its journeys."""
    if places > BITS:
        met = lookup_join(journeys, wanted, destination, "left_semi")
        return met.groupBy(*origin).agg(F.count_distinct(*destination).alias("_reached"))
    # At most BITS rows are numbered and broadcast. One grouping, one shuffle of one row per
    # origin and task.
    numbered = wanted.withColumn("_bit", F.row_number().over(Window.orderBy(*destination)) - 1)
    bits = F.bit_count(F.bit_or(F.expr("shiftleft(1L, _bit)")))
    return journeys.join(F.broadcast(numbered), destination).groupBy(*origin).agg(bits.alias("_reached"))


def commute_ok(
    df: DataFrame, places: DataFrame, journeys: DataFrame, max_minutes: int,
    origin: Sequence[str] = ("id",), destination: Sequence[str] = ("name",),
) -> DataFrame:
    """Add ``commute_ok``: does every destination have a journey within ``max_minutes``?

    A pair's shortest journey is short enough exactly when some journey is, so the long
    ones are filtered out at the scan and what remains is counted: an origin passes when
    it reaches as many distinct destinations as there are. No listing-by-place pairs are
    built, and the partial aggregate folds a hot origin before the shuffle.
    """
    origin, destination = list(origin), list(destination)
    wanted = places.select(*destination).distinct()
    needed = wanted.count()
    short = journeys.where(F.col("duration") <= max_minutes).select(*origin, *destination)
    reached = _places_reached(short, wanted, needed, origin, destination)
    # Ids are unique; very many listings may share an origin of any other kind.
    joined = df.join(reached, origin, "left") if origin == ["id"] else spread_join(df, reached, origin, "left")
    return joined.withColumn("commute_ok", F.coalesce("_reached", F.lit(0)) == needed).drop("_reached")


def gate_places(
    search_places: DataFrame, places: DataFrame, journeys: DataFrame, max_minutes: int,
    origin: Sequence[str] = ("name",), destination: Sequence[str] = ("destination",),
) -> DataFrame:
    """Search places worth searching: stations whose own commute passes, and all others."""
    checked = commute_ok(search_places, places, journeys, max_minutes, origin, destination)
    is_station = F.startswith(F.col("identifier"), F.lit(STATION_PREFIX))
    return checked.where(~is_station | F.col("commute_ok")).drop("commute_ok")


def with_target_arrival(
    df: DataFrame, as_of: str = "as_of", zone: str = "Europe/London", at: dt.time = dt.time(9)
) -> DataFrame:
    """Add ``target_arrival`` (UTC) and the date and time text sent with a journey request."""
    arrival = target_arrival(as_of, zone, at)
    return df.withColumn("target_arrival", arrival).withColumns({
        "arrival_date": F.date_format(F.col("target_arrival"), "yyyyMMdd"),
        "arrival_time": F.date_format(F.col("target_arrival"), "HHmm"),
    })


def journey_facts(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per journey: ``key``, position, times, duration and the modes of its legs."""
    rows = results.select(*key, F.posexplode("journeys").alias("position", "_j"))
    return rows.select(
        *key, "position",
        F.col("_j.startDateTime").alias("start"), F.col("_j.arrivalDateTime").alias("arrival"),
        F.col("_j.duration").alias("duration"), F.col("_j.alternativeRoute").alias("alternative_route"),
        F.transform("_j.legs", lambda leg: leg["mode"]["id"]).alias("modes"),
        F.size("_j.legs").alias("n_legs"), F.col("_j.fare.totalCost").alias("total_cost"),
    )


def _legs(results: DataFrame, key: Sequence[str]) -> DataFrame:
    rows = results.select(*key, F.posexplode("journeys").alias("position", "_j"))
    return rows.select(*key, "position", F.posexplode("_j.legs").alias("leg_no", "_leg"))


def leg_facts(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per leg of each journey."""
    leg = F.col("_leg")
    return _legs(results, key).select(
        *key, "position", "leg_no",
        leg["mode"]["id"].alias("mode"), leg["duration"].alias("duration"),
        leg["distance"].alias("distance"),
        leg["departureTime"].alias("departure"), leg["arrivalTime"].alias("arrival"),
        leg["scheduledDepartureTime"].alias("scheduled_departure"),
        leg["scheduledArrivalTime"].alias("scheduled_arrival"),
        leg["departurePoint"]["commonName"].alias("from_name"),
        leg["arrivalPoint"]["commonName"].alias("to_name"),
        leg["isDisrupted"].alias("is_disrupted"), leg["instruction"]["summary"].alias("summary"),
        F.size(leg["instruction"]["steps"]).alias("n_steps"),
    )


def step_facts(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per instruction step of each leg."""
    rows = _legs(results, key).select(
        *key, "position", "leg_no", F.posexplode("_leg.instruction.steps").alias("step_no", "_step")
    )
    step = F.col("_step")
    return rows.select(
        *key, "position", "leg_no", "step_no",
        step["description"].alias("description"), step["streetName"].alias("street_name"),
        step["turnDirection"].alias("turn_direction"), step["distance"].alias("distance"),
        step["cumulativeDistance"].alias("cumulative_distance"),
        step["latitude"].alias("latitude"), step["longitude"].alias("longitude"),
        step["travelTime"].alias("travel_time"),
    )
