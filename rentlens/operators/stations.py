"""Station-facility records as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import as_column


def squeezed(text) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(as_column(text), r"\s+", " "))


def _coordinate(position: int) -> Column:
    parts = F.split(F.col("Placemark.Point.coordinates"), ",")
    return F.trim(F.try_element_at(parts, F.lit(position))).cast("double")


def station_dim(stations: DataFrame) -> DataFrame:
    """One row per station; coordinates are ``longitude,latitude[,altitude]`` text."""
    has_point = F.col("Placemark.Point.coordinates").isNotNull()
    return stations.select(
        F.col("_id").alias("station_id"), F.col("_type").alias("type"), squeezed("name").alias("name"),
        squeezed("contactDetails.address").alias("address"), squeezed("contactDetails.phone").alias("phone"),
        _coordinate(1).alias("longitude"), _coordinate(2).alias("latitude"),
        F.when(has_point, F.coalesce(_coordinate(3), F.lit(0.0))).alias("altitude"),
        squeezed("Placemark.description").alias("description"), F.col("Placemark.styleUrl").alias("style_url"),
    )


def _rows(stations: DataFrame, path: str, name: str) -> DataFrame:
    return stations.select(F.col("_id").alias("station_id"), F.explode(path).alias(name))


def station_lines(stations: DataFrame) -> DataFrame:
    return _rows(stations, "servingLines.servingLine", "line").withColumn("line", squeezed("line"))


def station_zones(stations: DataFrame) -> DataFrame:
    return _rows(stations, "zones.zone", "zone").withColumn("zone", squeezed("zone"))


def station_facilities(stations: DataFrame) -> DataFrame:
    rows = _rows(stations, "facilities.facility", "_f")
    return rows.select("station_id", F.col("_f._name").alias("facility"), squeezed("_f._VALUE").alias("value"))


def station_entrances(stations: DataFrame) -> DataFrame:
    """One row per entrance; its way to the booking hall from either place it is recorded."""
    rows = stations.select(
        F.col("_id").alias("station_id"), F.posexplode("entrances.entrance").alias("entrance_no", "_e")
    )
    return rows.select(
        "station_id", "entrance_no", squeezed("_e.name").alias("entrance"),
        squeezed(F.coalesce("_e.entranceToBookingHall.entranceToBookingHallDirection", "_e.entranceToBookingHallDirection")).alias("direction"),
        squeezed(F.coalesce("_e.entranceToBookingHall.entranceToBookingHallSteps", "_e.entranceToBookingHallSteps")).alias("steps"),
    )


def station_paths(stations: DataFrame) -> DataFrame:
    """One row per way from the booking hall to a platform, and per heading along it."""
    rows = stations.select(
        F.col("_id").alias("station_id"), F.posexplode("entrances.entrance").alias("entrance_no", "_e")
    )
    points = rows.select("station_id", "entrance_no", F.posexplode("_e.bookingHallToPlatform").alias("point_no", "_p"))
    paths = points.select("station_id", "entrance_no", "point_no", "_p", F.posexplode_outer("_p.path").alias("path_no", "_way"))
    return paths.select(
        "station_id", "entrance_no", "point_no", "path_no", squeezed("_p.pointName").alias("point_name"),
        squeezed("_p.pathDescription").alias("point_description"),
        squeezed("_way.heading").alias("heading"), squeezed("_way.pathDescription").alias("path_description"),
    )


def station_trains(stations: DataFrame) -> DataFrame:
    """One row per train reached from an entrance, with the steps from platform to train."""
    rows = stations.select(
        F.col("_id").alias("station_id"), F.posexplode("entrances.entrance").alias("entrance_no", "_e")
    )
    trains = rows.select("station_id", "entrance_no", F.explode("_e.platformToTrain").alias("_t"))
    return trains.select(
        "station_id", "entrance_no", squeezed("_t.trainName").alias("train"),
        squeezed("_t.platformToTrainSteps").alias("steps"),
    )


def station_hours(stations: DataFrame) -> DataFrame:
    """One row per opening interval of an entrance and day type."""
    rows = _rows(stations, "openingHours.openingHour", "_h")
    days = rows.select("station_id", F.col("_h.entrance").alias("entrance"), F.explode("_h.timeIntervals").alias("_d"))
    spans = days.select("station_id", "entrance", F.col("_d._type").alias("day_type"), F.explode("_d.timeInterval").alias("_i"))
    return spans.select(
        "station_id", squeezed("entrance").alias("entrance"), "day_type",
        F.col("_i.from").alias("from_time"), F.col("_i.to").alias("to_time"),
    )
