"""Readers for listings, snapshots, journeys, stations, postcodes, regions and small maps.

JSON texts are cut into their elements by many tasks (:mod:`json_texts`). Land inputs that are read often
as Parquet once (``write_listings(..., fmt="parquet")``), which is pruned too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import postcode_parts, postcode_problem
from ..schemas import (
    JOURNEY_RESULTS, JOURNEY_RESULTS_NESTED_REQUIRED, JOURNEY_RESULTS_REQUIRED, LISTING,
    LISTING_NESTED_REQUIRED, LISTING_REQUIRED, LOCATION_MATCHES,
    LONDON_AREA_CODES, MODE_IDS, POSTCODE_COLUMNS, STATION, STATION_FEED_HEADER, STATION_REQUIRED,
)
from .json_texts import Paths, json_elements, with_position

_CORRUPT, _RECORD, _PROBLEM = "_corrupt_record", "_record", "_problem"


def _missing_field(required: Sequence[str], nested: dict[str, str] | None = None, within: str = "") -> Column:
    """The name of the first required field that is missing; null when all are there.

    ``nested`` tells by SQL conditions when fields of nested records are missing; ``within``
    names the column that holds the record.
    """
    absent = [F.when(F.col(f"{within}{field}").isNull(), F.lit(field)) for field in required]
    return F.coalesce(*absent, *[F.when(F.expr(text), F.lit(name)) for name, text in (nested or {}).items()])


def _require(df: DataFrame, required: Sequence[str], what: str, nested: dict[str, str] | None = None) -> DataFrame:
    """Fail the query on a row without a required field.

    The check is a filter, so column pruning cannot remove it.
    """
    missing = _missing_field(required, nested)
    fail = F.raise_error(F.concat(F.lit(f"{what} without "), missing)).cast("boolean")
    return df.where(F.when(missing.isNull(), True).otherwise(fail))


def _whole_records(df: DataFrame) -> DataFrame:
    """Every row; the condition keeps Spark from skipping the fields a query does not use."""
    return df.where(F.xxhash64(*df.columns) >= F.lit(-(2**63)))


def _elements(spark: SparkSession, path: Paths, entries: bool = False) -> DataFrame:
    """Elements of JSON texts, with the file; one that is cut off fails the query."""
    fail = F.raise_error(F.concat(F.lit("broken JSON text in "), "file", F.lit(": "), F.substring("record", 1, 200))).cast("boolean")
    return json_elements(spark, path, entries).where(F.when(F.col("whole"), True).otherwise(fail))


def _json(spark: SparkSession, path: Paths, schema: str, lines: bool, file: str | None = None) -> DataFrame:
    """JSON records, every field checked: a bad one fails the query whichever fields it uses.

    ``lines``: a record per line. Else files hold any number of JSON texts, arrays of records or single ones.
    ``file`` names a column for the path of the record's file.
    """
    paths = path if isinstance(path, str) else list(path)
    if lines:
        df = _whole_records(
            spark.read.schema(schema).option("mode", "FAILFAST").option("timeZone", "UTC").json(paths))
        return df if file is None else df.withColumn(file, F.col("_metadata.file_path"))
    parsed = F.from_json(F.when(F.col("whole"), F.col("record")), schema, {"mode": "FAILFAST", "timeZone": "UTC"})
    # A generator is evaluated once, whole, and before what follows, whichever fields are used.
    return _elements(spark, paths).select(F.inline(F.array(parsed)), *([F.col("file").alias(file)] if file else []))


def read_listings(spark: SparkSession, path: Paths, fmt: str = "json") -> DataFrame:
    """Listings; one bad record fails the load.

    ``fmt``: ``json`` (arrays of objects, or objects; a large file is read by many tasks), ``lines`` (one
    object per line) or ``parquet``.
    Numbers given as text are bad records. See :func:`split_listings` to set bad ones aside.
    """
    if fmt == "parquet":
        # Written from checked records, so only what a query needs is read.
        df = spark.read.schema(LISTING).parquet(*([path] if isinstance(path, str) else path))
        return _require(df, LISTING_REQUIRED, "listing")
    df = _json(spark, path, LISTING, lines=fmt == "lines")
    return _require(df, LISTING_REQUIRED, "listing", LISTING_NESTED_REQUIRED)


def split_listings(spark: SparkSession, path: Paths, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """The good listings, and the bad records as ``(record, problem)``.

    Each array element (``json``) or line (``lines``) is parsed by itself, so a bad one
    does not spoil its file. Of a file that is cut off, the last element is a bad record.
    """
    return _split(spark, path, fmt, LISTING, LISTING_REQUIRED, LISTING_NESTED_REQUIRED)


def split_journeys(spark: SparkSession, path: Paths, apart: bool = True) -> tuple[DataFrame, DataFrame] | DataFrame:
    """The good journey results of JSON lines, and the bad ones as ``(record, problem)``.

    Each of the two frames reads and parses all records. ``apart=False`` gives both kinds in one frame, from one pass:
    the columns as far as they could be read, ``record``, and ``problem``, which is null for the good ones.
    """
    layout = JOURNEY_RESULTS, JOURNEY_RESULTS_REQUIRED, JOURNEY_RESULTS_NESTED_REQUIRED
    if apart:
        return _split(spark, path, "lines", *layout)
    return _checked(spark, path, "lines", *layout).withColumnsRenamed({_RECORD: "record", _PROBLEM: "problem"})


def _split(
    spark: SparkSession, path: Paths, fmt: str, layout: str, required: Sequence[str], nested: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    checked = _checked(spark, path, fmt, layout, required, nested)
    good = checked.where(F.col(_PROBLEM).isNull()).drop(_RECORD, _PROBLEM)
    return good, checked.where(F.col(_PROBLEM).isNotNull()).select(F.col(_RECORD).alias("record"), F.col(_PROBLEM).alias("problem"))


def _checked(
    spark: SparkSession, path: Paths, fmt: str, layout: str, required: Sequence[str], nested: dict[str, str]
) -> DataFrame:
    """All records: their text, their columns as far as they could be read, and what ails them; null for the good ones."""
    if fmt == "lines":
        text = spark.read.text(path if isinstance(path, str) else list(path))
        records = text.select(F.col("value").alias(_RECORD), F.lit(True).alias("_whole"))
    else:
        records = json_elements(spark, path).select(F.col("record").alias(_RECORD), F.col("whole").alias("_whole"))
    options = {"columnNameOfCorruptRecord": _CORRUPT, "timeZone": "UTC"}
    # A generator is evaluated once, whole; beside filters, each field they use would parse the record anew.
    record = F.struct(F.col(_RECORD), F.col("_whole"), F.from_json(_RECORD, f"{layout}, {_CORRUPT} STRING", options).alias("_l"))
    flat = records.select(F.inline(F.array(record))).select(_RECORD, (F.col("_l").isNull() | ~F.col("_whole")).alias("_nothing"), "_l.*")
    problem = F.when(F.col("_nothing") | F.col(_CORRUPT).isNotNull(), F.lit("unreadable")).otherwise(
        F.concat(F.lit("without "), _missing_field(required, nested)))
    return flat.withColumn(_PROBLEM, problem).drop("_nothing", _CORRUPT)


def file_time(path: str = "_metadata.file_path") -> Column:
    """The time in the name of the row's file; any name but digits fails the query.

    A file may be a folder of parts, as Spark writes it.
    """
    # No pattern: one that may start anywhere is tried from every place of every row's path.
    last, parent = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.when(F.startswith(last, F.lit("part-")), parent).otherwise(last)
    digits = F.regexp_extract(name, r"^([0-9]+)(\.[^.]*)?$", 1)
    fail = F.raise_error(F.concat(F.lit("file name is not a time: "), name)).cast("string")
    return F.when(digits != "", digits).otherwise(fail).cast("bigint")


def stream_snapshots(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Snapshot files as they arrive in a folder, each an array of listings; see :func:`read_snapshots`."""
    reader = spark.readStream.schema(LISTING).option("multiLine", True).option("mode", "FAILFAST").option("timeZone", "UTC")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    records = _whole_records(reader.json(path))
    return _require(records, LISTING_REQUIRED, "listing", LISTING_NESTED_REQUIRED).withColumn("snapshot_ts", file_time())


def read_snapshots(spark: SparkSession, path: Paths, fmt: str = "json", by: str = "file") -> DataFrame:
    """Listings of a series of snapshots with their time in UTC seconds: ``snapshot_ts`` (bigint).

    ``by="file"``: files named by their time, from a directory or a list; any other file
    name fails the query. ``by="folder"``: a folder per time, as ``write_snapshots`` makes
    them, so that a range of times reads only its folders.
    """
    if by == "folder":
        schema = f"{LISTING}, snapshot_ts BIGINT"
        if fmt == "parquet":
            return _require(spark.read.schema(schema).parquet(path), LISTING_REQUIRED, "listing")
        return _require(_json(spark, path, schema, lines=True), LISTING_REQUIRED, "listing", LISTING_NESTED_REQUIRED)
    if fmt == "parquet":
        return read_listings(spark, path, fmt).withColumn("snapshot_ts", file_time())
    df = _json(spark, path, LISTING, fmt == "lines", file="_file").withColumn("snapshot_ts", file_time("_file")).drop("_file")
    return _require(df, LISTING_REQUIRED, "listing", LISTING_NESTED_REQUIRED)


def read_journeys(spark: SparkSession, path: Paths, lines: bool = False) -> DataFrame:
    """Journey results, checked strictly; ``source_file`` tells the requests apart.

    Times without a zone are UTC, whatever the session zone is.
    """
    df = _json(spark, path, JOURNEY_RESULTS, lines, file="source_file")
    df = _require(df, JOURNEY_RESULTS_REQUIRED, "journey result", JOURNEY_RESULTS_NESTED_REQUIRED)
    modes = F.flatten(F.transform("journeys", lambda j: F.transform(j["legs"], lambda leg: leg["mode"]["id"])))
    known = F.forall(F.coalesce(modes, F.array().cast("array<string>")), lambda m: m.isin(*MODE_IDS))
    fail = F.raise_error(F.lit("unknown transport mode")).cast("boolean")
    return df.where(F.when(known, True).otherwise(fail)).withColumn(
        "source_file", F.regexp_extract("source_file", "[^/]*$", 0))


def read_stations(spark: SparkSession, path: str, fmt: str = "feed") -> DataFrame:
    """Station records of a facilities feed, one row per ``station`` element.

    ``fmt``: ``feed`` (a document per file) or ``lines`` (one station element per line,
    which splits).
    """
    if fmt == "lines":
        record = F.from_xml("value", STATION, {"ignoreSurroundingSpaces": "true", "mode": "FAILFAST"})
        rows = spark.read.text(path).select(record.alias("_s")).select("_s.*")
    else:
        rows = _xml(spark, path, "station", STATION)
    return _require(rows, STATION_REQUIRED, "station")


def read_station_feed_header(spark: SparkSession, path: str) -> DataFrame:
    """The feed's ``Header`` element."""
    return _xml(spark, path, "Header", STATION_FEED_HEADER)


def read_station_feed_styles(spark: SparkSession, path: str) -> DataFrame:
    """The feed's map styles: style_id, href of its icon."""
    styles = _xml(spark, path, "Style", "_id STRING, IconStyle STRUCT<Icon: STRUCT<href: STRING>>")
    return styles.select(F.col("_id").alias("style_id"), F.col("IconStyle.Icon.href").alias("href"))


def read_station_feed_attribution(spark: SparkSession, path: str) -> DataFrame:
    """The feed's ``Attribution`` element."""
    return _xml(spark, path, "Attribution", "Url STRING, Text STRING, Logo STRING")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml").schema(schema).option("rowTag", tag)
        .option("ignoreSurroundingSpaces", True).option("mode", "FAILFAST").load(path)
    )


def _header_names(columns: Sequence[str]) -> dict[str, str]:
    """Wanted name -> name in the file: as given, else in lower case, else an error."""
    names = {}
    for wanted in POSTCODE_COLUMNS:
        found = next((name for name in (wanted, wanted.lower()) if name in columns), None)
        if found is None:
            raise KeyError(f"no column {wanted} in the header")
        names[wanted] = found
    return names


def active_centroids(
    directory: DataFrame, area_codes: tuple[int, int] = LONDON_AREA_CODES, keep_sentinel: bool = False,
    postcodes: str = "check",
) -> DataFrame:
    """Live, located postcodes of an area from an all-text postcode directory.

    Columns: postcode (canonical), latitude, longitude. ``keep_sentinel`` keeps the rows at
    (100, 0), the directory's mark for no location. A live row whose postcode is not valid fails the
    query; ``postcodes="skip"`` leaves such rows out.
    """
    names = _header_names(directory.columns)
    rows = directory.select(*[F.trim(F.col(f"`{found}`")).alias(wanted) for wanted, found in names.items()])
    code = F.regexp_extract("OSLAUA", "^E([0-9]+)$", 1).try_cast("int")
    live = (
        (F.coalesce("DOTERM", F.lit("")) == "") & (F.col("OSGRDIND").cast("int") != 9)
        & (F.col("USERTYPE").cast("int") == 0) & code.between(*area_codes)
    )
    problem = postcode_problem("PCD")
    if postcodes == "skip":
        valid = problem.isNull()
    else:
        fail = F.raise_error(F.concat(F.lit("postcode "), F.coalesce("PCD", F.lit("null")), F.lit(": "), problem)).cast("boolean")
        valid = F.when(problem.isNull(), True).otherwise(fail)
    located = rows.where(live).where(valid).select(
        postcode_parts("PCD")["canonical"].alias("postcode"),
        F.col("LAT").cast("decimal(9,6)").alias("latitude"), F.col("LONG").cast("decimal(9,6)").alias("longitude"),
    )
    return located if keep_sentinel else located.where("not (latitude = 100 and longitude = 0)")


def read_postcode_centroids(
    spark: SparkSession, path: Paths, area_codes: tuple[int, int] = LONDON_AREA_CODES, keep_sentinel: bool = False,
    postcodes: str = "check",
) -> DataFrame:
    """The postcode directory CSV, every cell read as text; see :func:`active_centroids`."""
    directory = spark.read.option("header", True).csv(path if isinstance(path, str) else list(path))
    return active_centroids(directory, area_codes, keep_sentinel, postcodes)


_RING = "array<array<double>>"
_REGION_MAPS = {"ring": f"map<string,{_RING}>", "multi": f"map<string,array<array<{_RING}>>>"}


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_regions(spark: SparkSession, path: str, kind: str = "ring") -> DataFrame:
    """Region boundaries as one row per ring: region, part, ring_no, ring.

    ``kind``: ``ring`` (a map to single rings), ``multi`` (a map to parts of rings), or
    ``rows`` (JSON lines with region and ring, as ``write_regions`` makes them), which
    splits and is the form for very many regions. Vertices are longitude, latitude.
    """
    if kind == "rows":
        layout = f"region STRING, part INT, ring_no INT, ring {_RING}"
        rows = _require(_json(spark, path, layout, lines=True), ("region", "ring"), "region row")
        return rows.select(
            "region", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("ring_no", F.lit(0)).alias("ring_no"),
            _points(F.col("ring")).alias("ring"),
        )
    entries = _entries(spark, path, _REGION_MAPS[kind]).select(F.explode("_map").alias("region", "_shape"))
    if kind == "ring":
        return entries.select("region", F.lit(0).alias("part"), F.lit(0).alias("ring_no"), _points(F.col("_shape")).alias("ring"))
    parts = entries.select("region", F.posexplode("_shape").alias("part", "_rings"))
    rings = parts.select("region", "part", F.posexplode("_rings").alias("ring_no", "_ring"))
    return rings.select("region", "part", "ring_no", _points(F.col("_ring")).alias("ring"))


def _entries(spark: SparkSession, path: Paths, kind: str) -> DataFrame:
    """The entries of JSON objects, each as a map of one: file, block, no, _map."""
    one = F.concat(F.lit("{"), F.when(F.col("whole"), F.col("record")), F.lit("}"))
    return _elements(spark, path, entries=True).select("file", "block", "no", F.from_json(one, kind, {"mode": "FAILFAST"}).alias("_map"))


def read_named_map(spark: SparkSession, path: str, value_type: str, lines: bool = False) -> DataFrame:
    """JSON objects as rows, in order: name, value, position (the order in the file, over all its objects).

    With ``lines`` every line is an object and position is the order in the line.
    """
    kind = f"map<string,{value_type}>"
    if not lines:
        placed = with_position(_entries(spark, path, kind)).orderBy("file", "position")
        return placed.select(F.explode("_map").alias("name", "value"), F.col("position").cast("int").alias("position"))
    text = spark.read.text(path)
    entries = F.map_entries(F.from_json("value", kind, {"mode": "FAILFAST"}))
    return text.select(F.posexplode(entries).alias("position", "_e")).select(
        F.col("_e.key").alias("name"), F.col("_e.value").alias("value"), "position"
    )


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Commute places: name, latitude, longitude."""
    return read_named_map(spark, path, "array<double>").select(
        "name", F.col("value")[0].alias("latitude"), F.col("value")[1].alias("longitude")
    )


def read_search_places(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Search places: name, identifier, position."""
    return read_named_map(spark, path, "string", lines).withColumnRenamed("value", "identifier")


def read_price_caps(spark: SparkSession, path: str) -> DataFrame:
    """Price caps: name, cap."""
    return read_named_map(spark, path, "int").select("name", F.col("value").alias("cap"))


def read_location_matches(spark: SparkSession, path: Paths, lines: bool = False) -> DataFrame:
    """Location lookup results, one row per match, with ``identifier`` as ``type^id``."""
    results = _json(spark, path, LOCATION_MATCHES, lines)
    matches = results.select(F.posexplode("matches").alias("position", "_m")).select("position", "_m.*")
    return matches.withColumn("identifier", F.concat_ws("^", "type", "id"))
