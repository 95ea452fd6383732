import contextlib
import datetime as dt
import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rentlens.operators import commute, stations
from rentlens.operators.listings import map_listing_location, with_listing_columns
from rentlens.operators.regions import assign_regions
from rentlens.operators.rules import exclude_seen
from rentlens.operators.snapshots import latest_per_listing
from rentlens import sources as S

LISTING = {
    "id": 1, "bedrooms": 2, "bathrooms": None, "numberOfImages": 3, "summary": "A £ flat", "displayAddress": "High Street",
    "location": {"latitude": 51.5, "longitude": -0.1},
    "propertyImages": {"images": [{"url": "u", "caption": None, "srcUrl": "s"}], "mainImageSrc": "m", "mainMapImageSrc": "mm"},
    "propertySubType": "Flat", "listingUpdate": {"listingUpdateReason": "new", "listingUpdateDate": "2024-06-01T10:00:00Z"},
    "price": {"amount": 1500, "frequency": "monthly", "currencyCode": "GBP", "displayPrices": [{"displayPrice": "£1,500 pcm", "displayPriceQualifier": ""}]},
    "customer": {"branchId": 7, "development": False, "commercial": False, "buildToRentBenefits": [], "developmentContent": {"headline": {"a": 1}, "features": [1]}},
    "commercial": False, "development": False, "residential": True, "students": False, "auction": False,
    "displaySize": "600 sq. ft.", "propertyUrl": "/p/1", "channel": "RENT", "firstVisibleDate": "2024-06-01T10:00:00+01:00",
    "keywords": ["garden"], "saved": None, "hidden": False, "heading": "Featured",
    "lozengeModel": {"matchingLozenges": [{"type": "LET_AGREED", "priority": 1}]}, "unknownField": {"ignored": True},
}


def put(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_listings(spark, tmp_path):
    path = put(tmp_path / "l.json", [LISTING, {**LISTING, "id": 2, "price": None, "lozengeModel": None}])
    df = S.read_listings(spark, path)
    assert len(df.columns) == 52 and "unknownField" not in df.columns
    flat = with_listing_columns(df).orderBy("id").collect()
    assert [(r.id, r.amount, r.let_agreed, r.agent_id, r.property_type) for r in flat] == [(1, 1500, True, 7, "flat"), (2, None, False, 7, "flat")]
    assert flat[0].first_visible_date == dt.datetime(2024, 6, 1, 9) and json.loads(flat[0].customer.developmentContent.headline) == {"a": 1}
    assert map_listing_location(df).columns == ["id", "location"]


@pytest.mark.parametrize("fmt", ["json", "lines", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    first = S.read_listings(spark, put(tmp_path / "l.json", [LISTING, {**LISTING, "id": 2, "keywords": None}]))
    S.write_listings(with_listing_columns(first), str(tmp_path / "out"), fmt)
    again = S.read_listings(spark, str(tmp_path / "out"), fmt)
    assert sorted(again.collect()) == sorted(first.collect()) and again.columns == first.columns


def test_written_json_is_camel_case(spark, tmp_path):
    S.write_listings(S.read_listings(spark, put(tmp_path / "l.json", [LISTING])), str(tmp_path / "out"), "lines")
    written = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    for field in ("id", "bedrooms", "bathrooms", "summary", "displayAddress", "propertySubType", "location", "propertyImages", "price", "keywords"):
        assert written[field] == LISTING[field]


def test_many_listings_in_many_files(spark, tmp_path):
    one = S.read_listings(spark, put(tmp_path / "l.json", [LISTING]))
    many = one.crossJoin(spark.range(1500).withColumnRenamed("id", "n")).withColumn("id", F.col("n")).drop("n").repartition(4)
    S.write_listings(many, str(tmp_path / "out"), "json")
    assert S.read_listings(spark, str(tmp_path / "out")).count() == 1500
    assert S.read_listings(spark, str(tmp_path / "out")).select("id").distinct().count() == 1500


def test_times_in_paths(spark):
    from rentlens.sources.readers import file_time

    paths = {"file:/d/part-1/17.json": 17, "file:/d/17.json/part-000-a.c000.txt": 17, "18": 18, "/x y/part-7/019": 19}
    times = spark.createDataFrame([(path,) for path in paths], "path string").select("path", file_time("path").alias("t"))
    assert {r.path: r.t for r in times.collect()} == paths
    for path in ("/d/part-17", "/d/part-17/part-1", "/d/1x.json/part-1", "/d/17.a.json", "/d//part-1", ""):
        with pytest.raises(Exception, match="file name is not a time"):
            spark.createDataFrame([(path,)], "path string").select(file_time("path")).collect()
    # Only the short name meets a pattern, not every place of the path.
    plan = times._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(path" not in plan


def test_written_arrays_are_bounded(monkeypatch):
    from rentlens.sources import tables

    monkeypatch.setattr(tables, "ARRAY_BYTES", 5000)
    batches = [pa.RecordBatch.from_pydict({"value": [json.dumps({"id": n, "t": "x" * 20}) for n in range(m, m + 900)]}) for m in (0, 900)]
    arrays = [text for batch in tables._as_arrays(iter(batches)) for text in batch.column(0).to_pylist()]
    assert len(arrays) > 4 and all(len(text) < 20_000 for text in arrays)
    assert [record["id"] for text in arrays for record in json.loads(text)] == list(range(1800))
    assert list(tables._as_arrays(iter([]))) == []


def test_written_arrays_are_files_of_their_own(spark, tmp_path):
    """Read back in one pass: no file is cut."""
    from rentlens.sources import json_texts

    one = S.read_listings(spark, put(tmp_path / "l.json", [LISTING]))
    many = one.crossJoin(spark.range(60_000).withColumnRenamed("id", "n")).withColumn("id", F.col("n")).drop("n").coalesce(1)
    S.write_listings(many, str(tmp_path / "out"), "json")
    files = list((tmp_path / "out").glob("part-*"))
    assert sum(file.stat().st_size for file in files) > json_texts.SPLIT_BYTES > max(file.stat().st_size for file in files)
    assert json_texts._starts(spark, str(tmp_path / "out")) == {}
    assert S.read_listings(spark, str(tmp_path / "out")).agg(F.count("*"), F.sum("id")).first() == (60_000, 60_000 * 59_999 // 2)


def test_several_texts_in_a_file_are_all_read(spark, tmp_path):
    path = put(tmp_path / "l.json", "\n".join(json.dumps({**LISTING, "id": n}) for n in (1, 2)))
    assert S.read_listings(spark, path).count() == S.read_listings(spark, path, "lines").count() == 2
    joined = put(tmp_path / "j.json", json.dumps([LISTING]) + json.dumps({**LISTING, "id": 2}) + json.dumps([]) + json.dumps([LISTING]))
    assert sorted(r.id for r in S.read_listings(spark, joined).collect()) == [1, 1, 2]
    pretty = put(tmp_path / "p.json", json.dumps([LISTING, {**LISTING, "id": 2, "summary": "}\n{"}], indent=2))
    assert S.read_listings(spark, pretty).count() == 2


def test_a_cut_off_file_gives_its_good_records_and_one_bad(spark, tmp_path):
    text = json.dumps([{**LISTING, "id": n} for n in range(3)])
    put(tmp_path / "a.json", text)
    broken = put(tmp_path / "b.json", text[:-40])
    good, bad = S.split_listings(spark, str(tmp_path))
    assert sorted(r.id for r in good.collect()) == [0, 0, 1, 1, 2] and [r.problem for r in bad.collect()] == ["unreadable"]
    with pytest.raises(Exception, match="broken JSON text"):
        S.read_listings(spark, broken).collect()


def test_maps_of_several_objects(spark, tmp_path):
    for gap in ("", "\n", " "):
        path = put(tmp_path / "m.json", gap.join(['{"a": [1, 2]}', "{}", '{"b": [3, 4], "c,}": [5, 6]}']))
        assert [tuple(r) for r in S.read_places(spark, path).orderBy("longitude").collect()] == [("a", 1, 2), ("b", 3, 4), ("c,}", 5, 6)]
        named = S.read_named_map(spark, path, "array<double>")
        assert sorted((r.position, r.name) for r in named.collect()) == [(0, "a"), (1, "b"), (2, "c,}")]
    put(tmp_path / "m.json", '{"a": [1, 2], "b": [3')
    with pytest.raises(Exception, match="broken JSON text"):
        S.read_places(spark, str(tmp_path / "m.json")).collect()


@pytest.mark.parametrize("field, change", [
    ("price.amount", {"price": {"frequency": "monthly"}}), ("price.frequency", {"price": {"amount": 5}}),
    ("customer.development", {"customer": {"commercial": False, "buildToRentBenefits": []}}),
    ("propertyImages.images", {"propertyImages": {"images": [{"url": "u"}], "mainImageSrc": "m", "mainMapImageSrc": "n"}}),
    ("lozengeModel.matchingLozenges", {"lozengeModel": {"matchingLozenges": [{"type": "x"}]}}),
])
def test_nested_fields_are_required(spark, tmp_path, field, change):
    path = put(tmp_path / "l.json", [LISTING, {**LISTING, **change}])
    with pytest.raises(Exception, match=f"listing without {field}"):
        S.read_listings(spark, path).select("id").collect()
    good, bad = S.split_listings(spark, path)
    assert good.count() == 1 and [r.problem for r in bad.collect()] == [f"without {field}"]


def test_broken_region_lines_fail(spark, tmp_path):
    put(tmp_path / "r.json", '{"region": "a", "ring": [[0, 0], [1, 0], [1, 1]]}\n{"region": "b", "ring": 5}')
    with pytest.raises(Exception):
        S.read_regions(spark, str(tmp_path / "r.json"), "rows").collect()
    put(tmp_path / "s.json", '{"region": "a"}')
    with pytest.raises(Exception, match="region row without ring"):
        S.read_regions(spark, str(tmp_path / "s.json"), "rows").collect()


def test_only_a_missing_path_counts_as_nothing_written(spark, tmp_path):
    from rentlens.sources.tables import stored

    assert stored(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        stored(spark, str(tmp_path / "empty"))


BAD = [
    {**LISTING, "id": "two"}, {k: v for k, v in LISTING.items() if k != "heading"}, {**LISTING, "location": {"latitude": 51.5}},
    {**LISTING, "price": {"amount": "lots", "frequency": "monthly"}},
]


@pytest.mark.parametrize("bad", BAD)
def test_bad_listing_fails_the_load(spark, tmp_path, bad):
    path = put(tmp_path / "l.json", [LISTING, bad])
    with pytest.raises(Exception):
        S.read_listings(spark, path).select("bedrooms").collect()


def test_bad_listings_set_aside(spark, tmp_path):
    good, bad = S.split_listings(spark, put(tmp_path / "l.json", [LISTING, *BAD, {**LISTING, "id": 9}]))
    assert [r.id for r in good.orderBy("id").collect()] == [1, 9]
    assert sorted(r.problem for r in bad.collect()) == ["unreadable", "unreadable", "without heading", "without location.longitude"]
    assert good.columns == S.read_listings(spark, str(tmp_path / "l.json")).columns


def test_snapshots(spark, tmp_path):
    put(tmp_path / "100.json", [LISTING, {**LISTING, "id": 2, "heading": "old"}])
    put(tmp_path / "200.json", [{**LISTING, "id": 2, "heading": "new", "price": None}, {**LISTING, "id": 3}])
    latest = latest_per_listing(S.read_snapshots(spark, str(tmp_path)))
    assert {r.id: (r.snapshot_ts, r.heading) for r in latest.collect()} == {1: (100, "Featured"), 2: (200, "new"), 3: (200, "Featured")}
    assert S.read_snapshots(spark, [str(tmp_path / "100.json")]).count() == 2
    put(tmp_path / "abc.json", [LISTING])
    with pytest.raises(Exception, match="file name is not a time: abc.json"):
        S.read_snapshots(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_snapshot_folders(spark, tmp_path, fmt):
    one = S.read_listings(spark, put(tmp_path / "l.json", [LISTING, {**LISTING, "id": 2}]))
    path = str(tmp_path / "series")
    for ts in (100, 200, 200):  # the second run of 200 replaces the first
        S.write_snapshots(one.where(f"id * 100 <= {ts}").withColumn("snapshot_ts", F.lit(ts)), path, fmt)
    found = S.read_snapshots(spark, path, fmt, by="folder")
    assert sorted((r.id, r.snapshot_ts) for r in found.collect()) == [(1, 100), (1, 200), (2, 200)]
    assert latest_per_listing(found).where("snapshot_ts = 200").count() == 2


def test_history_table(spark, tmp_path, rows):
    path = str(tmp_path / "history")
    frame = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, note string")
    S.append_unseen(frame(1, 2, 2), path)
    S.append_unseen(frame(2, 3), path)
    assert rows(spark.read.parquet(path).select("id")) == [(1,), (2,), (3,)]
    failing = frame(4).withColumn("note", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        S.append_unseen(failing, path)
    assert spark.read.parquet(path).count() == 3
    S.append_unseen(frame(9), path, reset=True)
    assert rows(spark.read.parquet(path).select("id")) == [(9,)]


def test_published_versions(spark, tmp_path, rows):
    base = str(tmp_path / "table")
    assert S.current_table(spark, base) is None
    assert S.publish_table(spark.range(3), base) == 1
    # A new version may read the one before it.
    assert S.publish_table(S.current_table(spark, base).where("id > 0"), base) == 2
    assert rows(S.current_table(spark, base)) == [(1,), (2,)]
    with pytest.raises(Exception):
        S.publish_table(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id")), base)
    assert rows(S.current_table(spark, base)) == [(1,), (2,)]
    assert S.publish_table(spark.range(1), base) == 3


def test_keyed_tables_join_without_a_shuffle(spark, tmp_path, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, ids in (("kept_listings", spark.range(100)), ("kept_history", spark.range(0, 100, 3))):
            S.write_keyed_table(ids, name, 4, path=str(tmp_path / name))
        fresh = exclude_seen(spark.table("kept_listings"), spark.table("kept_history"))
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            fresh.explain()
        assert "SortMergeJoin" in text.getvalue() and "Exchange" not in text.getvalue()
        assert fresh.count() == 66
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS kept_listings")
        spark.sql("DROP TABLE IF EXISTS kept_history")


HEADER = "PCD,LAT,LONG,DOTERM,OSGRDIND,USERTYPE,OSLAUA"
LINES = [
    ("E1 6AN", "51.5", "-0.1", "", "1", "0", "E09000001", True), ("e16ap ", " 51.5", "-0.1 ", " ", "1", "0", "E09000033", True),
    ("E1 6AQ", "51.5", "-0.1", "202001", "1", "0", "E09000001", False), ("E1 6AR", "51.5", "-0.1", "", "9", "0", "E09000001", False),
    ("E1 6AS", "51.5", "-0.1", "", "1", "1", "E09000001", False), ("E1 6AT", "51.5", "-0.1", "", "1", "0", "W09000001", False),
    ("E1 6AU", "51.5", "-0.1", "", "1", "0", "E09000000", False), ("E1 6AW", "51.5", "-0.1", "", "1", "0", "E09000034", False),
    ("E1 6AX", "100", "0", "", "1", "0", "E09000001", False), ("E1 6AY", "51.123456", "0", "", "1", "0", "E09000002", True),
]


@pytest.mark.parametrize("header", [HEADER, HEADER.lower(), "pcd,LAT,long,DOTERM,osgrdind,USERTYPE,OSLAUA"])
def test_postcode_directory(spark, tmp_path, header):
    path = put(tmp_path / "pd.csv", "\n".join([header] + [",".join(line[:7]) for line in LINES]) + "\n")
    found = S.read_postcode_centroids(spark, path)
    assert sorted(r.postcode for r in found.collect()) == ["E1 6AN", "E1 6AP", "E1 6AY"]
    assert str(found.where("postcode = 'E1 6AY'").first().latitude) == "51.123456"
    assert S.read_postcode_centroids(spark, path, keep_sentinel=True).count() == 4
    assert S.read_postcode_centroids(spark, path, area_codes=(9000000, 9000040)).count() == 5


def test_postcode_directory_without_a_column(spark, tmp_path):
    with pytest.raises(KeyError, match="OSLAUA"):
        S.read_postcode_centroids(spark, put(tmp_path / "pd.csv", "PCD,LAT,LONG,DOTERM,OSGRDIND,USERTYPE,Oslaua\n"))


def test_regions(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    rings = S.read_regions(spark, put(tmp_path / "r.json", {"a": square, "b": square}), "ring")
    assert rings.count() == 2 and [tuple(p) for p in rings.first().ring][:2] == [(0, 0), (4, 0)]
    multi = S.read_regions(spark, put(tmp_path / "m.json", {"a": [[square, square], [square]], "none": []}), "multi")
    assert sorted((r.region, r.part, r.ring_no) for r in multi.collect()) == [("a", 0, 0), ("a", 0, 1), ("a", 1, 0)]
    S.write_regions(multi, str(tmp_path / "rows"))
    again = S.read_regions(spark, str(tmp_path / "rows"), "rows")
    assert sorted(again.collect()) == sorted(multi.collect())
    points = spark.createDataFrame([(1, 1.0, 1.0)], "id long, longitude double, latitude double")
    assert assign_regions(points, again).count() == 1


def test_named_maps(spark, tmp_path):
    places = S.read_places(spark, put(tmp_path / "p.json", {"Big Ben": [51.5007, -0.1246], "Home": [51, 0]}))
    assert [tuple(r) for r in places.collect()] == [("Big Ben", 51.5007, -0.1246), ("Home", 51.0, 0.0)]
    searched = S.read_search_places(spark, put(tmp_path / "s.json", {"B": "STATION^569", "A": "REGION^1"}))
    assert [tuple(r) for r in searched.collect()] == [("B", "STATION^569", 0), ("A", "REGION^1", 1)]
    assert [tuple(r) for r in S.read_price_caps(spark, put(tmp_path / "c.json", {"B": 2000})).collect()] == [("B", 2000)]


def test_location_matches(spark, tmp_path):
    match = {"id": "569", "type": "STATION", "displayName": "Barbican Station", "highlighting": "<span>", "highlights": [{"text": "Barbican Station", "highlighted": True}]}
    row = S.read_location_matches(spark, put(tmp_path / "m.json", {"matches": [match]})).first()
    assert (row.identifier, row.displayName, row.highlights[0].highlighted) == ("STATION^569", "Barbican Station", True)


def journey_result(mode="tube", start="2024-06-03T08:00:00"):
    step = {"description": "Walk", "streetName": "High Street", "distance": 5, "latitude": 51.5, "longitude": -0.1}
    leg = {
        "duration": 10, "instruction": {"summary": "s", "detailed": "d", "steps": [step, step]}, "obstacles": [],
        "departureTime": start, "arrivalTime": "2024-06-03T09:10:00+01:00", "departurePoint": {"commonName": "Here"},
        "arrivalPoint": {"commonName": "There"}, "mode": {"id": mode}, "isDisrupted": False, "routeOptions": [{"name": "x", "lineIdentifier": {"id": "y"}}],
    }
    journey = {"startDateTime": start, "duration": 20, "arrivalDateTime": start, "alternativeRoute": False, "legs": [leg, leg], "fare": {"totalCost": 350, "fares": [{"a": 1}], "caveats": []}}
    return {
        "$type": "x", "journeys": [journey], "lines": [], "stopMessages": [], "recommendedMaxAgeMinutes": 1,
        "searchCriteria": {"dateTime": start, "dateTimeType": "Arriving"}, "journeyVector": {"from": "a", "to": "b", "via": "", "uri": ""},
    }


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_journeys(spark, tmp_path, zone):
    path = put(tmp_path / "j.json", journey_result())
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        results = S.read_journeys(spark, path)
        fact = commute.journey_facts(results, ["source_file"]).select("*", F.unix_seconds("start").alias("s")).first()
        legs = commute.leg_facts(results, ["source_file"]).select("*", F.unix_seconds("departure").alias("d"), F.unix_seconds("arrival").alias("a")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = int(dt.datetime(2024, 6, 3, 8, tzinfo=dt.timezone.utc).timestamp())
    assert (fact.source_file, fact.duration, fact.modes, fact.total_cost, fact.s) == ("j.json", 20, ["tube", "tube"], 350, start)
    assert [(leg.leg_no, leg.mode, leg.d, leg.a, leg.n_steps) for leg in legs] == [(n, "tube", start, start + 600, 2) for n in (0, 1)]
    assert commute.step_facts(results, ["source_file"]).count() == 4


def test_journey_checks(spark, tmp_path):
    with pytest.raises(Exception, match="unknown transport mode"):
        commute.journey_facts(S.read_journeys(spark, put(tmp_path / "m.json", journey_result(mode="rocket"))), []).collect()
    missing = journey_result()
    del missing["lines"]
    with pytest.raises(Exception, match="journey result without lines"):
        S.read_journeys(spark, put(tmp_path / "n.json", missing)).collect()
    timeless = journey_result()
    del timeless["journeys"][0]["duration"]
    with pytest.raises(Exception, match="without a journey's times"):
        S.read_journeys(spark, put(tmp_path / "t.json", timeless)).collect()
    nameless = journey_result()
    nameless["journeys"][0]["legs"][1]["arrivalPoint"] = {}
    with pytest.raises(Exception, match="without a leg's stop names"):
        S.read_journeys(spark, put(tmp_path / "s.json", nameless)).collect()
    put(tmp_path / "l.json", "\n".join(map(json.dumps, (journey_result(), timeless, nameless))))
    good, bad = S.split_journeys(spark, str(tmp_path / "l.json"))
    assert good.count() == 1
    assert bad.count() == 2
    none = {**journey_result(), "journeys": []}
    assert commute.journey_facts(S.read_journeys(spark, put(tmp_path / "e.json", none)), []).count() == 0


FEED = """<?xml version="1.0" encoding="utf-8"?>
<Root><name>Feed</name><open>1</open><description>d</description>
<Attribution><Url>u</Url><Text>Thanks</Text><Logo>l</Logo></Attribution>
<Style id="s"><IconStyle><Icon><href>icon.png</href></Icon></IconStyle></Style>
<Header canonical="c"><Identifier>id1</Identifier><DisplayTitle>Stations</DisplayTitle><RefreshRate>5</RefreshRate></Header>
<stations>
 <station id="1" type="Underground"><name>Acton
   Town</name><contactDetails><address>Gunnersbury   Lane</address><phone>0343</phone></contactDetails>
  <servingLines><servingLine>District</servingLine><servingLine>Piccadilly</servingLine></servingLines>
  <zones><zone>3</zone></zones><facilities><facility name="Lifts">0</facility></facilities>
  <entrances><entrance><name>Main</name><entranceToBookingHallSteps>4</entranceToBookingHallSteps>
    <bookingHallToPlatform><pointName>P1</pointName><path><heading>h1</heading><pathDescription>d1</pathDescription></path>
      <path><heading>h2</heading><pathDescription>d2</pathDescription></path></bookingHallToPlatform>
    <bookingHallToPlatform><pointName>P2</pointName></bookingHallToPlatform>
    <platformToTrain><trainName>T</trainName><platformToTrainSteps>1</platformToTrainSteps></platformToTrain></entrance></entrances>
  <openingHours><openingHour><entrance>Main</entrance><timeIntervals type="weekday"><timeInterval><from>0500</from><to>1200</to></timeInterval>
    <timeInterval><from>1300</from><to>2300</to></timeInterval></timeIntervals></openingHour></openingHours>
  <Placemark><name>Acton Town</name><description>d</description><Point><coordinates>
     -0.28025120353611,51.50280</coordinates></Point><styleUrl>#s</styleUrl></Placemark></station>
 <station id="2" type="Underground"><name>Bare</name><contactDetails><address>a</address><phone>p</phone></contactDetails></station>
</stations></Root>"""


def test_station_feed(spark, tmp_path, rows):
    path = put(tmp_path / "feed.xml", FEED)
    df = S.read_stations(spark, path)
    dim = {r.station_id: r for r in stations.station_dim(df).collect()}
    assert (dim["1"].name, dim["1"].address, dim["1"].longitude, dim["1"].latitude, dim["1"].altitude) == ("Acton Town", "Gunnersbury Lane", -0.28025120353611, 51.5028, 0.0)
    assert (dim["2"].name, dim["2"].longitude, dim["2"].altitude) == ("Bare", None, None)
    assert rows(stations.station_lines(df)) == [("1", "District"), ("1", "Piccadilly")]
    assert rows(stations.station_zones(df)) == [("1", "3")]
    assert rows(stations.station_facilities(df)) == [("1", "Lifts", "0")]
    assert rows(stations.station_entrances(df)) == [("1", 0, "Main", None, "4")]
    assert rows(stations.station_paths(df).select("point_no", "path_no", "point_name", "heading")) == [(0, 0, "P1", "h1"), (0, 1, "P1", "h2"), (1, None, "P2", None)]
    assert rows(stations.station_trains(df)) == [("1", 0, "T", "1")]
    assert rows(stations.station_hours(df)) == [("1", "Main", "weekday", "0500", "1200"), ("1", "Main", "weekday", "1300", "2300")]
    header = S.read_station_feed_header(spark, path).first()
    assert (header.Identifier, header._canonical, header.RefreshRate) == ("id1", "c", 5)
    assert rows(S.read_station_feed_styles(spark, path)) == [("s", "icon.png")]
    assert S.read_station_feed_attribution(spark, path).first().Text == "Thanks"


def test_a_record_is_parsed_once_by_a_split(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    for part in S.split_listings(spark, str(tmp_path)):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1


def test_journey_results_are_stored_compressed_in_many_files(spark, tmp_path, monkeypatch):
    from rentlens.plans import queries

    monkeypatch.setattr(queries, "RESULTS_PER_FILE", 10)
    queries._stored_results(spark.range(100, numPartitions=2)).json(str(tmp_path / "results"))
    files = sorted(file.name for file in (tmp_path / "results").glob("part-*"))
    assert len(files) == 10 and all(name.endswith(".gz") for name in files)
    assert spark.read.schema("id long").json(str(tmp_path / "results")).distinct().count() == 100


def test_journeys_split_in_one_frame_have_the_same_verdicts(spark, tmp_path, rows):
    timeless, nameless, wrong = journey_result(), journey_result(), journey_result()
    del timeless["journeys"][0]["duration"]
    nameless["journeys"][0]["legs"][1]["arrivalPoint"] = {}
    wrong["journeys"][0]["duration"] = "long"
    texts = [json.dumps(result) for result in (journey_result(), timeless, nameless, wrong, journey_result(), {"lines": []})] + ["", "{"]
    path = put(tmp_path / "l.json", "\n".join(texts))
    good, bad = S.split_journeys(spark, path)
    both = S.split_journeys(spark, path, apart=False)
    assert (good.count(), bad.count(), both.count()) == (2, 6, 8)
    assert rows(both.where("problem is null").select(*good.columns)) == rows(good)
    assert rows(both.where("problem is not null").select("record", "problem")) == rows(bad)
    assert sorted(row.record for row in both.select("record").collect()) == sorted(texts)


def test_broken_journey_records_are_counted_in_one_pass(spark, tmp_path):
    from rentlens.plans.queries import QUERIES

    keys = [(17,), (19,), (23,), (38,), (1,), (2,), (None,)]
    lines = spark.createDataFrame(keys, "l_partkey long").selectExpr(
        "1L as l_orderkey", "1 as l_linenumber", "l_partkey", "3L as l_suppkey", "timestamp '2024-06-03 08:00:00' as l_shipdate")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["bad_journeys"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert {row.problem: row.records for row in found.collect()} == {
        "good": 2, "unreadable": 2, "without a journey's times, duration, legs or fare": 2, "without a leg's stop names": 1}
