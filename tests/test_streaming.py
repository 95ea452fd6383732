import contextlib
import io
import json
import re

import pytest
from pyspark.sql import functions as F

from rentlens.operators import rules as R
from rentlens.operators.snapshots import latest_per_listing
from rentlens import streaming as S
from rentlens.sources import stream_snapshots

SCHEMA = "id long, snapshot_ts long, amount int, frequency string, note string"


def put(spark, folder, n, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/file{n}")


@pytest.fixture
def folder(spark, tmp_path):
    put(spark, tmp_path, 1, (1, 200, 10, "monthly", "newer"), (2, 100, 20, "monthly", "b"), (2, 100, 20, "monthly", "a"))
    put(spark, tmp_path, 2, (1, 100, 11, "monthly", "late and older"), (3, 100, 9000, "monthly", "c"))
    return tmp_path


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def drain_append(stream, folder):
    S.start_append(stream, f"{folder}/out", f"{folder}/state", drain=True).awaitTermination()


def test_each_id_once_over_restarts(spark, folder, rows):
    for extra in (None, (4, 1, 1, "monthly", "d"), (1, 300, 1, "monthly", "again")):
        if extra:
            put(spark, folder, extra[0] + 10, extra)
        drain_append(S.stream_new_listings(source(spark, folder)).select("id"), folder)
    assert rows(spark.read.parquet(f"{folder}/out")) == [(1,), (2,), (3,), (4,)]


def test_bounded_state(spark, folder, rows):
    stamped = source(spark, folder).withColumn("at", F.timestamp_seconds("snapshot_ts"))
    drain_append(S.stream_new_listings(stamped, "at", "1 hour").select("id"), folder)
    assert rows(spark.read.parquet(f"{folder}/out")) == [(1,), (2,), (3,)]


def test_latest_equals_the_batch_result(spark, folder, rows):
    # The smallest note is taken on equal times, as in the batch call below.
    stream = source(spark, folder).withColumn("rank", F.when(F.col("note") == "a", 1).otherwise(0))
    updates = S.stream_latest(stream, ["snapshot_ts", "rank"]).drop("rank")
    for _ in range(2):
        S.start_upsert(updates, f"{folder}/out", f"{folder}/state", drain=True).awaitTermination()
        put(spark, folder, 3 if not _ else 4, (3, 900 + _, 7, "monthly", "newest"))
    S.start_upsert(updates, f"{folder}/out", f"{folder}/state", drain=True).awaitTermination()
    batch = latest_per_listing(spark.read.schema(SCHEMA).parquet(f"{folder}/in/*"), ties=["note"])
    columns = ["id", "snapshot_ts", "amount", "note"]
    assert rows(S.read_upserts(spark, f"{folder}/out").select(*columns)) == rows(batch.select(*columns))


def test_suitable(spark, folder, rows):
    flags = {c: F.lit(False) for c in ("commercial", "development", "students", "auction", "let_agreed")}
    stream = source(spark, folder).withColumns(flags).withColumns({"display_size": F.lit(None).cast("string")})
    rules = [R.rule_residential(), R.rule_has_price(), R.rule_max_rent(2000), R.rule_commute()]
    history = spark.createDataFrame([(2,)], "id long")
    commute = spark.createDataFrame([(1, True), (3, True)], "id long, commute_ok boolean")
    drain_append(S.stream_suitable(stream, rules, history, commute).select("id", "note"), folder)
    assert rows(spark.read.parquet(f"{folder}/out")) == [(1, "late and older"), (1, "newer")]


def test_snapshot_files_as_a_stream(spark, tmp_path, rows):
    listing = {
        "id": 1, "bedrooms": 1, "summary": "s", "location": {"latitude": 51.5, "longitude": 0.0}, "commercial": False,
        "development": False, "residential": True, "students": False, "auction": False, "channel": "RENT", "heading": "h",
    }
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "200.json").write_text(json.dumps([{**listing, "heading": "new"}, {**listing, "id": 2}]))
    (folder / "100.json").write_text(json.dumps([listing, {**listing, "id": 3}]))
    stream = stream_snapshots(spark, str(folder), files_per_batch=1).select("id", "snapshot_ts", "heading")
    S.start_upsert(S.stream_latest(stream, ["snapshot_ts"]), f"{tmp_path}/out", f"{tmp_path}/state", drain=True).awaitTermination()
    assert rows(S.read_upserts(spark, f"{tmp_path}/out")) == [(1, 200, "new"), (2, 200, "h"), (3, 100, "h")]


def test_rules_and_history_of_each_batch(spark, folder, rows):
    """Two batches a day apart: the clock has moved and the first listing has been seen."""
    import datetime as dt

    flags = {c: F.lit(False) for c in ("commercial", "development", "students", "auction", "let_agreed")}
    stream = source(spark, folder).withColumns(flags).withColumns({
        "display_size": F.lit(None).cast("string"), "first_visible_date": F.timestamp_seconds(F.col("snapshot_ts") * 1000)})
    seen, times = [], iter([dt.datetime(1970, 1, 2, tzinfo=dt.timezone.utc), dt.datetime(1970, 1, 9, tzinfo=dt.timezone.utc)])

    def history():
        seen.append(len(seen))
        return spark.createDataFrame([(2,)], "id long") if len(seen) > 1 else None

    run = lambda: S.start_suitable(
        stream, f"{folder}/out", f"{folder}/state", rules=lambda now: [R.rule_has_price(), R.rule_recent(now, 5)],
        clock=lambda: next(times), history=history, drain=True).awaitTermination()
    run()
    assert len(seen) == 2 and {r.id for r in spark.read.parquet(f"{folder}/out/batch=0").collect()} in ({1, 2}, {1, 3})
    assert spark.read.parquet(f"{folder}/out/batch=1").count() == 0  # more than five days old by then


def test_upserts_are_merged_now_and_then(spark, tmp_path, rows):
    for n in range(5):
        put(spark, tmp_path, n, (1, n, n, "monthly", "x"), (10 + n, n, n, "monthly", "y"))
    updates = S.stream_latest(source(spark, tmp_path), ["snapshot_ts"])
    S.start_upsert(updates, f"{tmp_path}/out", f"{tmp_path}/state", drain=True, merge_every=2).awaitTermination()
    wanted = sorted([(1, 4)] + [(10 + n, n) for n in range(5)])
    read = S.read_upserts(spark, f"{tmp_path}/out")
    assert sorted((r.id, r.amount) for r in read.collect()) == wanted
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        read.explain("formatted")
    plan = text.getvalue()
    assert "merged/upto-3" in plan and "merged/upto-1" not in plan
    assert re.search(r"PartitionFilters: .*batch#\d+ > 3", plan)
