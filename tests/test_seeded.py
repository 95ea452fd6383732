"""Streams that know the stored history."""

import datetime as dt
import time

import pytest
from pyspark.sql import Row

from rentlens import streaming as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "id long, amount int, note string"


@pytest.fixture
def rocksdb(spark):
    settings = {PROVIDER: ROCKSDB, "spark.sql.shuffle.partitions": "2"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def put(spark, folder, n, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/file{n}")


def drain(spark, folder, history, state, **options):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    stream = S.stream_unseen_listings(source, history, **options)
    S.start_append(stream, f"{folder}/out-{state}", f"{folder}/{state}", drain=True).awaitTermination()
    return sorted(r.id for r in spark.read.parquet(f"{folder}/out-{state}").collect())


def test_ids_of_the_history_never_come(spark, tmp_path, rocksdb):
    history = spark.createDataFrame([(1,), (1,), (5,)], "id long")
    put(spark, tmp_path, 1, (1, 10, "a"), (2, 20, "b"), (2, 21, "c"))
    assert drain(spark, tmp_path, history, "first") == [2]
    # After a restart the state knows the history and what was emitted.
    put(spark, tmp_path, 2, (2, 22, "d"), (3, 30, "e"), (5, 50, "f"))
    assert drain(spark, tmp_path, history, "first") == [2, 3]
    # With a new checkpoint the appended history does.
    grown = history.unionByName(spark.read.parquet(f"{tmp_path}/out-first").select("id"))
    put(spark, tmp_path, 3, (3, 31, "g"), (4, 40, "h"))
    assert drain(spark, tmp_path, grown, "second") == [4]


def test_null_and_text_ids(spark, tmp_path, rocksdb):
    """A null id is an id, of the history too, and buckets may hold many ids."""
    rows = [("a", 1), (None, 2), ("b", 3), (None, 4), ("b", 5)]
    for n in (0, 3):
        spark.createDataFrame(rows[n:n + 3], "name string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/file{n}")
    for known, expected in (([("a",)], [None, "b"]), ([(None,), (None,)], ["a", "b"]), ([], ["a", None, "b"])):
        source = spark.readStream.schema("name string, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        history = spark.createDataFrame(known, "name string")
        stream = S.stream_unseen_listings(source, history, key="name", buckets=1)
        assert stream.columns == ["name", "n"]
        out = f"{tmp_path}/out{len(known)}{expected[0]}"
        S.start_append(stream, out, f"{out}-state", drain=True).awaitTermination()
        found = [r.name for r in spark.read.parquet(out).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_ids_of_other_types(spark, tmp_path, rocksdb):
    """Types that Python tells apart in other ways than Spark: a state for every id."""
    rows = [(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"b"),)]
    spark.createDataFrame(rows, "id binary").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id binary").parquet(f"{tmp_path}/in")
    stream = S.stream_unseen_listings(source, spark.createDataFrame(rows[:1], "id binary"))
    S.start_append(stream, f"{tmp_path}/out", f"{tmp_path}/state", drain=True).awaitTermination()
    assert [bytes(r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [b"b"]


def test_ids_of_a_bucket_take_one_call(monkeypatch):
    from rentlens.streaming.seeded import FirstInBucket

    calls = []

    class Held:
        entries = [([1, 2],), ([None],)]

        def get(self):
            calls.append("get")
            return iter(self.entries)

        def appendValue(self, value):
            calls.append(value)

    processor = FirstInBucket("id", "bigint", None)
    processor.seen = Held()
    rows = [Row(id=n, note=str(n), _bucket=0) for n in (5, 2, None, 5, 7)]
    assert list(processor.handleInputRows((0,), iter(rows), None)) == [(5, "5"), (7, "7")]
    assert calls == ["get", ([5, 7],)]


def test_ids_are_forgotten_in_time(spark, tmp_path, rocksdb):
    # With a clock there is always another batch to run, so a drained query would not end.
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        check_forgetting(spark, tmp_path)
    finally:
        spark.conf.set(name, before)


def check_forgetting(spark, tmp_path):
    put(spark, tmp_path, 1, (1, 10, "a"), (2, 20, "b"))
    history = spark.createDataFrame([(2,)], "id long")
    assert drain(spark, tmp_path, history, "s", forget_after=dt.timedelta(seconds=1)) == [1]
    time.sleep(1.5)
    put(spark, tmp_path, 2, (1, 11, "b"), (2, 22, "c"))
    assert drain(spark, tmp_path, history, "s", forget_after=dt.timedelta(seconds=1)) == [1, 1, 2]


def test_the_state_store_is_asked_for(spark, tmp_path):
    put(spark, tmp_path, 1, (1, 10, "a"))
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    with pytest.raises(ValueError, match="RocksDB"):
        S.stream_unseen_listings(source, None)
