"""New listings against a stored history, kept as the stream's own state.

The history is loaded into the state store once, when a query starts without a checkpoint; from then on a batch
meets only the state of the buckets of its own ids. A bucket (ids of one hash) is read and added to at once, as a call of
the state store for every id costs far more than the ids. Needs the RocksDB state store.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegralType, StringType

ROCKSDB = "RocksDBStateStoreProvider"
# Choose the buckets so that one holds at most some thousand ids; a checkpoint keeps the number that it began with.
BUCKETS = 1 << 16


class FirstInBucket(StatefulProcessor):
    """Emits the first row of every id of a bucket that neither the history nor an earlier row had."""

    def __init__(self, key: str, kind: str, forget_ms: int | None):
        self.key, self.kind, self.forget_ms = key, kind, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # An entry per batch that brought new ids, each forgotten by itself.
        self.seen = handle.getListState("seen", f"ids array<{self.kind}>", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = {known for entry in self.seen.get() for known in entry[0]}
        new = []
        for row in rows:
            found = row[self.key]
            if found not in seen:
                seen.add(found)
                new.append(found)
                # Without the bucket, the last column.
                yield Row(*row.__fields__[:-1])(*row[:-1])
        if new:
            self.seen.appendValue((new,))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.appendValue((list(initialState["ids"]),))

    def close(self) -> None:
        pass


class FirstOfId(StatefulProcessor):
    """Emits the first row of every id that neither the history nor an earlier row had: for ids of any type, a state each."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        first = next(rows, None)
        if first is not None:
            yield first

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def _in_buckets(kind: DataType) -> bool:
    """Types whose values are told apart in Python just as in Spark."""
    return isinstance(kind, IntegralType) or kind == StringType()


def stream_unseen_listings(
    stream: DataFrame, history: DataFrame | None, forget_after: dt.timedelta | None = None, key: str = "id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """The first row of each id that ``history`` lacks, once; null ids are one id.

    ``history`` (a batch table with the ids) is read when the query first starts, so ids of the history are never emitted, with
    a new checkpoint too: append what the stream emits to the history. ``forget_after`` bounds the state: an id may
    come again so long after it was first seen (or loaded), by the clock. A query with it that is drained needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` to be false, as the clock always asks for another batch.
    """
    session = stream.sparkSession
    if not session.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith(ROCKSDB):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to the {ROCKSDB}")
    if forget_after is not None and forget_after <= dt.timedelta(0):
        raise ValueError("forget_after must be positive")
    ms = None if forget_after is None else max(1, int(forget_after.total_seconds() * 1000))
    # Equal ids of the history are one.
    known = None if history is None else history.select(F.col(key)).distinct()
    kind = stream.schema[key].dataType
    if _in_buckets(kind):
        name = "_bucket"
        while name in stream.columns:
            name += "_"
        bucket = F.pmod(F.xxhash64(F.col(key).cast(kind)), F.lit(buckets)).cast("int").alias(name)
        grouped, processor = stream.select("*", bucket).groupBy(name), FirstInBucket(key, kind.simpleString(), ms)
        if known is not None:
            # Structs, as null is an id too.
            held = F.collect_list(F.struct(F.col(key).cast(kind).alias("id")))
            known = known.groupBy(bucket).agg(F.transform(held, lambda x: x["id"]).alias("ids")).groupBy(name)
    else:
        grouped, processor = stream.groupBy(key), FirstOfId(ms)
        known = None if known is None else known.groupBy(key)
    return grouped.transformWithState(
        statefulProcessor=processor, outputStructType=stream.schema, outputMode="Append",
        timeMode="None" if ms is None else "ProcessingTime", initialState=known)
