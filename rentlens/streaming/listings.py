"""Streams of listings: each id once, the latest version, the suitable ones."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import lookup_join
from ..operators.rules import Rule, exclude_seen, suitable
from ..operators.snapshots import latest_per_key
from ..sources.tables import stored


def stream_new_listings(
    stream: DataFrame, event_time: str | None = None, forget_after: str | None = None
) -> DataFrame:
    """Each listing id once, as it first arrives.

    State holds every id ever seen, as the seen-history does. ``forget_after`` (with the
    ``timestamp`` column ``event_time``) bounds it: an id is then emitted once per period.
    """
    if forget_after is None:
        return stream.dropDuplicates(["id"])
    return stream.withWatermark(event_time, forget_after).dropDuplicatesWithinWatermark(["id"])


def stream_latest(stream: DataFrame, order: Sequence[Column | str], key: str = "id") -> DataFrame:
    """The version of each listing that is largest in ``order``.

    Arrival order plays no part, so late files are handled. One row per key is kept in
    state, and each batch is folded per task before its shuffle.
    """
    version = F.struct(*[c for c in stream.columns if c != key])
    rank = F.struct(*order)
    return stream.groupBy(key).agg(F.max_by(version, rank).alias("_v")).select(key, "_v.*")


def stream_suitable(
    stream: DataFrame, rules: Sequence[Rule], history: DataFrame | None = None,
    commute: DataFrame | None = None,
) -> DataFrame:
    """The suitable listings of a stream.

    ``commute(id, commute_ok)`` is joined when a commute rule is among ``rules``. Without
    state: every listing is judged by itself. Rules and history are those of the start;
    :func:`start_suitable` takes them anew for each batch.
    """
    fresh = exclude_seen(stream, history)
    if commute is not None:
        fresh = lookup_join(fresh, commute, "id", "left")
    return suitable(fresh, rules).drop("commute_ok")


def start_append(stream: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once; ``drain`` stops at the end of the input."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def start_suitable(
    stream: DataFrame, path: str, checkpoint: str, rules: Callable[[dt.datetime], Sequence[Rule]],
    clock: Callable[[], dt.datetime], history: Callable[[], DataFrame | None] = lambda: None,
    commute: Callable[[], DataFrame | None] = lambda: None, drain: bool = False,
) -> StreamingQuery:
    """The suitable listings of a stream that runs for days, written below each batch's number.

    For every batch ``clock`` is asked once, ``rules`` are made for that time, and ``history``
    and ``commute`` are read as they are then. A batch that is run again replaces its files.
    """
    def write(batch: DataFrame, number: int) -> None:
        found = stream_suitable(batch, rules(clock()), history(), commute())
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_upsert(
    updates: DataFrame, path: str, checkpoint: str, drain: bool = False, key: str = "id", merge_every: int = 50,
) -> StreamingQuery:
    """Write each batch's changed rows below its batch number.

    A batch that is run again replaces its own files, so the result is exact. After every
    ``merge_every`` batches the current rows are merged into one folder, so a read takes one
    merged folder and fewer than that many batches, however long the stream runs. Folders
    up to the last merged one are no longer read; give them a lifetime rule.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % merge_every == 0:
            merge_upserts(batch.sparkSession, path, number, key)

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _merged(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame | None, int]:
    """The rows of the last merge (before a batch) and the batch it reaches to."""
    versions = stored(spark, f"{path}/merges")
    if versions is not None and before is not None:
        versions = versions.where(F.col("upto") < before)
    upto = None if versions is None else versions.agg(F.max("upto")).first()[0]
    return (None, -1) if upto is None else (spark.read.parquet(f"{path}/merged/upto-{upto}"), upto)


def merge_upserts(spark: SparkSession, path: str, upto: int, key: str = "id") -> None:
    """Write the current rows up to batch ``upto`` as one folder, then make reads start there."""
    current = _current(spark, path, key, upto, before=upto)
    current.write.mode("overwrite").parquet(f"{path}/merged/upto-{upto}")
    spark.range(1).select(F.lit(upto).alias("upto")).write.mode("append").parquet(f"{path}/merges")


def _current(spark: SparkSession, path: str, key: str, upto: int | None = None, before: int | None = None) -> DataFrame:
    merged, reached = _merged(spark, path, before)
    batches = spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") > reached)
    if upto is not None:
        batches = batches.where(F.col("batch") <= upto)
    if merged is not None:
        batches = batches.unionByName(merged.withColumn("batch", F.lit(-1)))
    return latest_per_key(batches, key, "batch").drop("batch")


def read_upserts(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The current row of every key written by :func:`start_upsert`: that of its last batch."""
    return _current(spark, path, key)
