"""Latest version per listing, seen-history and table merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(
    df: DataFrame, key: Sequence[str] | str, newest: str, ties: Sequence[Column | str] = ()
) -> DataFrame:
    """One row per key: the largest ``newest``, then the first in the order of ``ties``.

    Spark turns ``row_number() = 1`` into a group limit that runs before the shuffle, so
    a key that holds a third of the rows sends one row per task.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*key).orderBy(F.col(newest).desc(), *ties)
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_per_listing(
    snapshots: DataFrame, newest: str = "snapshot_ts", ties: Sequence[Column | str] | None = None
) -> DataFrame:
    """The newest record of every listing over all snapshots.

    Records with the same time are told apart by ``ties``; without it by the hash of the
    record, so the choice is the same on every run.
    """
    if ties is None:
        ties = [F.xxhash64(*[c for c in snapshots.columns if c != newest])]
    return latest_per_key(snapshots, "id", newest, ties)


def unseen(df: DataFrame, history: DataFrame | None, order: Sequence[Column | str] = ()) -> DataFrame:
    """The rows an append adds to the history: ids it lacks, each once.

    Of equal ids within ``df`` the first in ``order`` is kept (default: by hash of the row).
    """
    order = list(order) or [F.xxhash64(*df.columns)]
    first = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    # Equal ids are folded before the shuffle; the anti join then uses its partitioning.
    once = df.withColumn("_rank", first).where("_rank = 1").drop("_rank")
    return once if history is None else once.join(history.select("id"), "id", "left_anti")


def _once_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in ``order``; without an order, a repeated key fails the query."""
    if order:
        by = [c if isinstance(c, Column) else F.col(c) for c in order]
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc_nulls_last() for c in by]))
        return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    repeated = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    message = F.concat(F.lit("key given twice: "), F.to_json(F.struct(*key)))
    fail = F.raise_error(message).cast("boolean")
    return df.withColumn("_rank", repeated).where(F.when(F.col("_rank") > 1, fail).otherwise(True)).drop("_rank")


def merge_rows(
    existing: DataFrame, updates: DataFrame, key: Sequence[str], values: Sequence[str], order: Sequence[Column | str] = ()
) -> DataFrame:
    """Upsert: every key of both sides, the update's values where it has the key.

    Adds ``change``: ``kept``, ``same``, ``new`` or ``changed``; only the last two need to
    be written. Keys are unique in ``existing``. Of updates with equal keys the last in
    ``order`` counts; without an order they fail the query.
    """
    return _merged(existing, updates, key, values, order, "full_outer")


def altered_rows(
    existing: DataFrame, updates: DataFrame, key: Sequence[str], values: Sequence[str], order: Sequence[Column | str] = ()
) -> DataFrame:
    """The rows of :func:`merge_rows` that are new or changed, without ``change``; what the update lacks is not carried along."""
    merged = _merged(existing, updates, key, values, order, "right")
    return merged.where(F.col("change").isin("new", "changed")).drop("change")


def _merged(
    existing: DataFrame, updates: DataFrame, key: Sequence[str], values: Sequence[str], order: Sequence[Column | str], how: str
) -> DataFrame:
    key, values = list(key), list(values)
    old = existing.select(*key, F.struct(*values).alias("_old"))
    new = _once_per_key(updates, key, order).select(*key, F.struct(*values).alias("_new"))
    change = (
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("changed")
    )
    merged = old.join(new, key, how).withColumn("change", change)
    pick = F.coalesce("_new", "_old")
    return merged.select(*key, *[pick[v].alias(v) for v in values], "change")


PAIR = ("src_lat", "src_lon", "dst_lat", "dst_lon")


def merge_journeys(
    cache: DataFrame, updates: DataFrame, key: Sequence[str] = PAIR, values: Sequence[str] = ("journeys",),
    order: Sequence[Column | str] = (),
) -> DataFrame:
    """The journey cache after an update; see :func:`merge_rows`."""
    return merge_rows(cache, updates, key, values, order)


def changed_journeys(
    cache: DataFrame, updates: DataFrame, key: Sequence[str] = PAIR, values: Sequence[str] = ("journeys",),
    order: Sequence[Column | str] = (),
) -> DataFrame:
    """Only the pairs an update adds or alters."""
    return merge_rows(cache, updates, key, values, order).where(F.col("change").isin("new", "changed"))


def ambiguous_places(matches: DataFrame, by: str = "query") -> DataFrame:
    """Matches whose query found more than one place, for a person to choose from."""
    several = matches.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1").select(by)
    return matches.join(several, by, "left_semi")


def merge_search_places(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Search places (name, identifier, position) after an update.

    Existing names keep their position and take the new identifier; new names follow in
    name order, after the last position. Two updates of one name fail the query.
    """
    from .batches import number_rows

    counted = updates.groupBy("name").agg(F.first("identifier").alias("identifier"), F.count("*").alias("_n"))
    message = F.concat(F.lit("name given twice: "), F.col("name"))
    checked = counted.where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True))
    merged = existing.withColumnRenamed("identifier", "_old").join(
        checked.select("name", F.col("identifier").alias("_new")), "name", "full_outer"
    )
    added = updates.select("name").distinct().join(existing.select("name"), "name", "left_anti")
    last = existing.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("_next"))
    placed = number_rows(added, "name", "_place").crossJoin(F.broadcast(last))  # one row
    numbered = merged.join(placed.select("name", (F.col("_next") + F.col("_place") - 1).alias("_position")), "name", "left")
    position = F.coalesce("position", "_position").cast(existing.schema["position"].dataType)
    return numbered.select(
        "name", F.coalesce("_new", "_old").alias("identifier"), position.alias("position"),
        F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "new").otherwise("replaced").alias("change"),
    )
