"""Numbering, batching and paging."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import IDS_PER_REQUEST, LIST_CAP
from ..session import cut_lineage

# Up to this many rows one sorted partition numbers them.
SINGLE_TASK_ROWS = 200_000
# Parts a group is cut to its first rows in, before the parts are brought together.
GROUP_PARTS = 64
# Spark limits groups before a shuffle up to this many rows (its default).
GROUP_LIMIT = 1000


def number_rows(df: DataFrame, key: str, number: str = "row_no", rows: int | None = None) -> DataFrame:
    """Number the rows 1..n in the order of ``key`` (unique).

    A table above ``SINGLE_TASK_ROWS`` is range-partitioned, sorted and numbered within its
    partitions, and checkpointed so that both reads below see the same partitions. Each
    partition then adds the number of rows before it, found from one count per partition.
    Its own columns take names that neither the table nor ``number`` has.
    """
    if rows is None:
        rows = df.count()
    if rows <= SINGLE_TASK_ROWS:
        return df.withColumn(number, F.row_number().over(Window.orderBy(key)).cast("bigint"))
    parts = max(2, math.ceil(rows / SINGLE_TASK_ROWS))
    mark = "_"
    while any(name.lower().startswith(f"{mark}number_") for name in (*df.columns, number)):
        mark += "_"
    place, part, before, count = (f"{mark}number_{name}" for name in ("place", "part", "before", "rows"))
    # The id holds the partition in its upper bits and counts from 0 in its lower 33 bits.
    ordered = df.repartitionByRange(parts, key).sortWithinPartitions(key)
    placed = cut_lineage(ordered.withColumn(place, F.monotonically_increasing_id())).withColumns({
        part: F.shiftright(place, 33), place: F.col(place).bitwiseAND((1 << 33) - 1),
    })
    earlier = F.coalesce(
        F.sum(count).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # One row per partition: the number of partitions bounds this table.
    offsets = placed.groupBy(part).agg(F.count("*").alias(count)).select(part, earlier.alias(before))
    return (
        placed.join(F.broadcast(offsets), part)
        .withColumn(number, (F.col(before) + F.col(place) + 1).cast("bigint"))
        .drop(part, place, before)
    )


def batch_keys(df: DataFrame, key: str = "id", size: int = IDS_PER_REQUEST) -> DataFrame:
    """The distinct keys in ascending order, ``size`` to a batch.

    Columns: batch_no from 0, n_keys, first_key, last_key, keys (comma-separated text).
    """
    numbered = number_rows(df.select(key).distinct(), key)
    batch = F.floor((F.col("row_no") - 1) / size).cast("bigint")
    in_order = F.array_sort(F.collect_list(F.col(key)))  # at most ``size`` keys to a group
    return (
        numbered.groupBy(batch.alias("batch_no"))
        .agg(
            F.count("*").alias("n_keys"), F.min(key).alias("first_key"), F.max(key).alias("last_key"),
            F.array_join(F.transform(in_order, lambda k: k.cast("string")), ",").alias("keys"),
        )
    )


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, key: str = "id") -> DataFrame:
    """The first ``k`` rows of every group in ``order``, with their ``row_no``.

    Each group is first cut to ``k`` rows in each of ``GROUP_PARTS`` parts (by hash of
    ``key``), so a group that holds a third of the rows is sorted by many tasks, and only
    what is left of it by one. Beyond ``GROUP_LIMIT`` rows the limit would not run before the
    shuffle, so the first ones are taken, then the first of the others. ``order`` is total.
    """
    if k > GROUP_LIMIT:
        first = top_per_group(df, by, order, GROUP_LIMIT, key)
        others = df.join(first.select(*by, key), [*by, key], "left_anti")
        more = top_per_group(others, by, order, k - GROUP_LIMIT, key)
        return first.unionByName(more.withColumn("row_no", F.col("row_no") + GROUP_LIMIT))
    part = F.pmod(F.xxhash64(key), F.lit(GROUP_PARTS))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    few = df.withColumn("_part", part).withColumn("row_no", within).where(F.col("row_no") <= k).drop("_part", "row_no")
    return few.withColumn("row_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("row_no") <= k)


def paged(
    df: DataFrame, order: Sequence[Column | str], size: int = 24, cap: int = LIST_CAP, by: Sequence[str] = ()
) -> DataFrame:
    """The first rows in ``order``, cut into pages: adds row_no, page_no and page_index.

    Whole pages are taken until at least ``cap`` rows are held, so the last page may pass
    the cap. The cap is what makes the page list: a top-k, never a full sort. ``by`` makes
    a page list for every group.
    """
    if not 0 < size <= 25:
        raise ValueError("page size must be from 1 to 25")
    held = math.ceil(cap / size) * size
    if by:
        top = top_per_group(df, by, order, held)
    else:
        # At most ``held`` rows reach this window.
        top = df.orderBy(*order).limit(held).withColumn("row_no", F.row_number().over(Window.orderBy(*order)))
    page = F.floor((F.col("row_no") - 1) / size).cast("int")
    return top.withColumn("page_no", page).withColumn("page_index", F.col("page_no") * size)
