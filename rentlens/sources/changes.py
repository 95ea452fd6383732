"""Keyed tables as a base plus changes: an update writes only the rows that it adds or alters.

Rows lie below ``rows/version=N/_range=R``, where R is a hash of the key, modulo a number of ranges fixed with the
base. The ``log`` has a row per published version: a base, a set of changes, or a fold (some ranges written anew, with
all changes up to then). A read takes of every range its newest base or fold and the changes since. A version's
rows are written before its row in the log, so a failed write changes nothing and is replaced by the next
attempt. Writers of one table must take turns; folders below a range's newest fold are no longer read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import fits_broadcast
from ..operators.snapshots import altered_rows, latest_per_key
from ..session import cut_lineage
from .tables import stored

# Choose the ranges so that one holds a few hundred megabytes.
RANGES = 64
_LOG = "version BIGINT, kind STRING, ranges ARRAY<INT>, key ARRAY<STRING>, n_ranges INT"
_RANGE = "_range"


def _log(spark: SparkSession, base: str) -> list:
    """The published versions in order: a few rows per update."""
    log = stored(spark, f"{base}/log")
    return [] if log is None else sorted(log.collect(), key=lambda row: row.version)


def _publish(df: DataFrame, base: str, kind: str, ranges: list[int], key: list[str], n_ranges: int, version: int) -> int:
    # One file per range and task at most; a range's rows meet in few tasks, in more where they are many.
    df.hint("rebalance", F.col(_RANGE)).write.mode("overwrite").partitionBy(_RANGE).parquet(f"{base}/rows/version={version}")
    row = df.sparkSession.createDataFrame([(version, kind, ranges, key, n_ranges)], _LOG)
    row.write.mode("append").parquet(f"{base}/log")
    return version


def _with_range(df: DataFrame, key: Sequence[str], n_ranges: int) -> DataFrame:
    return df.withColumn(_RANGE, F.pmod(F.xxhash64(*key), F.lit(n_ranges)).cast("int"))


def publish_base(df: DataFrame, base: str, key: Sequence[str], n_ranges: int = RANGES) -> int:
    """Start a table, or replace it as a whole. Keys are unique in ``df``."""
    log = _log(df.sparkSession, base)
    version = log[-1].version + 1 if log else 1
    return _publish(_with_range(df, key, n_ranges), base, "base", list(range(n_ranges)), list(key), n_ranges, version)


class _State:
    """Of each range the version that it starts from, and the changes since the oldest of these."""

    def __init__(self, log: list):
        if not log:
            raise ValueError("nothing published yet")
        self.key, self.n_ranges, self.newest = log[-1].key, log[-1].n_ranges, log[-1].version
        starts: dict[int, int] = {}
        for row in log:
            if row.kind == "base":
                starts = {}
            if row.kind != "change":
                starts.update({n: row.version for n in row.ranges})
        self.by_start: dict[int, list[int]] = {}
        for n, version in starts.items():
            self.by_start.setdefault(version, []).append(n)
        self.changes = [row.version for row in log if row.kind == "change" and row.version > min(starts.values())]

    def part(self, spark: SparkSession, base: str, changed: bool) -> DataFrame | None:
        """Rows of the starts, or of the changes since; a filter on folders picks them."""
        wanted = [
            (v, ranges) for start, ranges in self.by_start.items()
            for v in ([c for c in self.changes if c > start] if changed else [start])]
        if not wanted:
            return None
        paths = sorted({f"{base}/rows/version={v}" for v, _ in wanted})
        # A change may have no rows, and then no columns: the schema is that of a start.
        schema = spark.read.parquet(f"{base}/rows/version={max(self.by_start)}").drop(_RANGE).schema
        rows = spark.read.schema(schema.add("version", "long").add(_RANGE, "integer")).option("basePath", f"{base}/rows").parquet(*paths)
        picked = F.lit(False)
        for version, ranges in wanted:
            picked = picked | ((F.col("version") == version) & (F.lit(len(ranges) == self.n_ranges) | F.col(_RANGE).isin(ranges)))
        return rows.where(picked)


def _by_keys(rows: DataFrame, keys: DataFrame, key: list[str], how: str) -> DataFrame:
    """Rows of the table that have one of the keys, or have none of them. A key has one row, so none is hot."""
    return rows.join(F.broadcast(keys) if fits_broadcast(keys) else keys, key, how)


def _current(spark: SparkSession, base: str, state: _State) -> DataFrame:
    """Current rows with their version and range: those of the starts that no change replaces, and each key's last change."""
    starts, changes = state.part(spark, base, False), state.part(spark, base, True)
    if changes is None:
        return starts
    kept = _by_keys(starts, changes.select(*state.key).distinct(), state.key, "left_anti")
    return kept.unionByName(latest_per_key(changes, state.key, "version"))


def current_rows(spark: SparkSession, base: str) -> DataFrame:
    """The rows of the table as last published, each with the ``version`` that wrote it."""
    return _current(spark, base, _State(_log(spark, base))).drop(_RANGE)


def publish_changes(updates: DataFrame, base: str, order: Sequence[Column | str] = ()) -> int:
    """Merge an update: only rows that are new or altered are written.

    Of updates with equal keys the last in ``order`` counts; without an order they fail. Where the update's keys can be
    broadcast, the table's rows meet them before they are shuffled. The update is computed once.
    """
    spark = updates.sparkSession
    updates = cut_lineage(updates)
    state = _State(_log(spark, base))
    current = _current(spark, base, state)
    values = [c for c in current.columns if c not in (*state.key, "version", _RANGE)]
    keys = updates.select(*state.key).distinct()
    if fits_broadcast(keys):
        current = current.join(F.broadcast(keys), state.key, "left_semi")
    changed = altered_rows(current, updates, state.key, values, order)
    return _publish(_with_range(changed, state.key, state.n_ranges), base, "change", [], state.key, state.n_ranges, state.newest + 1)


def fold_changes(spark: SparkSession, base: str, share: float = 0.2) -> list[int]:
    """Write those ranges anew whose changes come to at least ``share`` of the rows they start from; their numbers."""
    state = _State(_log(spark, base))
    starts, changes = state.part(spark, base, False), state.part(spark, base, True)
    if changes is None:
        return []
    # A row per range.
    sizes = starts.groupBy(_RANGE).agg(F.count("*").alias("held")).join(
        changes.groupBy(_RANGE).agg(F.count("*").alias("changed")), _RANGE, "right")
    due = sorted(row[0] for row in sizes.where(F.col("changed") >= share * F.coalesce("held", F.lit(0))).select(_RANGE).collect())
    if due:
        rows = _current(spark, base, state).where(F.col(_RANGE).isin(due)).drop("version")
        _publish(rows, base, "fold", due, state.key, state.n_ranges, state.newest + 1)
    return due
