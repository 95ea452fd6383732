"""Helpers shared by the operators: narrow inputs, bounded Arrow batches, per-worker caches."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows of one result batch, and bytes of its long values, that a Python task holds at once.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null as empty) of a table of documents."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def id_remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def in_batches(rows: Iterable[tuple], schema: pa.Schema, long_value: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches bounded in rows and in bytes of the column ``long_value``."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        if long_value is not None and row[long_value] is not None:
            size += len(row[long_value])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema)


def id_text(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    """(id, text) of a batch, texts decoded a few at a time."""
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


# What a Python worker keeps for the operator that it serves: function -> (arguments, result).
_kept: dict[Callable, tuple] = {}


def kept_by_worker(make: Callable) -> Callable:
    """``make`` with its last result kept in the worker, so that what one task has learned serves the next.

    Workers outlive operators: as soon as another operator keeps something, what was kept before is let go.
    """
    @functools.wraps(make)
    def kept(*arguments):
        found = _kept.get(make)
        if found is None or found[0] != arguments:
            _kept.clear()
            pa.default_memory_pool().release_unused()
            found = _kept[make] = (arguments, make(*arguments))
        return found[1]

    return kept


class BoundedCache(dict):
    """A dict that fills itself by ``make`` and starts anew beyond ``limit`` entries: only speed depends on it."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
