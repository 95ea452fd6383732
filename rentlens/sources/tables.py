"""Writers: listings, regions, seen-history, versioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.snapshots import unseen
from ..schemas import LISTING

# Bytes of a file that holds one JSON array: below the size from which readers cut files.
ARRAY_BYTES = 16 << 20


def write_listings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace ``path`` by the listings, camelCase fields only; ``read_listings`` takes the same ``fmt``.

    ``json`` writes an array per file, of a size that is read back in one pass, ``lines`` an object per line, which
    splits when read back; both include nulls.
    """
    columns = [field for field in StructType.fromDDL(LISTING).fieldNames() if field in df.columns]
    rows = df.select(*columns)
    if fmt == "json":
        record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        arrays = rows.select(record.alias("value")).mapInArrow(_as_arrays, "value string")
        arrays.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    elif fmt == "lines":
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON texts as arrays of about ``ARRAY_BYTES``, a row each; no rows, no array."""
    def array(parts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": ["[" + ",\n".join(parts) + "]"]})

    held: list[str] = []
    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            texts = batch.column(0).slice(start, 256)
            held.append(",\n".join(texts.to_pylist()))
            size += len(held[-1])
            if size >= ARRAY_BYTES:
                yield array(held)
                held, size = [], 0
    if held:
        yield array(held)


def write_snapshots(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add listings to a series of snapshots: one folder per ``snapshot_ts``.

    A time that is there already is replaced, so a failed run can be repeated.
    """
    columns = [field for field in StructType.fromDDL(LISTING).fieldNames() if field in df.columns]
    (
        df.select(*columns, "snapshot_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_ts").format(fmt).save(path)
    )


def write_regions(df: DataFrame, path: str) -> None:
    """Replace ``path`` by JSON lines of region, part, ring_no and ring ([[x, y], ...])."""
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    extra = [c for c in ("part", "ring_no") if c in df.columns]
    df.select("region", *extra, ring.alias("ring")).write.mode("overwrite").json(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # anything but: nothing written yet
            raise
        return None


def write_keyed_table(df: DataFrame, name: str, buckets: int, key: str = "id", path: str | None = None) -> None:
    """Replace the catalog table ``name``, bucketed and sorted by ``key``.

    Tables bucketed alike are joined on the key without a shuffle: listings against the
    seen-history (``exclude_seen``), ids against listings (``by_ids``), journeys per
    origin. Choose the buckets so that one holds a few hundred megabytes.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def append_unseen(df: DataFrame, history_path: str, reset: bool = False, order=()) -> None:
    """Add the rows whose ids the history lacks, each id once; ``reset`` starts it anew.

    Readers may see some files of a write that is under way, where the commit renames them one by one;
    a failed write can be repeated, as each id is added once. Writers of one history must take turns.
    """
    history = None if reset else stored(df.sparkSession, history_path)
    unseen(df, history, order).write.mode("overwrite" if reset else "append").parquet(history_path)


def current_table(spark: SparkSession, base: str) -> DataFrame | None:
    """The version last published below ``base``; None before the first."""
    versions = stored(spark, f"{base}/versions")
    if versions is None:
        return None
    newest = versions.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{base}/v{newest}")


def publish_table(df: DataFrame, base: str) -> int:
    """Write ``df`` as a new version below ``base``, then make it the current one.

    ``df`` may read the current version: data files are never overwritten. Readers see the
    old version until the small ``versions`` table has its new row, so a failed write
    changes nothing. Writers of one table must take turns.
    """
    spark = df.sparkSession
    versions = stored(spark, f"{base}/versions")
    version = 1 if versions is None else versions.agg(F.max("version")).first()[0] + 1
    # A version left half-written by a failed attempt is replaced.
    df.write.mode("overwrite").parquet(f"{base}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{base}/versions")
    return version
