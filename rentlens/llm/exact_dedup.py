"""Exact duplicates by skew-safe combining.

Three stages, each comparing whole contents, none meeting more than a bounded part of a group:

1. *Local*: each Arrow batch of a task keeps one row per content with the ids of its members
   (at most a batch of ids).
2. *Salted*: local rows of one digest are dealt over ``salts`` partitions; each salt names a winner.
3. *Global*: the winners of the salts, at most ``salts`` per content, name the row that stays.

Contents travel compressed. The encoding is lossless and deterministic, so contents are equal
exactly when their encodings are; the digest only deals rows out, it never decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import id_text, in_batches, texts

SALTS = 16
# Fixed value: the characters that normalisation deletes, [\x20\x09-\x0D].
DELETED = b" \t\n\x0b\x0c\r"

_LOCAL = pa.schema([
    ("uid", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("members", pa.list_(pa.int64())),
    ("n_chars", pa.int64()), ("best_id", pa.int64()),
])


def _local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per content of a batch; the first member is the row that would stay."""
    first_uid = TaskContext.get().partitionId() << 33
    compressor = zstandard.ZstdCompressor(level=1)

    def rows() -> Iterator[tuple]:
        uid = first_uid
        for batch in batches:
            groups: dict[bytes, list[tuple]] = {}
            for doc_id, text in id_text(batch):
                raw = text.encode()
                content = raw.translate(None, DELETED)
                row = (-len(text), doc_id is None, doc_id or 0)
                groups.setdefault(hashlib.sha256(content).digest() + compressor.compress(content), []).append(row)
            for key, members in groups.items():
                members.sort()
                ids = [None if null else doc_id for _, null, doc_id in members]
                yield uid, key[:32], key[32:], ids, -members[0][0], ids[0]
                uid += 1

    yield from in_batches(rows(), _LOCAL, 2)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; a null text
    is empty, and all empty ones are a group. Of a group the row with most code points stays, then
    the smallest id, a null id last. Of repeated rows (same id and text) exactly one stays. An
    empty table gives an empty result; other columns are not read.
    """
    local = texts(df, id_col, text_col).mapInArrow(
        _local_groups, "uid long, digest binary, content binary, members array<long>, n_chars long, best_id long")
    best = [F.desc("n_chars"), F.asc_nulls_last("best_id"), F.asc("uid")]
    local = local.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    salted = Window.partitionBy("digest", "salt", "content")
    merged = cut_lineage(
        local.repartition("digest", "salt")
        .withColumn("winner", F.first("uid").over(salted.orderBy(*best)))
        .withColumn("n_rows", F.when(F.col("winner") == F.col("uid"), F.sum(F.size("members")).over(salted)))
        .withColumn("content", F.when(F.col("winner") == F.col("uid"), F.col("content")))
        .drop("salt"))
    everywhere = Window.partitionBy("digest", "content")
    first = everywhere.orderBy(*best)
    kept = (
        merged.where("winner = uid").repartition("digest")
        .select(
            "winner", F.first("uid").over(first).alias("keep_uid"), F.first("best_id").over(first).alias("keep_id"),
            F.sum("n_rows").over(everywhere).alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    )
    return (
        merged.select("uid", "members", "winner").join(kept, "winner")
        .select("uid", "keep_uid", "keep_id", "group_size", "text_sha256", F.posexplode("members").alias("place", "doc_id"))
        .select(
            "doc_id", "keep_id", "group_size",
            ((F.col("uid") == F.col("keep_uid")) & (F.col("place") == 0)).alias("kept"), "text_sha256")
    )
