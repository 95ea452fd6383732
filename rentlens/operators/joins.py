"""Joins that stay balanced when one key holds a large share of the rows.

A table is broadcast only after its rows have been counted against a bound. Above the
bound the join shuffles, and the keys that are hot in the fact table are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..session import cut_lineage

# A broadcast table holds at most this many rows (or, with ``weight``, this much weight), and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A salted key gets one salt for this many rows of the fact table.
ROWS_PER_SALT = 1_000_000
# A sieve has this many bits for each key, in bitmaps of so many bits (Spark's), and at most so many bitmaps.
SIEVE_BITS = 16
BITMAP_BITS = 32_768
BITMAPS = 4_096


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: texts and nested values by their length."""
    total = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            column = F.to_json(F.struct(column))
        elif not isinstance(field.dataType, (StringType, BinaryType)):
            continue
        total = total + F.coalesce(F.octet_length(column), F.lit(0))
    return total


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, weight: Column | None = None, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Is the table within both bounds? One pass over it; only sums leave the tasks."""
    units, size = df.agg(F.sum(F.lit(1) if weight is None else weight), F.sum(row_bytes(df))).first()
    return (units or 0) <= max_rows and (size or 0) <= max_bytes


def spread_join(
    facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner",
    rows_per_salt: int | None = None, spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Shuffle join on ``on`` with the hot keys of ``facts`` salted.

    The hot keys are counted first (partial counts, one row per key and task, are all that
    is shuffled) and written. Without any, the join is left to Spark, which may still split it
    at run time. Rows of a hot key get a salt from a hash of the row, which is the same on
    every attempt of a task, and the matching ``dim`` rows are repeated once per salt.
    ``how`` may be inner, left, left_semi or left_anti: ``facts`` is the kept side.

    ``spread_by`` names the hashed columns, which must tell the rows of a key apart. By default
    they are all columns, so rows that share an id spread too.
    """
    on = list(on)
    rows_per_salt = rows_per_salt or ROWS_PER_SALT
    # At most one key for ``rows_per_salt`` rows.
    hot = cut_lineage(
        facts.groupBy(*on).count()
        .where(F.col("count") > rows_per_salt)
        .select(*on, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts"))
    )
    if hot.isEmpty():
        return facts.join(dim, on, how)
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in spread_by or facts.columns])
    left = (
        facts.join(hot, on, "left")
        .withColumn("_salt", F.coalesce(F.pmod(row_hash, F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_salts")
    )
    right = (
        dim.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "inner",
    max_rows: int = BROADCAST_ROWS, weight: Column | None = None, small: bool | None = None,
) -> DataFrame:
    """Join a table whose size is not known: broadcast if it is small, else :func:`spread_join`.

    ``small`` is for callers who have counted the table already.
    """
    on = [on] if isinstance(on, str) else list(on)
    if facts.isStreaming:
        return facts.join(dim, on, how)
    if fits_broadcast(dim, max_rows, weight) if small is None else small:
        return facts.join(F.broadcast(dim), on, how)
    return spread_join(facts, dim, on, how)


def possible(facts: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """``facts`` with a boolean column ``flag``: false only if the row's key is not among ``keys``.

    A bitmap of the hashed keys is broadcast, two bytes a key and 16 MB at most, so no row of ``facts`` is shuffled.
    One in sixteen other rows is flagged too, more of them if there are more keys than that bitmap is for.
    """
    bitmaps = min(BITMAPS, max(1, -(-keys.count() * SIEVE_BITS // BITMAP_BITS)))

    def at(name: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(bitmaps * BITMAP_BITS)).alias(name)

    bits = (
        # Equal numbers of different types have different hashes.
        keys.select(*[F.col(f"`{c}`").cast(facts.schema[c].dataType).alias(c) for c in on]).select(at("_at")).select(F.expr(f"_at div {BITMAP_BITS}").alias("_bitmap"), (F.col("_at") % BITMAP_BITS).alias("_bit"))
        # Dealt by bitmap before any is made, else every task would write all of them.
        .repartition("_bitmap").groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    placed = facts.withColumn("_at", at("_at")).withColumn("_bitmap", F.expr(f"_at div {BITMAP_BITS}"))
    bit = F.col("_at") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("_bits", F.expr(f"cast(_at % {BITMAP_BITS} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (bit % 8).cast("int")) == 1
    return (
        placed.join(F.broadcast(cut_lineage(bits)), "_bitmap", "left")
        .withColumn(flag, F.coalesce(found, F.lit(False))).drop("_at", "_bitmap", "_bits"))


def sieved_join(facts: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """:func:`lookup_join` (inner or left_semi) where few or wide rows of ``facts`` match: if it has to shuffle, others stay out of that."""
    on = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dim):
        return facts.join(F.broadcast(dim), on, how)
    return spread_join(possible(facts, dim, on, "_possible").where("_possible").drop("_possible"), dim, on, how)


def beside_all(facts: DataFrame, dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each row of ``facts`` beside each row of ``dim``: a broadcast cross join, for short user-made lists.

    All pairs are what is asked for, so nothing cheaper exists; a list beyond the broadcast bounds
    is refused.
    """
    if not fits_broadcast(dim, max_rows):
        raise ValueError("the list to pair every row with is too long to broadcast")
    return facts.crossJoin(F.broadcast(dim))
