"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

*Signature.* Every element of a set walks through a random permutation of the signature's places
and leaves ``step + random`` there; places keep their least value. Values of later steps are larger,
so the walk of a whole set stops at the step where no place can still improve: for sets much
larger than the signature after one or two steps. One permutation per element correlates the
places, which lowers the variance of the similarity estimate.

*Candidates.* Documents with equal sets are one class; its least id stands for it. Classes that
agree in a band of the signature share a bucket. With the production parameters a pair at the
threshold misses all bands with probability below one in a million.

*Verification.* Buckets with the same least id form a group, in which each class is once. A group's
classes meet in blocks of a bounded size, with their texts. In a block a pair that shares a band is
compared on the full sets unless the group of a band before has it, it is already joined, or its
sizes or signatures rule it out (the signature bound lies six deviations below the threshold).
Groups of more than one block are first compared within blocks; only where a group then still
holds several components are its blocks compared with each other.
A large group of copies thus costs comparisons in proportion to its size, and no pairs are ever
written, only the links that join components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import BoundedCache, id_text, in_batches, kept_by_worker
from .components import components

BLOCK_ROWS = 1024
CACHED_WORDS = 400_000
ELEMENTS_AT_ONCE = 150_000
# Elements of full sets that a block keeps unpacked; those dropped are unpacked again.
ELEMENTS_HELD = 4_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary()),
    ("bands", pa.list_(pa.int64())), ("packed", pa.binary())])
_LINKED = pa.schema([("one", pa.int64()), ("other", pa.int64())])


@dataclass(frozen=True)
class Likeness:
    """What counts as a near duplicate, and the signature that finds it."""

    words: int = 3
    percent: int = 85  # 100 * intersection >= percent * union
    band_rows: int = 5
    bands: int = 24

    @property
    def places(self) -> int:
        return self.band_rows * self.bands

    @property
    def least_equal(self) -> int:
        """Equal places below which a pair at the threshold is six deviations off."""
        share = self.percent / 100
        return math.floor(self.places * share - 6 * math.sqrt(self.places * share * (1 - share)))


# Words in a row and threshold where no contract says otherwise.
FIVE_WORDS = Likeness(words=5, percent=80, band_rows=4, bands=30)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


@kept_by_worker
def _word_hashes() -> BoundedCache:
    return BoundedCache(xxhash.xxh3_64_intdigest, CACHED_WORDS)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles.

    ``bytes.lower`` and ``bytes.split`` are exactly A-Z and the characters [\\x20\\x09-\\x0D].
    """
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, split), np.uint64, len(split))
    size = min(words, len(split))
    count = len(split) - size + 1
    value = np.full(count, np.uint64(size))
    for place in range(size):
        value = mixed(value * _GOLDEN + hashes[place:place + count])
    return np.unique(value)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash of each non-empty set: sets x places, equal where the same element left the least value."""
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    best = np.full(len(sets) * places, np.inf)
    permutation = None
    for step in range(places):
        draw = mixed(elements + np.uint64((step + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        # High bits give the random value, low bits the next place of the permutation.
        value = step + (draw >> np.uint64(20)).astype(float) * 2.0 ** -44
        chosen = step + ((draw & np.uint64(0xFFFFF)) % np.uint64(places - step)).astype(np.int64)
        if permutation is None:
            place = chosen
        else:
            rows = np.arange(len(elements))
            place = permutation[rows, chosen].astype(np.int64)
            permutation[rows, chosen] = permutation[:, step]
            permutation[:, step] = place
        np.minimum.at(best, owner * places + place, value)
        # Later steps leave at least step + 1: sets whose places are all below are finished.
        open_sets = best.reshape(-1, places).max(axis=1) > step + 1
        going_on = open_sets[owner]
        if not going_on.any():
            break
        if permutation is None:
            elements, owner, chosen = elements[going_on], owner[going_on], chosen[going_on]
            permutation = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
            permutation[np.arange(len(elements)), chosen] = 0
            permutation[:, 0] = chosen
        elif not going_on.all():
            elements, owner, permutation = elements[going_on], owner[going_on], permutation[going_on]
    return best.reshape(-1, places)


def band_keys(signature: np.ndarray, likeness: Likeness) -> np.ndarray:
    """sets x bands: equal where all places of the band are."""
    bits = mixed(signature.view(np.uint64)).reshape(-1, likeness.bands, likeness.band_rows)
    keys = np.zeros(bits.shape[:2], np.uint64)
    for row in range(likeness.band_rows):
        keys = mixed(keys * _GOLDEN + bits[:, :, row])
    return keys.view(np.int64)


def _sign(likeness: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)

        def finished(held: list[tuple]) -> Iterator[tuple]:
            full = [row for row in held if len(row[1])]
            signed = signatures([row[1] for row in full], likeness.places) if full else np.empty((0, likeness.places))
            keys = iter(band_keys(signed, likeness).tolist()) if full else iter(())
            short = iter(mixed(signed.view(np.uint64)).astype(np.uint8))
            for doc_id, shingles, text in held:
                if len(shingles):
                    key = xxhash.xxh3_128_digest(shingles.tobytes())
                    yield doc_id, len(shingles), key, next(short).tobytes(), next(keys), compressor.compress(text)
                else:
                    yield doc_id, 0, None, None, None, None

        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for batch in batches:
                for doc_id, text in id_text(batch):
                    raw = text.encode()
                    held.append((doc_id, shingle_set(raw, likeness.words), raw))
                    size += len(held[-1][1])
                    if size >= ELEMENTS_AT_ONCE or len(held) >= 2048:
                        yield from finished(held)
                        held, size = [], 0
            yield from finished(held)

        return in_batches(rows(), _SIGNED, 5)

    return run


def _rows_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Consecutive rows of the same group and block."""
    held, current = [], None
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            for row in zip(*(column.to_pylist() for column in batch.slice(start, 512).columns)):
                if row[:3] != current:
                    if len(held) > 1:
                        yield held
                    held, current = [], row[:3]
                held.append(row)
    if len(held) > 1:
        yield held


def _verify(likeness: Likeness):
    """Links that join components, from rows (first, lower, upper, side, id, component, in_bands, n, signature, bands, packed)."""
    def linked(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        _, lower, upper = rows[0][:3]
        number = np.array([row[7] for row in rows], np.int64)
        signature = np.array([np.frombuffer(row[8], np.uint8) for row in rows])
        keys = np.array([row[9] for row in rows], np.int64)
        side = np.array([row[3] for row in rows])
        own = np.zeros(keys.shape, bool)
        for place, row in enumerate(rows):
            own[place, row[6]] = True
        component = np.unique([row[5] for row in rows], return_inverse=True)[1]
        unpack = zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}
        held = 0

        def full(place: int) -> np.ndarray:
            nonlocal held
            if place not in sets:
                if held > ELEMENTS_HELD:
                    sets.clear()
                    held = 0
                sets[place] = shingle_set(unpack.decompress(rows[place][10]), likeness.words)
                held += len(sets[place])
            return sets[place]

        # The row that agrees most with the others first: it joins most of a group of copies.
        order = np.argsort(-_typical(signature), kind="stable")
        for turn, one in enumerate(order[:-1].tolist()):
            others = order[turn + 1:]
            others = others[component[others] != component[one]]
            if lower != upper:
                others = others[side[others] != side[one]]
            small, large = np.minimum(number[one], number[others]), np.maximum(number[one], number[others])
            others = others[100 * small >= likeness.percent * large]
            # A pair is compared in the group of the first band that it shares.
            shared = keys[others] == keys[one]
            others = others[shared.any(axis=1) & own[one, shared.argmax(axis=1)]]
            others = others[(signature[others] == signature[one]).sum(axis=1) >= likeness.least_equal]
            for other in others.tolist():
                if component[other] == component[one]:
                    continue
                common = in_common(full(one), full(other))
                if 100 * common >= likeness.percent * (number[one] + number[other] - common):
                    component[component == component[other]] = component[one]
                    yield rows[one][4], rows[other][4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((link for rows in _rows_by_block(batches) for link in linked(rows)), _LINKED)

    return run


def in_common(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    return int((large[place] == small).sum())


def _typical(signature: np.ndarray) -> np.ndarray:
    """How often each row holds the commonest value of a place."""
    total = np.zeros(len(signature))
    for place in range(signature.shape[1]):
        values, inverse, counts = np.unique(signature[:, place], return_inverse=True, return_counts=True)
        total += counts[inverse]
    return total


_BLOCK = ["first", "lower", "upper"]
_PAYLOAD = ["n_shingles", "signature", "bands", "packed"]


def _links(members: DataFrame, payload: DataFrame, likeness: Likeness) -> DataFrame:
    """``members``: first, lower, upper, side, id, component, in_bands."""
    rows = members.join(payload, "id").select(*_BLOCK, "side", "id", "component", "in_bands", *_PAYLOAD)
    return (
        rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "id")
        .mapInArrow(_verify(likeness), "one long, other long"))


def near_duplicates(
    df: DataFrame, likeness: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    A text's words are lower-cased in A-Z and split at ``[\\x20\\x09-\\x0D]``; its set holds the distinct
    runs of ``likeness.words`` words, or the whole sequence if it is shorter. Null and empty texts have
    no set and are linked with nothing. ``component_id`` is the least id reachable over links, the
    own one included; ``kept`` where it is the row's id. Rows that repeat an id are one document with
    each other's links. A null id takes no part: its component is null and it is kept. An empty
    table gives no rows; other columns are not read.
    """
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    signed = cut_lineage(rows.mapInArrow(
        _sign(likeness),
        "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>, packed binary"))
    # One row per class: its least id, whose bands they are. Joins below are of written tables, so
    # Spark can split a hot key's partition at run time.
    classes = cut_lineage(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key").agg(F.min(F.struct("doc_id", "bands")).alias("one"))
        .select("set_key", F.col("one.doc_id").alias("id"), F.col("one.bands").alias("bands")))
    memberships = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = cut_lineage(
        memberships.groupBy("band", "key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last").select("band", "key", "first"))
    # Buckets with the same least id hold much the same classes, so they are one group, and a
    # class is in it once, with the bands that brought it there.
    grouped = cut_lineage(
        memberships.join(buckets.hint("merge"), ["band", "key"])
        .groupBy("first", "id").agg(F.sort_array(F.collect_set("band")).alias("in_bands")))
    sizes = grouped.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    members = cut_lineage(
        grouped.join(cut_lineage(sizes), "first").withColumn("lower", F.pmod(F.xxhash64("id", "first"), F.col("blocks")).cast("int")))
    # The row that stands for a needed class; rows that repeat it are dropped.
    needed = cut_lineage(classes.select("id", "set_key").join(members.select("id"), "id", "left_semi"))
    payload = cut_lineage(
        signed.select(F.col("doc_id").alias("id"), "set_key", *_PAYLOAD).join(needed.hint("merge"), ["id", "set_key"], "left_semi")
        .dropDuplicates(["id", "set_key"]).drop("set_key"))
    links = cut_lineage(_links(
        members.select("first", "lower", F.col("lower").alias("upper"), F.lit(0).alias("side"), "id",
                       F.col("id").alias("component"), "in_bands"),
        payload, likeness))
    labels = components(links)

    large = members.where("blocks > 1")
    if not large.isEmpty():
        labelled = cut_lineage(
            large.join(labels.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("component", F.coalesce("component", "id")))
        open_groups = (
            labelled.groupBy("first").agg(F.min("component").alias("least"), F.max("component").alias("most"))
            .where("least < most").select("first"))
        # Each row meets the rows of every other block of its group.
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        across = (
            labelled.join(cut_lineage(open_groups), "first", "left_semi")
            .withColumnRenamed("lower", "own").withColumn("other", other).where("own <> other")
            .select("first", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"),
                    F.col("own").alias("side"), "id", "component", "in_bands"))
        more = cut_lineage(_links(across, payload, likeness))
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    by_set = cut_lineage(
        classes.select("id", "set_key").join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("set_key", F.coalesce("component", "id").alias("component")))
    placed = signed.select("doc_id", "n_shingles", "set_key").join(by_set.hint("merge"), "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
