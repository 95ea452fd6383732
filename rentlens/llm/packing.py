"""Best-fit packing planned on a histogram of lengths.

Documents are encoded once and cut into pieces of at most ``limit`` tokens. Only the number of
pieces of each length (``limit`` numbers, whatever the table) reaches the driver, which packs
counts, not documents: best-fit decreasing opens and fills whole groups of equal sequences at
once. The plan is a list of slots per length; pieces take them by their rank within the length.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .chunks import ChunkEncoder, byte_alphabet, little_endian
from .common import id_text, in_batches, kept_by_worker, texts

LIMIT = 1024
END_ID = 2
# Pieces whose ranks one task counts.
ROWS_PER_PART = 100_000
CACHED_CHUNKS = 600_000
# Fixed value: the split pattern of the byte-level vocabulary.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class ByteLevelEncoder:
    """Ids of a byte-level vocabulary file, equal to what its library gives without added tokens.

    The merges are those of the rank engine, whose ranks are the ids; special strings inside a
    text become their ids, as the file has it.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items()}
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.engine = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.chunks = ChunkEncoder(self._bytes, CACHED_CHUNKS)

    def _bytes(self, text: str) -> bytes:
        return little_endian(self.engine.encode_ordinary(text))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.splitter is None or not self.splitter.search(text):
            return self.chunks.encode(text)
        return b"".join(
            little_endian([self.special[part]]) if part in self.special else self.chunks.encode(part)
            for part in self.splitter.split(text) if part)


@kept_by_worker
def encoder_of(raw: bytes) -> ByteLevelEncoder:
    return ByteLevelEncoder(raw)


def cut(n_tokens: int, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: the first takes the remainder, the rest are full."""
    first = n_tokens % limit or min(n_tokens, limit)
    start, length = 0, first
    while start < n_tokens:
        yield start, length
        start, length = start + length, limit


def encode_pieces(df: DataFrame, vocabulary: Broadcast, limit: int, end_id: int) -> DataFrame:
    end = little_endian([end_id])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in id_text(batch):
                    ids = encoder.encode(text) + end
                    for n, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                        yield doc_id, n, start, length, zlib.crc32(ids[4 * start: 4 * (start + length)])

        return in_batches(rows(), _PIECES)

    return df.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Best-fit decreasing over counts: per length the first rank, first sequence and offset of each run of slots.

    Longest pieces first. Each length goes to the open sequences with the least room that still
    holds it; sequences filled alike form one run, so the work depends on the lengths in use.
    """
    rooms: list[int] = []  # ascending rooms of open sequences
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences: (first, number)
    slots = []
    sequences = 0

    def give_back(room: int, run: tuple[int, int]) -> None:
        if room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        ranks, firsts, offsets = [], [], []
        while left:
            place = bisect.bisect_left(rooms, length)
            if place < len(rooms):
                room = rooms[place]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[place]
                taken = min(number, left)
                if taken < number:
                    give_back(room, (first + taken, number - taken))
            else:
                # New sequences: each takes as many pieces of this length as it can.
                room, first = limit, sequences
                taken = max(1, left // (limit // length))
                sequences += taken
            for _ in range(room // length if left >= taken * (room // length) else 1):
                ranks.append(rank)
                firsts.append(first)
                offsets.append(limit - room)
                rank, left, room = rank + taken, left - taken, room - length
            give_back(room, (first, taken))
        slots.append((length, ranks, firsts, offsets))
    return slots


def take_slots(pieces: DataFrame, limit: int, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``sequence_id`` and ``offset`` for pieces with ``length``; ``pieces`` is read three times."""
    spark = pieces.sparkSession
    counted = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        plan(counted, limit), "length long, ranks array<long>, firsts array<long>, offsets array<long>")
    parts = max(1, -(-sum(counted.values()) // rows_per_part))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    parted = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    per_part = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part", "length").orderBy(*order)
    ranked = (
        parted.withColumn("rank", F.row_number().over(within).cast("long") - 1)
        .join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")))
    # The plan has a row per length, at most ``limit``, so it is broadcast.
    run = F.size(F.filter("ranks", lambda first: first <= F.col("rank"))) - 1
    placed = ranked.join(F.broadcast(slots), "length").withColumn("run", run)
    return placed.select(
        *pieces.columns,
        (F.get("firsts", F.col("run")) + F.col("rank") - F.get("ranks", F.col("run"))).alias("sequence_id"),
        F.get("offsets", F.col("run")).alias("offset"))


def pack(
    df: DataFrame, vocabulary_path: str, limit: int = LIMIT, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone. A document within the limit is never cut; a longer
    one gives full pieces after a first that may be shorter. Repeated rows are packed each; null
    ids stay null. An empty table gives no rows. Other columns are not read.
    """
    with open(vocabulary_path, "rb") as file:
        vocabulary = df.sparkSession.sparkContext.broadcast(file.read())
    pieces = cut_lineage(encode_pieces(texts(df, id_col, text_col), vocabulary, limit, end_id))
    return take_slots(pieces, limit)
