"""Probabilities of texts under context-tree weighting, and under word counts.

A text is its UTF-8 bytes and an end mark; before the first byte stand ``DEPTH`` end marks. Each byte is eight binary decisions.
For each decision (a node of the byte's binary tree) there is a tree of contexts: the last 0 to ``DEPTH`` bytes, the
latest first. A context s that saw a zeros and b ones has the Krichevsky-Trofimov probability
Pe(s) = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1)), and the weighted one Pw(s) = Pe(s) / 2 + (product of Pw over longer
contexts) / 2, or Pe(s) at full depth. The next bit then has the mixed probability B KT(s) + (1 - B) P(longer context),
with B = Pe(s) / 2 / Pw(s), the weight that training leaves to stopping at s, and KT(s) = (count + 1/2) / (a + b + 1).
A context that training never saw says nothing: the longest one seen stands for it (one half where none was).

Training counts every string of DEPTH + 1 bytes, and every word, of all training texts: partly in tasks, then in
a shuffle. Trees are weighted in groups by the last ``SPLIT`` bytes, which hold at most 256 ** (DEPTH + 1 - SPLIT) strings; only the part
above (at most 256 ** (SPLIT - 1) contexts) meets on the driver. Scoring looks each string of a text up: in a broadcast table of
all strings, if their number is within ``BROADCAST_STRINGS``; else blocks of texts fetch their distinct strings by a join,
with equal results. Words of the highest counts (``HOT_WORDS``, a bound that keeps the broadcast small) are looked up in tasks, all
others by a shuffled join, so no key of that join is hot.

Null texts count as empty: an end mark alone, and no word. Repeated rows train and are scored each. A null id
is a row of its own. Without training rows all counts are 0 and each bit has one half. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import in_batches

DEPTH = 4
SPLIT = 2
BROADCAST_STRINGS = 4 << 20
HOT_WORDS = 1 << 17
BLOCK_BYTES = 8 << 20
# Bytes of text, distinct strings and distinct words that a task works on at a time.
CHUNK_BYTES = 4 << 20
HELD_STRINGS = 1 << 20
HELD_WORDS = 200_000
END = 0xFF  # no byte of UTF-8

_COUNTS = pa.schema([("word", pa.binary()), ("string", pa.int64()), ("n", pa.int64())])
_COUNTS_DDL = "word binary, string long, n long"
_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
    ("hot_known", pa.int64()), ("hot_log", pa.float64()), ("others", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
    ("score", pa.float64())])
_SCORED_DDL = ("doc_id long, held_out boolean, n_bytes long, n_tokens long, hot_known long, hot_log double, "
               "others array<binary>, times array<long>, score double")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, and the end as the empty one."""
    words = text.lower().split()
    words.append(b"")
    return words


def strings_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte and the end of the texts: context (latest byte first) and byte, as one number; first places of the texts."""
    pad = bytes([END]) * depth
    joined = np.frombuffer(b"".join(pad + text + bytes([END]) for text in texts), np.uint8)
    lengths = np.array([len(text) + 1 for text in texts], dtype=np.int64)
    size = len(joined) - depth
    strings = np.zeros(size, np.int64)
    for back in range(1, depth + 1):
        strings = (strings << 8) | joined[depth - back:depth - back + size]
    strings = (strings << 8) | joined[depth:]
    starts = np.cumsum(lengths) - lengths
    # Windows that end in the marks before a later text are no places.
    inside = np.ones(size, bool)
    for k in range(1, len(texts)):
        at = int(starts[k]) + (k - 1) * depth
        inside[at:at + depth] = False
    return strings[inside], starts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by recurrence and Stirling's series."""
    product = np.ones_like(x)
    z = x.copy()
    for _ in range(16):
        small = z < 16
        product[small] *= z[small]
        z[small] += 1
    inverse = 1 / z
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return np.where(a + b == 0, 0.0, log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi))


class Level:
    """The nodes (context, place in the byte's tree) of one depth of contexts."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.log_pe = log_kt(zeros, ones)
        if longer is None:
            self.log_pw, self.stop = self.log_pe, np.ones(len(keys))
        else:
            half = math.log(0.5)
            self.log_pw = np.logaddexp(half + self.log_pe, half + longer)
            self.stop = np.exp(half + self.log_pe - self.log_pw)

    def shorter(self) -> Level:
        """The level one byte up."""
        keys, place = np.unique(without_oldest(self.keys), return_inverse=True)
        return Level(keys, _sums(place, self.zeros, len(keys)), _sums(place, self.ones, len(keys)),
                     np.bincount(place, self.log_pw, len(keys)))

    def mixed(self, above: Mixed) -> Mixed:
        """The mixture down to this level, given that of the level above, row by row the parents."""
        seen = self.zeros + self.ones > 0
        one = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        here = above.rest * self.stop
        return Mixed(np.where(seen, above.done + here * one, above.done), np.where(seen, above.rest * (1 - self.stop), above.rest),
                     np.where(seen, above.done + above.rest * one, above.ends))


class Mixed:
    """Of nodes: the probability of a one settled so far, the weight left, and the probability if contexts end here."""

    def __init__(self, done: np.ndarray, rest: np.ndarray, ends: np.ndarray):
        self.done, self.rest, self.ends = done, rest, ends

    def __getitem__(self, places: np.ndarray) -> Mixed:
        return Mixed(self.done[places], self.rest[places], self.ends[places])

    @classmethod
    def nothing(cls, size: int) -> Mixed:
        return cls(np.zeros(size), np.ones(size), np.full(size, 0.5))


def _sums(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, place, values)
    return out


def without_oldest(keys: np.ndarray) -> np.ndarray:
    """Node keys (context, then a byte for the place) with the context one byte shorter."""
    return ((keys >> 16) << 8) | (keys & 255)


def node_keys(strings: np.ndarray, bit: int) -> np.ndarray:
    """Nodes of one of the eight decisions: the place is a one followed by the bits before it."""
    return (strings & ~np.int64(255)) | (1 << bit) | ((strings & 255) >> (8 - bit))


def levels_of(strings: np.ndarray, counts: np.ndarray, depth: int, last: int) -> list[Level]:
    """Levels from ``depth`` up to ``last`` of distinct strings with their counts."""
    nodes = np.concatenate([node_keys(strings, bit) for bit in range(8)])
    ones = np.concatenate([(strings >> (7 - bit)) & 1 for bit in range(8)])
    keys, place = np.unique(nodes, return_inverse=True)
    times = np.tile(counts, 8)
    levels = [Level(keys, _sums(place, times * (1 - ones), len(keys)), _sums(place, times * ones, len(keys)), None)]
    for _ in range(depth - last):
        levels.append(levels[-1].shorter())
    return levels


def log10_of(strings: np.ndarray, bottom: Level, mixed: Mixed) -> np.ndarray:
    """Log10 of each string's last byte after its context."""
    total = np.zeros(len(strings))
    for bit in range(8):
        one = mixed.ends[np.searchsorted(bottom.keys, node_keys(strings, bit))]
        total += np.log10(np.where((strings >> (7 - bit)) & 1, one, 1 - one))
    return total


def _counted(docs: DataFrame, depth: int) -> DataFrame:
    """Words and strings with how often training texts have them: one row per task or more, held-out ones with 0."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, _sums(place, np.concatenate([n for _, n in held]), len(keys))

        def string_rows():
            for k, n in held:
                for at in range(0, len(k), 65_536):
                    part = k[at:at + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[at:at + 65_536])], schema=_COUNTS)

        for batch in batches:
            for texts, learn in _chunks(batch):
                for text in texts if learn else ():
                    words.update(words_of(text))
                keys, times = np.unique(strings_of(texts, depth)[0], return_counts=True)
                held.append((keys, times if learn else np.zeros(len(keys), np.int64)))
                if sum(len(k) for k, _ in held) > HELD_STRINGS:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_STRINGS // 2:
                        yield from string_rows()
                        held.clear()
                if len(words) > HELD_WORDS:
                    yield from in_batches(((w, None, n) for w, n in words.items()), _COUNTS)
                    words.clear()
        yield from in_batches(((w, None, n) for w, n in words.items()), _COUNTS)
        if held:
            held[:] = [merged()]
            yield from string_rows()

    return docs.mapInArrow(count, _COUNTS_DDL)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], bool]]:
    """Texts of a batch a few megabytes at a time, training ones and others apart."""
    held: dict[bool, list[bytes]] = {True: [], False: []}
    sizes = {True: 0, False: 0}
    for text, learn in zip(batch.column(1), batch.column(2)):
        text, learn = text.as_py(), learn.as_py()
        held[learn].append(text)
        sizes[learn] += len(text)
        if sizes[learn] >= CHUNK_BYTES:
            yield held[learn], learn
            held[learn], sizes[learn] = [], 0
    for learn, texts in held.items():
        if texts:
            yield texts, learn


def _weighted(strings: DataFrame, depth: int, split: int) -> DataFrame:
    """Every string with log10 of its last byte's probability."""
    keyed = strings.withColumn("suffix", F.shiftright("string", 8 * (depth + 1 - split)))

    def sums(group: pa.Table) -> pa.Table:
        keys, order = np.unique(group.column("string").to_numpy(), return_index=True)
        top = levels_of(keys, group.column("n").to_numpy()[order], depth, split)[-1]
        return pa.table({"node": without_oldest(top.keys), "zeros": top.zeros, "ones": top.ones, "log_pw": top.log_pw})

    # At most 256 ** (split - 1) contexts of 255 nodes.
    top = (keyed.groupBy("suffix").applyInArrow(sums, "node long, zeros long, ones long, log_pw double")
           .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_pw").alias("log_pw"))
           .orderBy("node").toPandas())
    levels = [Level(*(top[c].to_numpy() for c in ("node", "zeros", "ones", "log_pw")))]
    for _ in range(split - 1):
        levels.append(levels[-1].shorter())
    mixed, above = Mixed.nothing(len(levels[-1].keys)), None
    for level in reversed(levels):
        if above is not None:
            mixed = mixed[np.searchsorted(above.keys, without_oldest(level.keys))]
        mixed, above = level.mixed(mixed), level
    shared = strings.sparkSession.sparkContext.broadcast((above.keys, mixed))

    def logs(group: pa.Table) -> pa.Table:
        keys, order = np.unique(group.column("string").to_numpy(), return_index=True)
        below = levels_of(keys, group.column("n").to_numpy()[order], depth, split)
        parents, state = shared.value
        for level in reversed(below):
            state = level.mixed(state[np.searchsorted(parents, without_oldest(level.keys))])
            parents = level.keys
        return pa.table({"string": keys, "log10": log10_of(keys, below[0], state)})

    return keyed.groupBy("suffix").applyInArrow(logs, "string long, log10 double")


def _scorer(spark: SparkSession, hot: dict[bytes, float], rest: float, depth: int) -> Callable:
    """Rows of scored documents, given the sorted strings and logs that hold all of theirs.

    ``hot`` has log10(c + 1) of words; ``rest`` is log10(N + V + 1).
    """
    shared = spark.sparkContext.broadcast(hot)

    def rows(batch: pa.RecordBatch, strings: np.ndarray, logs: np.ndarray) -> Iterator[tuple]:
        of = shared.value
        ids, learn = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        at = 0
        for texts in _runs(batch.column(1)):
            found, starts = strings_of(texts, depth)
            sums = np.add.reduceat(logs[np.searchsorted(strings, found)], starts)
            for text, score in zip(texts, sums):
                words = words_of(text)
                known = [of[w] for w in words if w in of]
                others = Counter([w for w in words if w not in of])
                yield (ids[at], not learn[at], len(text), len(words), len(known), math.fsum(known) - len(words) * rest,
                       list(others), list(others.values()), float(score))
                at += 1

    return rows


def _runs(texts) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scored_small(docs: DataFrame, weighted: DataFrame, rows: Callable) -> DataFrame:
    """With all strings in each task."""
    table = weighted.toArrow().sort_by("string")
    shared = docs.sparkSession.sparkContext.broadcast((table["string"].to_numpy(), table["log10"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(rows(batch, *shared.value), _SCORED, long_value=6)

    return docs.mapInArrow(score, _SCORED_DDL)


def _scored_in_blocks(docs: DataFrame, weighted: DataFrame, rows: Callable, depth: int, block_bytes: int) -> DataFrame:
    """With the strings of a block of texts fetched by a join; rows alike in id and text share a block."""
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def distinct(group: pa.Table) -> pa.Table:
        parts = [np.unique(strings_of(texts, depth)[0]) for texts in _runs(group.column("text"))]
        strings = np.unique(np.concatenate(parts))
        return pa.table({"block": np.full(len(strings), group.column("block")[0].as_py()), "string": strings})

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("string").to_numpy())
        strings, logs = found.column("string").to_numpy()[order], found.column("log10").to_numpy()[order]
        out = [made for batch in texts.select(["doc_id", "text", "learn"]).to_batches()
               for made in in_batches(rows(batch, strings, logs), _SCORED, long_value=6)]
        return pa.Table.from_batches(out, _SCORED)

    wanted = blocked.groupBy("block").applyInArrow(distinct, "block long, string long").join(weighted, "string")
    return blocked.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(score, _SCORED_DDL)


def score(
    docs: DataFrame, learn: Column, depth: int = DEPTH, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text",
    broadcast_strings: int = BROADCAST_STRINGS, hot_words: int = HOT_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Log10 probabilities of every text, learned from the rows where ``learn`` holds.

    Columns: doc_id, held_out, n_bytes, n_tokens (words and the end), n_known (of them seen in training), train_tokens,
    base_score (word counts), score (context trees), bits_per_byte (code length of ``score`` over bytes and end).
    """
    if not 1 <= split <= depth <= 6:
        raise ValueError("1 <= split <= depth <= 6")
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = cut_lineage(_counted(narrow, depth))
    words = cut_lineage(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    strings = cut_lineage(counts.where("word IS NULL").groupBy("string").agg(F.sum("n").alias("n")))
    weighted = cut_lineage(_weighted(strings, depth, split))
    n, v = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    hot = {bytes(word): math.log10(c + 1) for word, c in words.orderBy(F.desc("n"), "word").limit(hot_words).collect()}
    rows = _scorer(docs.sparkSession, hot, math.log10(n + v + 1), depth)
    if weighted.count() <= broadcast_strings:
        scored = _scored_small(narrow, weighted, rows)
    else:
        scored = _scored_in_blocks(narrow, weighted, rows, depth, block_bytes)
    # Numbered as it is written, so rows that share an id stay apart.
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    pairs = scored.select("row", F.explode(F.arrays_zip("others", "times")).alias("w")) \
        .select("row", F.col("w.others").alias("word"), F.col("w.times").alias("times"))
    cold = pairs.join(words, "word").groupBy("row").agg(
        F.sum("times").alias("cold_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("cold_log"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scored.drop("others", "times").join(cold, "row", "left").select(
        "doc_id", "held_out", "n_bytes", "n_tokens", (F.col("hot_known") + zero("cold_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("hot_log") + zero("cold_log")).alias("base_score"), "score",
        (F.col("score") * (-math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
