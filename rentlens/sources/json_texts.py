"""JSON texts cut into their elements, by many tasks for one file.

Spark's text source reads a file in splits, here as fragments that end at ``}``. What a split
holds depends on where it starts: inside a string or not, how deep, and in what kind of
top-level value. So splits of files that are cut are first summarised for both kinds of start (parity of
quotes, change and lowest point of the depth, last bracket opened there); the summaries, a few
bytes per split, are chained; then every split cuts its own elements. An element over a split's end is
put together from its pieces. Those files are read three times. Files too small to be cut are read once, each as
one row, and cut by one task.

Both passes must see the same splits. Spark sizes them by the cores at hand and by all files read, so they are read
in a session of their own that cuts every file above a fixed size, at multiples of that size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

Paths = str | Sequence[str]
# What a byte is: a quote, a bracket that opens or closes, a comma.
_QUOTE, _OPEN, _CLOSE, _COMMA = 1, 2, 3, 4
_KINDS = bytes({34: _QUOTE, 91: _OPEN, 123: _OPEN, 93: _CLOSE, 125: _CLOSE, 44: _COMMA}.get(b, 0) for b in range(256))
_STEPS = np.array([0, 0, 1, -1, 0])
# Files above this are cut (or above Spark's own bound, if that is less).
SPLIT_BYTES = 32 << 20
# Names of files whose size tells how long the text is; others may be compressed, and come in fragments.
_PLAIN = r"\.(json|txt)$"
# A file that is one row is looked at in parts of about so many bytes.
_PART_BYTES = 1 << 20
# Rows of a result batch, and bytes of its texts.
_BATCH_ROWS, _BATCH_BYTES = 2048, 8 << 20

_SUMMARY = "file string, block long, bytes long, size long, odd boolean, out struct<change: long, low: long, opener: string>, " \
    "inside struct<change: long, low: long, opener: string>"
_PIECES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("kind", pa.string()), ("text", pa.string())])
_PIECES_DDL = "file string, block long, no long, kind string, text string"


def _marked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes, brackets and commas; what each is; the parity of quotes up to it; which quotes are not escaped."""
    marks = np.frombuffer(data.translate(_KINDS), np.uint8)
    places = np.flatnonzero(marks != 0)
    kinds = marks[places]
    quotes = kinds == _QUOTE
    if b"\\" in data:
        # A quote after an odd run of backslashes is escaped.
        back = np.frombuffer(data, np.uint8) == 92
        plain = np.maximum.accumulate(np.where(back, -1, np.arange(len(back))))
        before = places - 1
        quotes &= np.where(before >= 0, before - plain[before], 0) % 2 == 0
    return places, kinds, np.cumsum(quotes, dtype=np.uint8) & 1, quotes


def structure(data: bytes, in_string: bool, marked: tuple | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the brackets and commas outside strings, what each does to the depth, and whether a string is open at the end."""
    places, kinds, parity, quotes = marked or _marked(data)
    wanted = np.flatnonzero((parity == in_string) & (kinds != _QUOTE))
    return places[wanted], _STEPS[kinds[wanted]], bool((np.count_nonzero(quotes) + in_string) % 2)


class Summary:
    """What a run of text does to the depth, for one kind of start; runs add up."""

    def __init__(self, in_string: bool):
        self.in_string, self.change, self.low, self.opener = in_string, 0, 0, ""

    def feed(self, data: bytes, marked: tuple | None = None) -> None:
        places, steps, self.in_string = structure(data, self.in_string, marked)
        if not len(places):
            return
        after = self.change + np.cumsum(steps)
        low = min(self.low, int(after.min()))
        opened = np.flatnonzero((after - steps == low) & (steps > 0))
        if len(opened):
            self.opener = chr(data[places[opened[-1]]])
        elif low < self.low:
            self.opener = ""
        self.change, self.low = int(after[-1]), low


def chained(depth: int, container: str, change: int, low: int, opener: str) -> tuple[int, str]:
    """Depth and top-level bracket after a run, given those before it; brackets that close nothing are passed over."""
    end = change + max(depth, -low)
    if depth + low > 0:
        return end, container
    return end, opener if end > 0 else ""


class Cutter:
    """Cuts the elements of one split; ``entries`` also cuts objects into their entries."""

    def __init__(self, in_string: bool, depth: int, container: str, entries: bool):
        self.in_string, self.depth, self.container, self.entries = in_string, depth, container, entries
        # Text since the last border; whether an element that began in an earlier split is open.
        self.held: list[bytes] = []
        self.earlier, self.first = depth > 0, False
        self.no = 0

    def _lists(self, container: str) -> bool:
        return container == "[" or self.entries

    def feed(self, data: bytes) -> Iterator[tuple[int, str, bytes]]:
        """(number, kind, text) of what ends in this text: ``whole``, ``tail`` (begun in an earlier split) or ``stray``."""
        places, steps, self.in_string = structure(data, self.in_string)
        # Brackets that would close nothing leave the depth at 0.
        raw = self.depth + np.cumsum(steps)
        after = raw - np.minimum(0, np.minimum.accumulate(raw)) if len(raw) else raw
        before = np.concatenate([[self.depth], after[:-1]]) if len(raw) else raw
        opens, closes = (steps > 0) & (before == 0), (steps < 0) & (before == 1)
        borders = np.flatnonzero(opens | closes | ((steps == 0) & (before == 1)))
        start = 0
        for at, opened, closed in zip(places[borders].tolist(), opens[borders].tolist(), closes[borders].tolist()):
            if opened:
                yield from self._stray(data[start:at])
                self.container = chr(data[at])
                start = at + 1 if self._lists(self.container) else at
                self.first = True
            elif self._lists(self.container):
                yield from self._element(data[start:at], empty_is_none=closed and self.first)
                start, self.first = at + 1, False
            elif closed:
                yield from self._element(data[start:at + 1])
                start = at + 1
            if closed:
                self.container = ""
        self.held.append(data[start:])
        self.depth = int(after[-1]) if len(after) else self.depth

    def _element(self, text: bytes, empty_is_none: bool = False) -> Iterator[tuple[int, str, bytes]]:
        text = b"".join([*self.held, text])
        self.held.clear()
        if self.earlier:
            self.earlier = False
            yield -1, "tail", text
        elif text.strip() or not empty_is_none:
            yield self.no, "whole", text
            self.no += 1

    def _stray(self, text: bytes) -> Iterator[tuple[int, str, bytes]]:
        text = b"".join([*self.held, text]).strip(b" \t\r\n\xef\xbb\xbf")
        self.held.clear()
        if text:
            yield self.no, "stray", text
            self.no += 1

    def end(self) -> Iterator[tuple[int, str, bytes]]:
        """What is left at the end of the split: ``head`` of an element, ``middle`` of one that began before, or ``stray``."""
        if self.depth == 0:
            yield from self._stray(b"")
        elif self.earlier:
            yield -1, "middle", b"".join(self.held)
        else:
            yield self.no, "head", b"".join(self.held)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Per split its key (path, block, length, size), and its text in order, each fragment ended by ``}``."""
    def runs():
        for batch in batches:
            *keys, values = batch.columns
            at = 0
            for end in sorted({end for column in keys[:2] for end in pc.run_end_encode(column).run_ends.to_pylist()}):
                fragments = pa.ListArray.from_arrays([0, end - at], values.slice(at, end - at))
                yield tuple(column[at].as_py() for column in keys), pc.binary_join(fragments, b"}")[0].as_py() + b"}"
                at = end

    for key, parts in groupby(runs(), key=lambda run: run[0]):
        yield key, (text for _, text in parts)


def _split_bytes(spark: SparkSession) -> int:
    return min(SPLIT_BYTES, _size(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def _fixed_splits(spark: SparkSession) -> SparkSession:
    """A session with the same settings but for splits: of ``_split_bytes``, however many cores or other files there are."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(_split_bytes(spark)))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def _texts(spark: SparkSession, paths: Paths, whole: bool) -> DataFrame:
    """Files that are never cut, a row each (``whole``), or the fragments of all others.

    Files of the other kind are left out when files are listed.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    reader = _fixed_splits(spark).read
    texts = reader.text(paths, wholetext=True) if whole else reader.text(paths, lineSep="}")
    meta = "_metadata.file_"
    small = (F.col(f"{meta}size") <= _split_bytes(spark)) & F.col(f"{meta}path").rlike(_PLAIN)
    rows = texts.where(small if whole else ~small).select(
        F.col(f"{meta}path").alias("path"), F.col(f"{meta}block_start").alias("block"),
        F.col(f"{meta}block_length").alias("length"), F.col(f"{meta}size").alias("size"), F.col("value").cast("binary").alias("value"))
    # Rows of the caller's session; the optimizer drops the side without rows.
    none = spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in rows.schema])
    return none.unionByName(rows)


def _starts(spark: SparkSession, paths: Paths) -> dict[tuple[str, int], tuple]:
    """Of the splits of files that are cut: how each starts, and whether it holds the file's end without a ``}``.

    One entry per split: a few hundred bytes for ``SPLIT_BYTES`` of input.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, _, size), parts in _splits(batches):
            both, length = (Summary(False), Summary(True)), 0
            for text in parts:
                length += len(text)
                marked = _marked(text)
                for summary in both:
                    summary.feed(text, marked)
            states = [{"change": s.change, "low": s.low, "opener": s.opener} for s in both]
            yield pa.RecordBatch.from_pylist([{
                "file": file, "block": block, "bytes": length, "size": size, "odd": both[0].in_string,
                "out": states[0], "inside": states[1]}], schema=schema)

    state = pa.struct([("change", pa.int64()), ("low", pa.int64()), ("opener", pa.string())])
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64()), ("odd", pa.bool_()),
        ("out", state), ("inside", state)])
    # Smaller files are never cut, and left out when files are listed.
    cut = _texts(spark, paths, whole=False).where(F.col("size") > _split_bytes(spark)).where(F.col("length") < F.col("size"))
    rows = sorted(cut.mapInArrow(summarise, _SUMMARY).collect(), key=lambda row: (row.file, row.block))
    starts = {}
    for file, splits in groupby(rows, key=lambda row: row.file):
        splits = list(splits)
        in_string, depth, container = False, 0, ""
        unended = sum(row.bytes for row in splits) == splits[0].size + 1
        for row in splits:
            starts[file, row.block] = in_string, depth, container, unended and row is splits[-1]
            state = row.inside if in_string else row.out
            depth, container = chained(depth, container, state.change, state.low, state.opener)
            in_string ^= row.odd
    return starts


def _size(setting: str) -> int:
    """Bytes of a setting such as 128MB or 4194304."""
    units = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    digits = setting.rstrip("bBkKmMgGtT")
    return int(digits) << units[setting[len(digits):].lower()[:1]]


def json_elements(spark: SparkSession, paths: Paths, entries: bool = False) -> DataFrame:
    """The elements of JSON texts: file, block (start of the split), no (within it, from 0), record, whole.

    A record is an element of a top-level array, or a top-level object; with ``entries`` an
    entry of a top-level object (``"key": value``). A file may hold several texts, on one line or many. Where a file
    ends inside a text, what is left of its last element is a row that is not ``whole``; so is text that
    belongs to no value. All else is there whatever ails the file. Of compressed files a missing
    last ``}`` of a single object is not noticed.
    """
    starts = _starts(spark, paths)
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block, length, file_size), parts in _splits(batches):
            start = shared.value.get((path, block))
            uncut = block == 0 and length >= file_size
            if start is None and not uncut:
                raise RuntimeError(f"a split that the first pass did not see: {path} at {block}")
            cutter = Cutter(*(start[:3] if start else (False, 0, "")), entries)

            def found():
                # The last text is kept back until it is known whether a brace ends it.
                last, total = b"", 0
                for text in parts:
                    yield from cutter.feed(last)
                    last, total = text, total + len(text)
                unended = start[3] if start else total == file_size + 1
                yield from cutter.feed(last[:-1] if unended or total > file_size + 1 and start is None else last)
                if start is None and total > file_size + 1 and cutter.depth == 1 and cutter.container == "{":
                    yield from cutter.feed(b"}")
                yield from cutter.end()

            yield from _pieces(path, block, found(), uncut)

    def cut_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1)):
                cutter = Cutter(False, 0, "", entries)

                def found():
                    for part in _parts(text.as_buffer()):
                        yield from cutter.feed(part)
                    yield from cutter.end()

                yield from _pieces(path.as_py(), 0, found(), True)

    fragments = _texts(spark, paths, whole=False)
    files = _texts(spark, paths, whole=True).select("path", "value")
    cuts = files.mapInArrow(cut_whole, _PIECES_DDL).unionByName(fragments.mapInArrow(cut, _PIECES_DDL))
    complete = cuts.where(F.col("kind").isin("whole", "stray"))
    # Null beside the pieces: what is made of a record may be evaluated before they are filtered out.
    own = F.when(F.col("kind").isin("whole", "stray"), F.col("text")).alias("record")
    elements = complete.select("file", "block", "no", own, (F.col("kind") == "whole").alias("whole"))
    if not starts:
        return elements
    pieces = fragments.where(F.col("size") > _split_bytes(spark)).mapInArrow(cut, _PIECES_DDL)
    # At most two pieces of a split.
    by_place = Window.partitionBy("file").orderBy("block", F.col("no") >= 0)
    parts = pieces.where(~F.col("kind").isin("whole", "stray")).withColumn("element", F.sum((F.col("kind") == "head").cast("int")).over(by_place))
    # A split's pieces in order: the end of an earlier element, then the head of the next.
    joined = parts.groupBy("file", "element").agg(
        F.min_by("block", F.struct("block", F.col("no") >= 0)).alias("block"), F.max("no").alias("no"),
        F.array_sort(F.collect_list(F.struct("block", (F.col("no") >= 0).alias("later"), "text"))).alias("texts"),
        F.max(F.col("kind") == "tail").alias("whole"))
    return elements.unionByName(
        joined.select("file", "block", "no", F.trim(F.concat_ws("", F.transform("texts", lambda t: t["text"]))).alias("record"), "whole"))


def with_position(elements: DataFrame) -> DataFrame:
    """Elements with their ``position`` in the file, from 0, by counts per split."""
    counts = elements.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    return elements.join(first, ["file", "block"]).withColumn("position", F.col("_before") + F.col("no")).drop("_before")


def _parts(text: pa.Buffer) -> Iterator[bytes]:
    """A text in parts that end after a ``}``, so none ends between a backslash and what it escapes."""
    start, held = 0, memoryview(text)
    while start < len(held):
        end = start + _PART_BYTES
        # Far apart only where one value holds a very long text.
        while end < len(held) and held[end - 1] != 125:
            end += 1
        yield bytes(held[start:end])
        start = end


def _pieces(path: str, block: int, found: Iterator[tuple[int, str, bytes]], uncut: bool) -> Iterator[pa.RecordBatch]:
    """What a cutter found in one split, in batches bounded in rows and bytes."""
    held: list[tuple] = []
    size = 0
    for no, kind, text in found:
        record = text.decode("utf-8", "replace")
        if uncut and kind == "head":
            # Nothing follows: the file ends inside its last element.
            kind, record = "stray", record.strip(" ")
        held.append((path, block, no, kind, record.strip() if kind == "whole" else record))
        size += len(text)
        if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _PIECES)], schema=_PIECES)
