"""Ranked lexical search of every document for each item of a query set, by masks of matched terms.

Documents are reduced once to the terms that the items use: a row of term numbers and occurrences. A
task holds a few thousand of them as a table of presence bits, and for each item packs the bits of its
terms: documents with equal masks form a group. The weights of a mask's terms times the most that any
document of the table gets from each bounds the score of the group. Groups are scored in descending
order of that bound until it falls below the item's k-th best score so far; that score is carried
from table to table, so later ones score few groups. A task sends at most ``k`` documents per item.

Items go in blocks of a bounded number of terms; each block is a pass over the documents. No pairs of items and
documents are made. Tasks split documents by file, so no source, term or group of copies is a hot key.

Null and empty texts, of documents and items, have no terms and do not take part. A text of any length is one
row of counts. Repeated documents are ranked each; repeated items (id and text) once; items that share an
id but not the text are ranked one by one under that id. Null ids come last among equal scores.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import in_batches

K = 20
# Distinct terms of a block of items, and cells of a table of documents by terms.
BLOCK_TERMS = 8192
TABLE_CELLS = 8 << 20
# Fixed value: the bytes that are part of a term (ASCII letters and digits, and all beyond ASCII).
TERM_BYTES = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# Separators as blanks, A-Z in lower case.
_TABLE = bytes(byte if re.fullmatch(TERM_BYTES, bytes([byte])) else 32 for byte in range(256)).lower()

_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_FOUND = pa.schema([("item_no", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TABLE).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Items:
    """A block of items: distinct terms, and per item the numbers of its terms with repeats."""

    def __init__(self, rows: list):
        self.keys = [row.item_id for row in rows]
        counts = [Counter(terms_of(row.text)) for row in rows]
        self.terms = {term: n for n, term in enumerate(sorted(set().union(*counts)))}
        self.columns = [np.array([self.terms[t] for t in c], dtype=np.int64) for c in counts]
        self.repeats = [np.array(list(c.values()), dtype=np.int64) for c in counts]


def _counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Per document with a term: how many it has, and the numbers and occurrences of the known ones."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    words = terms_of(text.as_py())
                    if words:
                        found = Counter([get[w] for w in words if w in get])
                        yield doc_id.as_py(), len(words), list(found), list(found.values())

        yield from in_batches(rows(), _COUNTED, long_value=2)

    return docs.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<int>")


class Best:
    """The ``k`` best documents of an item so far: score descending, then id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A score that a document must attain to matter; ids settle ties."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(int(s), i) for s, i in zip(scores, ids) if s > 0]
        self.rows.sort(key=lambda row: (-row[0], row[1] is None, row[1] or 0))
        del self.rows[self.k:]


def group_by_mask(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a table of presence (terms by documents): the documents with a term, the group of each, and the bits of each group."""
    n_terms = len(present)
    packed = np.ascontiguousarray(np.packbits(present, axis=0).T)
    held = np.flatnonzero(packed.any(axis=1))
    # Masks as single values: whole numbers up to 64 terms, byte strings beyond.
    width = packed.shape[1]
    if width <= 8:
        keys = np.zeros((len(packed), 8), np.uint8)
        keys[:, :width] = packed
        keys = keys.view(np.uint64).ravel()[held]
    else:
        keys = packed.view(f"V{width}").ravel()[held]
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    bits = np.unpackbits(packed[held[first]], axis=1, count=n_terms)
    return held, group.ravel(), bits


def rank_by_masks(present: np.ndarray, impacts: np.ndarray, weights: np.ndarray, ids: list, best: Best) -> int:
    """Adds to ``best`` what of a table (terms of one item by documents) can matter; how many were scored."""
    held, group, bits = group_by_mask(present)
    if not len(held):
        return 0
    bounds = bits.astype(np.int64) @ (weights * impacts.max(axis=1))
    order = np.argsort(-bounds, kind="stable")
    falling = -bounds[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    # Documents by the place of their group, so a run of groups is a slice.
    placed = place[group]
    by_place = held[np.argsort(placed, kind="stable")]
    ends = np.cumsum(np.bincount(placed, minlength=len(order)))
    start, first, step = 0, 0, 2 * best.k
    while first < len(order) and -falling[first] >= best.least:
        # Groups of about ``step`` documents at a time, none whose bound cannot matter.
        last = min(int(np.searchsorted(ends, start + step)) + 1, int(np.searchsorted(falling, -best.least, side="right")))
        rows = by_place[start:ends[last - 1]]
        scores = weights @ impacts[:, rows]
        good = np.flatnonzero(scores >= best.least)
        best.add(scores[good], [ids[n] for n in rows[good]])
        start, first, step = int(ends[last - 1]), last, 2 * step
    return start


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _search(counted: DataFrame, items: Items, weights: list[int], k: int) -> DataFrame:
    """Per task and item the ``k`` best documents."""
    shared = counted.sparkSession.sparkContext.broadcast((items, np.array(weights, dtype=np.int64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        best = [Best(k) for _ in block.keys]
        n_terms = len(block.terms)
        for batch in _tables(batches, max(1, TABLE_CELLS // max(1, n_terms))):
            ids = batch.column(0).to_pylist()
            m = batch.column(1).to_numpy()
            sizes = np.asarray(pc.list_value_length(batch.column(2)), dtype=np.int64)
            row = np.repeat(np.arange(len(ids)), sizes)
            column = batch.column(2).flatten().to_numpy()
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            present = np.zeros((n_terms, len(ids)), dtype=bool)
            present[column, row] = True
            impacts = np.zeros((n_terms, len(ids)), dtype=np.int64)
            impacts[column, row] = impact(tf, m[row])
            for item, (columns, repeats) in enumerate(zip(block.columns, block.repeats)):
                rank_by_masks(present[columns], impacts[columns], weight[columns] * repeats, ids, best[item])
        yield from in_batches(((n, doc, score) for n, b in enumerate(best) for score, doc in b.rows), _FOUND)

    return counted.mapInArrow(search, "item_no int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items with a term, in blocks of about ``BLOCK_TERMS`` terms by hash."""
    spark = items.sparkSession
    whole = cut_lineage(items.dropDuplicates(["item_id", "text"]).withColumn("hash", F.xxhash64("item_id", "text")))
    # A term takes two bytes, the separator included.
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / (8 * BLOCK_TERMS)))
    for part in range(parts):
        rows = [r for r in whole.where(F.pmod("hash", F.lit(parts)) == part).collect() if terms_of(r.text)]
        if rows:
            yield Items(rows)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (from 1), doc_id, score above 0."""
    def narrow(df, key, text, name):
        return df.select(
            F.col(f"`{key}`").cast("long").alias(name),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    spark = docs.sparkSession
    corpus = narrow(docs, id_col, text_col, "doc_id")
    result = None
    for block in _blocks(narrow(items, item_id_col, item_text_col, "item_id")):
        counted = cut_lineage(_counted(corpus, block.terms))
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        found_in = dict(counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
        weights = [
            math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found_in.get(number, 0) + 1)))
            for number in range(len(block.terms))]
        m = F.expr(f"cast(100 - 25 + ((25L * n * {n_docs}L) div {max(1, n_terms or 0)}L) AS bigint)")
        found = _search(counted.where(F.size("ids") > 0).select("doc_id", m.alias("m"), "ids", "tfs"), block, weights, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*order))).where(F.col("rank") <= k)
        keys = spark.createDataFrame(list(enumerate(block.keys)), "item_no int, item_id long")
        rows = ranked.join(F.broadcast(keys), "item_no").select("item_id", "rank", "doc_id", "score")
        result = rows if result is None else result.unionByName(rows)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result
