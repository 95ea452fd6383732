"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt evenly over shards of a bounded size; each shard is one tree, kept as one row
of an index table. A tree node holds a vantage point and the median distance to it: nearer points
lie inside, the others outside. A query at distance ``d`` from the vantage point, whose k-th best
so far is ``t`` away, has to see the far side only if ``|d - median| <= t`` (triangle
inequality). ``factor`` relaxes that to ``|d - median| <= factor * t``: with 1 the search is
exact, below 1 it sees fewer leaves.

Queries go out in waves of a bounded size against the whole index; a task keeps the best of all
its shards, so what is shuffled is k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, scratch_path

NEIGHBOURS = 10
SHARD_ROWS = 4096
LEAF_ROWS = 64
# Queries that are broadcast at once, and those that meet a leaf at once.
WAVE_ROWS = 16_384
BLOCK_ROWS = 1024
# Components that are compared at once.
DIFFERENCES = 1 << 19
# Recall and visited leaves at this factor are in the README.
FACTOR = 0.25

_TREE = pa.schema([("shard", pa.int64()), ("tree", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Tree:
    """Points in leaf order; nodes as arrays. A child below 0 is leaf ``-child - 1``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, vantage: np.ndarray, radius: np.ndarray,
                 children: np.ndarray, leaves: np.ndarray):
        self.ids, self.points, self.vantage = ids, points, vantage
        self.radius, self.children, self.leaves = radius, children, leaves

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        placed, leaves, vantage, radius, children = [], [], [], [], []

        def node(members: np.ndarray) -> int:
            """Number of the node over ``members`` (negative for a leaf)."""
            if len(members) > leaf_rows:
                best = None
                # Of a few points, spread over the ids, the one whose distances spread most.
                for pick in members[np.linspace(0, len(members) - 1, 5).astype(int)]:
                    distance = distances(points[pick][None], points[members])[0]
                    if best is None or distance.std() > best[1].std():
                        best = pick, distance
                pick, distance = best
                median = float(np.median(distance))
                inside = distance <= median
                if inside.any() and not inside.all():
                    number = len(vantage)
                    vantage.append(points[pick])
                    radius.append(median)
                    children.append([0, 0])
                    children[number] = [node(members[inside]), node(members[~inside])]
                    return number
            leaves.append((sum(map(len, placed)), len(members)))
            placed.append(members)
            return -len(leaves)

        node(np.arange(len(ids)))
        at = np.concatenate(placed) if placed else np.empty(0, int)
        width = points.shape[1]
        return cls(
            ids[at], points[at], np.array(vantage).reshape(-1, width), np.array(radius),
            np.array(children, np.int64).reshape(-1, 2), np.array(leaves, np.int64).reshape(-1, 2))

    def to_bytes(self) -> bytes:
        head = np.array([len(self.ids), self.points.shape[1], len(self.radius), len(self.leaves)], np.int64)
        parts = (head, self.ids, self.points, self.vantage, self.radius, self.children, self.leaves)
        return b"".join(np.ascontiguousarray(part).tobytes() for part in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        rows, width, nodes, leaves = (int(n) for n in np.frombuffer(raw, np.int64, 4))
        at, out = 32, []
        for kind, shape in ((np.int64, (rows,)), (np.float64, (rows, width)), (np.float64, (nodes, width)),
                            (np.float64, (nodes,)), (np.int64, (nodes, 2)), (np.int64, (leaves, 2))):
            count = int(np.prod(shape))
            out.append(np.frombuffer(raw, kind, count, at).reshape(shape))
            at += 8 * count
        return cls(*out)

    def search(self, best: Best, queries: np.ndarray, factor: float) -> None:
        """Improve ``best`` for the query numbers ``queries`` with this tree's points."""
        # Depth first: each query its own side first, then the far side if it may matter.
        root = 0 if len(self.radius) else -1
        stack: list[tuple] = [(root, queries, None)] if len(self.ids) else []
        while stack:
            child, rows, gap = stack.pop()
            if gap is not None:
                may = gap <= factor * best.worst[rows]
                rows = rows[may]
            if not len(rows):
                continue
            if child < 0:
                first, count = self.leaves[-child - 1]
                best.offer(rows, self.ids[first:first + count], self.points[first:first + count])
                continue
            distance = distances(best.vectors[rows], self.vantage[child][None])[:, 0]
            gap = np.abs(distance - self.radius[child])
            inside = distance <= self.radius[child]
            near, far = self.children[child]
            stack.append((far, rows[inside], gap[inside]))
            stack.append((near, rows[~inside], gap[~inside]))
            stack.append((far, rows[~inside], None))
            stack.append((near, rows[inside], None))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances, from the differences themselves: no cancellation, equal vectors are 0 apart."""
    out = np.empty((len(left), len(right)))
    step = max(1, DIFFERENCES // max(1, right.size))
    for first in range(0, len(left), step):
        difference = left[first:first + step, None, :] - right[None, :, :]
        out[first:first + step] = np.sqrt(np.einsum("ijk,ijk->ij", difference, difference))
    return out


class Best:
    """The k nearest found so far of each query; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, count: int):
        self.query_ids, self.vectors = ids, vectors
        self.ids = np.full((len(ids), count), np.iinfo(np.int64).max)
        self.scores = np.full((len(ids), count), np.inf)
        self.worst = np.full(len(ids), np.inf)
        self.leaf_rows = 0

    def offer(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        count = self.ids.shape[1]
        for first in range(0, len(rows), BLOCK_ROWS):
            some = rows[first:first + BLOCK_ROWS]
            self.leaf_rows += len(some) * len(ids)
            score = distances(self.vectors[some], points)
            score[self.query_ids[some][:, None] == ids[None, :]] = np.inf
            scores = np.concatenate([self.scores[some], score], axis=1)
            all_ids = np.concatenate([self.ids[some], np.broadcast_to(ids, score.shape)], axis=1)
            all_ids = np.where(np.isinf(scores), np.iinfo(np.int64).max, all_ids)
            order = np.lexsort((all_ids, scores), axis=-1)[:, :count]
            self.scores[some] = np.take_along_axis(scores, order, 1)
            self.ids[some] = np.take_along_axis(all_ids, order, 1)
            self.worst[some] = self.scores[some, -1]

    def to_batch(self) -> pa.RecordBatch:
        found = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays([
            pa.array(np.broadcast_to(self.query_ids[:, None], found.shape)[found]),
            pa.array(self.ids[found]), pa.array(self.scores[found])], schema=_FOUND)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def build_index(vectors: DataFrame, width: int, rows: int, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """A row (shard, tree) per shard, written to the shared folder; ``rows`` is the number of vectors."""
    shards = max(1, -(-rows // shard_rows))

    def tree(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        built = Tree.build(ids, _matrix(group.column("vector"), width), leaf_rows)
        return pa.table([[key[0].as_py()], [built.to_bytes()]], schema=_TREE)

    # Dealt by row, not by id, so that rows that repeat an id do not gather in a shard.
    row = F.xxhash64("vec_id", F.monotonically_increasing_id())
    return cut_lineage(
        vectors.withColumn("shard", F.pmod(row, F.lit(shards)))
        .groupBy("shard").applyInArrow(tree, "shard long, tree binary"))


def search_index(index: DataFrame, queries: DataFrame, width: int, count: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found; ``queries`` has vec_id and vector."""
    spark = index.sparkSession
    waves = max(1, -(-queries.count() // WAVE_ROWS))
    waved = cut_lineage(queries.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves))))
    found_path = scratch_path(spark, "neighbours")
    for wave in range(waves):
        # One wave is about WAVE_ROWS vectors, however many queries there are.
        rows = waved.where(F.col("wave") == wave).select("vec_id", "vector").toArrow()
        shared = spark.sparkContext.broadcast((
            rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"), width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, count)
            everyone = np.arange(len(best.query_ids))
            for batch in batches:
                for raw in batch.column(1):
                    Tree.from_bytes(raw.as_py()).search(best, everyone, factor)
            yield best.to_batch()

        index.mapInArrow(run, "query_id long, vec_id long, score double").write.mode("append").parquet(found_path)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(found_path)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= count)
        .select("query_id", "rank", "vec_id", "score"))


def nearest_neighbours(
    df: DataFrame, every: int = 100, count: int = NEIGHBOURS, factor: float = FACTOR,
    id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each id divisible by ``every`` its nearest others.

    Nearest first by Euclidean distance, ties to the smaller id; all candidates, if there are fewer
    than ``count``. Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do null ids. Vectors of different lengths do not meet. Rows with the query's own id are not
    its candidates; a query id that repeats is answered once, for one of its vectors. An empty table
    gives no rows.
    """
    vectors = cut_lineage(usable(df, id_col, vector_col))
    sizes = {row["width"]: row["count"] for row in vectors.groupBy(F.size("vector").alias("width")).count().collect()}
    results = []
    for width, rows in sorted(sizes.items()):
        same = vectors.where(F.size("vector") == width)
        index = build_index(same, width, rows, shard_rows, leaf_rows)
        queries = same.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        results.append(search_index(index, queries, width, count, factor))
    if not results:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
