"""Connected components of links, by union-find in tasks and by shuffles between them.

Each round deals the links by their larger end and lets every task replace its links by a star
per local component, the least id in the middle. That keeps what is connected, never has more
links than before, and ends when each id has one parent. Parents are smaller than their children,
so following them ends at the least id of the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

_LINKS = pa.schema([("node", pa.int64()), ("parent", pa.int64())])
LINKS_AT_ONCE = 500_000


class UnionFind:
    """Sets of ids; the least id of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        top = node
        while (above := parent.get(top, top)) != top:
            top = above
        while node != top:
            parent[node], node = top, parent.get(node, node)
        return top

    def union(self, one: int, other: int) -> bool:
        """Join two sets; False if they were one already."""
        one, other = self.root(one), self.root(other)
        if one == other:
            return False
        self.parent[max(one, other)] = min(one, other)
        return True

    def stars(self) -> list[tuple[int, int]]:
        return [(node, self.root(node)) for node in list(self.parent)]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(one, other)
        if len(sets.parent) >= LINKS_AT_ONCE:
            yield _batch(sets)
            sets = UnionFind()
    yield _batch(sets)


def _batch(sets: UnionFind) -> pa.RecordBatch:
    stars = np.array(sets.stars(), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], schema=_LINKS)


def components(links: DataFrame) -> DataFrame:
    """node, component for every id in ``links`` (two long columns); the least id's own row is left out.

    ``component`` is the least id reachable. Repeated links and links of an id with itself are
    harmless; no links give no rows.
    """
    one, other = (F.col(f"`{name}`") for name in links.columns)
    # Stars over several tasks may name several parents for an id; then another round follows.
    stars = cut_lineage(
        links.select(F.greatest(one, other).alias("node"), F.least(one, other).alias("parent"))
        .where("node <> parent").mapInArrow(_local_stars, "node long, parent long").distinct())
    while not stars.groupBy("node").count().where("count > 1").isEmpty():
        stars = cut_lineage(
            stars.repartition("node").mapInArrow(_local_stars, "node long, parent long").distinct())
    while True:
        above = stars.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        # Many ids may share a parent: both sides come from a written table, so Spark can split that
        # key's partition at run time.
        jumped = cut_lineage(
            stars.join(above, "parent", "left")
            .select("node", F.coalesce("_above", "parent").alias("parent"), F.col("_above").isNotNull().alias("moved")))
        stars = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return stars.select("node", F.col("parent").alias("component"))
