"""Multi-level grid: spatial joins as equi joins on cells.

Level ``l`` has cells of side 2^-l (exact in floating point). A box is cut into cells of
the level at which it spans only a few, so a country and a street corner both become a
handful of rows. A point is placed in its cell of every level that is in use (few, since
a level covers a factor of two in size), and the two meet by an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .joins import BROADCAST_ROWS, lookup_join

MIN_LEVEL, MAX_LEVEL = -20, 24
CELL = ("level", "cx", "cy")


def level_for(extent: Column, per_side: Column | int = 4) -> Column:
    """The finest level at which ``extent`` spans at most ``per_side`` + 1 cells."""
    per_side = per_side if isinstance(per_side, Column) else F.lit(per_side)
    level = F.floor(F.log2(per_side / F.nullif(extent, F.lit(0.0)))).cast("int")
    return F.coalesce(F.greatest(F.least(level, F.lit(MAX_LEVEL)), F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL))


def cell_no(coordinate: Column, level: Column) -> Column:
    return F.floor(coordinate * F.pow(F.lit(2.0), level)).cast("bigint")


def cell_side(level: Column) -> Column:
    return F.pow(F.lit(2.0), -level)


def with_box_cells(
    boxes: DataFrame, min_x: str, min_y: str, max_x: str, max_y: str, per_side: int = 4
) -> DataFrame:
    """One row per box and grid cell it touches: at most (per_side + 1)^2 rows per box."""
    extent = F.greatest(F.col(max_x) - F.col(min_x), F.col(max_y) - F.col(min_y))
    leveled = boxes.withColumn("level", level_for(extent, per_side))

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(cell_no(F.col(low), F.col("level")), cell_no(F.col(high), F.col("level"))))

    return leveled.withColumn("cx", span(min_x, max_x)).withColumn("cy", span(min_y, max_y))


def with_point_cells(points: DataFrame, x: str, y: str, levels: list[int]) -> DataFrame:
    """One row per point and level in use."""
    at = F.array(*[F.lit(level) for level in levels]).cast("array<int>")
    return (
        points.withColumn("level", F.explode(at))
        .withColumn("cx", cell_no(F.col(x), F.col("level")))
        .withColumn("cy", cell_no(F.col(y), F.col("level")))
    )


def join_on_cells(
    points: DataFrame, x: str, y: str, cells: DataFrame, weight: Column | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Points beside the rows of ``cells`` (level, cx, cy, ...) of the cells they lie in."""
    # One pass over the cells: the levels (at most MAX_LEVEL - MIN_LEVEL + 1) and the size.
    levels, size = cells.agg(
        F.collect_set("level"), F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0))
    ).first()
    placed = with_point_cells(points, x, y, sorted(levels))
    small = size <= (BROADCAST_ROWS if max_rows is None else max_rows)
    return lookup_join(placed, cells, CELL, small=small).drop(*CELL)


def points_in_boxes(
    points: DataFrame, x: str, y: str, boxes: DataFrame,
    min_x: str = "min_x", min_y: str = "min_y", max_x: str = "max_x", max_y: str = "max_y",
    per_side: int = 4,
) -> DataFrame:
    """Each point beside each box (closed) that holds it.

    Fewer cells ``per_side`` copy each box less often but meet more points outside it.
    """
    cells = with_box_cells(boxes, min_x, min_y, max_x, max_y, per_side)
    inside = F.col(x).between(F.col(min_x), F.col(max_x)) & F.col(y).between(F.col(min_y), F.col(max_y))
    return join_on_cells(points, x, y, cells).where(inside)
