"""Adaptive tiling: quarter a box until each tile holds few enough points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MAP_CAP
from ..session import cut_lineage
from .grid import points_in_boxes

# Depth at which cells are as fine as doubles across a box, and depths that are opened at once.
DEEPEST = 50
STEP = 12


def _axis_no(value: Column, low: Column, high: Column, depth: int) -> Column:
    """Half-open cell number at ``depth``; the upper border belongs to the last cell."""
    cells = float(2**depth)
    position = F.floor(F.try_divide(value - low, high - low) * cells)
    return F.coalesce(F.greatest(F.least(position, F.lit(cells - 1)), F.lit(0.0)), F.lit(0.0)).cast("bigint")


def _located(points: DataFrame, boxes: DataFrame, x: str, y: str, depth: int) -> DataFrame:
    met = points_in_boxes(points, x, y, boxes)
    return met.withColumns({
        "_ix": _axis_no(F.col(x), F.col("min_x"), F.col("max_x"), depth),
        "_iy": _axis_no(F.col(y), F.col("min_y"), F.col("max_y"), depth),
    })


def _at_depth(column: str, deepest: int) -> Column:
    """Cell number at the row's ``depth`` of a cell number at ``deepest``."""
    return F.expr(f"shiftright({column}, {deepest} - depth)")


def counts_by_depth(cells: DataFrame, key: Sequence[str], deepest: int, *aggregates: Column, top: int = 0) -> DataFrame:
    """Aggregates of every cell at the depths ``top``..``deepest``, from rows of the deepest cells.

    Rows are grouped before they come here, and partial aggregates fold the repeats
    before the shuffle.
    """
    return (
        cells.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(deepest))))
        .withColumns({"ix": _at_depth("_ix", deepest), "iy": _at_depth("_iy", deepest)})
        .groupBy(*key, "depth", "ix", "iy")
        .agg(*aggregates)
    )


def leaf_cells(counts: DataFrame, key: Sequence[str], cap: int, deepest: int, top: int = 0) -> DataFrame:
    """The coarsest cells with ``n`` at most ``cap`` (or at ``deepest``) below full ones or at ``top``.

    A full cell tells its four quarters so; one grouping brings that and their own counts
    together. No join, and ``counts`` is read once, whatever the depth.
    """
    def entry(depth: Column, ix: Column, iy: Column, n: Column, opened: bool) -> Column:
        return F.struct(depth.alias("depth"), ix.alias("ix"), iy.alias("iy"), n.alias("n"), F.lit(opened).alias("opened"))

    depth, ix, iy = F.col("depth"), F.col("ix"), F.col("iy")
    none = F.lit(None).cast("bigint")
    own = entry(depth, ix, iy, F.col("n"), False)
    quarters = [entry(depth + 1, ix * 2 + a, iy * 2 + b, none, True) for a in (0, 1) for b in (0, 1)]
    is_full = (F.col("n") > cap) & (depth < deepest)
    told = counts.select(*key, F.explode(F.when(is_full, F.array(own, *quarters)).otherwise(F.array(own))).alias("_c"))
    return (
        told.select(*key, "_c.*").groupBy(*key, "depth", "ix", "iy")
        .agg(F.max("n").alias("n"), F.bool_or("opened").alias("_opened"))
        .where(F.col("n").isNotNull() & (F.col("_opened") | (depth == top)) & ((F.col("n") <= cap) | (depth == deepest)))
        .drop("_opened")
    )


def adaptive_tiles(
    points: DataFrame, boxes: DataFrame, cap: int = MAP_CAP, max_depth: int = DEEPEST,
    x: str = "longitude", y: str = "latitude",
) -> DataFrame:
    """The tiles of each box: coarsest quarterings that hold 1 to ``cap`` points each.

    ``boxes(region, min_x, min_y, max_x, max_y)``. A tile appears when it has at most
    ``cap`` points and its parent has more; tiles without points are left out. Tiles of
    one box are disjoint and their counts add up to its points. A tile at ``max_depth``
    with more than ``cap`` points is kept with ``overflow`` set, so no point is lost. By
    default that is as deep as doubles tell points of a box apart.

    Points are counted once per deepest cell. ``STEP`` depths at a time are read off those
    counts by two groupings; only cells that are still too full go on to the next ones.
    """
    boxes = boxes.select("region", "min_x", "min_y", "max_x", "max_y")
    key = ["region"]
    cells = _located(points, boxes, x, y, max_depth).groupBy("region", "_ix", "_iy").agg(F.count("*").alias("_n"))
    if max_depth > STEP:
        cells = cut_lineage(cells)
    leaves, top = None, 0
    while True:
        deep = min(top + STEP, max_depth)
        up = max_depth - deep
        shifted = cells.withColumns({"_ix": F.shiftright("_ix", up), "_iy": F.shiftright("_iy", up)}) if up else cells
        counts = counts_by_depth(shifted, key, deep, F.sum("_n").alias("n"), top=top)
        found = leaf_cells(counts, key, cap, deep, top)
        if deep < max_depth:
            found = cut_lineage(found)
            full = found.where((F.col("depth") == deep) & (F.col("n") > cap)).select("region", F.col("ix").alias("_jx"), F.col("iy").alias("_jy"))
            if not full.isEmpty():
                settled = found.where((F.col("depth") < deep) | (F.col("n") <= cap))
                leaves = settled if leaves is None else leaves.unionByName(settled)
                inner = cells.withColumns({"_jx": F.shiftright("_ix", up), "_jy": F.shiftright("_iy", up)})
                cells = cut_lineage(inner.join(full, ["region", "_jx", "_jy"], "left_semi").drop("_jx", "_jy"))
                top = deep
                continue
        leaves = found if leaves is None else leaves.unionByName(found)
        break

    size = F.pow(F.lit(2.0), F.col("depth"))
    step_x, step_y = (F.col("max_x") - F.col("min_x")) / size, (F.col("max_y") - F.col("min_y")) / size
    return leaves.join(boxes, "region").select(
        "region", "depth", "ix", "iy", "n", (F.col("n") > cap).alias("overflow"),
        (F.col("min_x") + F.col("ix") * step_x).alias("tile_min_x"),
        (F.col("min_y") + F.col("iy") * step_y).alias("tile_min_y"),
        (F.col("min_x") + (F.col("ix") + 1) * step_x).alias("tile_max_x"),
        (F.col("min_y") + (F.col("iy") + 1) * step_y).alias("tile_max_y"),
    )


def tile_ids(
    points: DataFrame, boxes: DataFrame, x: str = "longitude", y: str = "latitude", key: str = "id"
) -> DataFrame:
    """The distinct ids found by asking every tile of every box.

    The tiles of a box hold all its points, so the box itself answers for them.
    """
    boxes = boxes.select("region", "min_x", "min_y", "max_x", "max_y")
    return points_in_boxes(points.select(key, x, y), x, y, boxes).select(key).distinct()
