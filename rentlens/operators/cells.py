"""Cells of sites (Voronoi), their rings, and the nearest-site join.

Cells are found in two steps. A first polygon per site comes from its neighbours in a
quadtree leaf and one representative of each surrounding coarser cell. Only a site inside
one of the circles around that polygon's vertices (through the site itself) can cut it
further; those are fetched by a box join and applied. When none is left the cell is exact,
however dense or sparse the sites are around it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clipping
from ..functions.clipping import nearest_part
from ..session import cut_lineage
from .grid import points_in_boxes
from .joins import BROADCAST_ROWS, lookup_join, spread_join
from .tiles import _at_depth, _axis_no, counts_by_depth, leaf_cells

# The clipping code travels with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(clipping)

Envelope = tuple[float, float, float, float]
LEAF_SITES = 64
# Sites of a six-decimal data set as wide as a continent get cells of their own.
DEEPEST = 26
# Cutting sites applied per round; a site with more goes on to another round.
CUTS_PER_ROUND = 64
# Sites per task: clipping is bound by the processor, so tasks are sized by their sites.
SITES_PER_TASK = 10_000
# A circle must be entered by more than rounding error to count as a cut.
CUT_MARGIN = 1.0 - 1e-10


def envelope_of(*tables: tuple[DataFrame, str, str], margin: float = 0.1) -> Envelope:
    """The box around the points of the tables, grown by ``margin`` of its longer side."""
    low_x = low_y = float("inf")
    high_x = high_y = float("-inf")
    for df, x, y in tables:
        row = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
        if row[0] is None:
            continue
        low_x, low_y = min(low_x, float(row[0])), min(low_y, float(row[1]))
        high_x, high_y = max(high_x, float(row[2])), max(high_y, float(row[3]))
    if low_x == float("inf"):
        return (0.0, 0.0, 1.0, 1.0)
    grow = margin * (max(high_x - low_x, high_y - low_y) or 1.0)
    return (low_x - grow, low_y - grow, high_x + grow, high_y + grow)


def _polygon_columns(id_type: str) -> str:
    return f"site_id {id_type}, x double, y double, vx array<double>, vy array<double>"


def _tasks(sites: int) -> int:
    return max(1, math.ceil(sites / SITES_PER_TASK))


def _first_polygons(sites: DataFrame, envelope: Envelope, n_sites: int) -> DataFrame:
    """A first polygon for every site: site_id, x, y, vx, vy.

    Too large a polygon costs time in the exact step, never correctness.
    """
    west, south, east, north = envelope
    located = sites.withColumns({
        "_ix": _axis_no(F.col("x"), F.lit(west), F.lit(east), DEEPEST),
        "_iy": _axis_no(F.col("y"), F.lit(south), F.lit(north), DEEPEST),
    })
    counts = counts_by_depth(
        located, [], DEEPEST, F.count("*").alias("n"), F.min(F.struct("x", "y")).alias("rep")
    )
    counts = cut_lineage(counts)
    # Sites too close for the deepest cells are dealt out over groups of about LEAF_SITES.
    leaves = cut_lineage(leaf_cells(counts, [], LEAF_SITES, DEEPEST).select(
        "depth", "ix", "iy", F.ceil(F.col("n") / LEAF_SITES).cast("int").alias("_groups")
    ))
    n_leaves, depths = leaves.agg(F.count("*"), F.collect_set("depth")).first()  # at most DEEPEST + 1 depths

    # Representatives: one site per cell around the leaf, at its depth and every coarser one
    # (3 x 3 cells), and at the two finer ones (the leaf's cells and two rows beyond).
    coarser, finer = "greatest(leaf.depth - depth, 0)", "greatest(depth - leaf.depth, 0)"

    def around_axis(axis: str) -> Column:
        low = f"shiftleft(shiftright(leaf.{axis}, {coarser}), {finer}) - if(depth > leaf.depth, 2, 1)"
        high = f"shiftleft(shiftright(leaf.{axis}, {coarser}) + 1, {finer}) + if(depth > leaf.depth, 1, 0)"
        return F.explode(F.expr(f"sequence({low}, {high})"))

    last = F.least(F.col("depth") + 2, F.lit(DEEPEST))
    around = (
        leaves.select(F.struct("depth", "ix", "iy").alias("leaf"), F.explode(F.sequence(F.lit(0), last)).alias("depth"))
        .withColumn("ix", around_axis("ix")).withColumn("iy", around_axis("iy"))
    )
    # Coarse cells are near very many leaves, so this join spreads its hot keys.
    reps = (
        lookup_join(around, counts.select("depth", "ix", "iy", "rep"), ["depth", "ix", "iy"])
        .groupBy("leaf").agg(F.collect_set("rep").alias("reps"))
    )
    at = F.array(*[F.lit(d) for d in sorted(depths)]).cast("array<int>")
    placed = located.withColumn("depth", F.explode(at)).withColumns({
        "ix": _at_depth("_ix", DEEPEST), "iy": _at_depth("_iy", DEEPEST),
    })
    members = (
        lookup_join(placed, leaves, ["depth", "ix", "iy"], small=n_leaves <= BROADCAST_ROWS)
        .withColumn("_group", F.pmod(F.xxhash64("x", "y"), F.col("_groups")))
        .groupBy(F.struct("depth", "ix", "iy").alias("leaf"), "_group")
        .agg(F.collect_list(F.struct("site_id", "x", "y")).alias("members"))
    )

    def unzip(array: str, field: str) -> Column:
        return F.transform(array, lambda p: p[field])

    rows = members.join(reps, "leaf").repartition(_tasks(n_sites), "leaf", "_group").select(
        unzip("members", "site_id").alias("ids"), unzip("members", "x").alias("xs"),
        unzip("members", "y").alias("ys"), unzip("reps", "x").alias("rx"), unzip("reps", "y").alias("ry"),
    )
    frame = [(west, south), (east, south), (east, north), (west, north)]

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ox, oy = np.concatenate([row.xs, row.rx]), np.concatenate([row.ys, row.ry])
                for site_id, x, y in zip(row.ids, row.xs.tolist(), row.ys.tolist()):
                    ring = nearest_part(frame, x, y, ox, oy)
                    out.append((site_id, x, y, [v[0] for v in ring], [v[1] for v in ring]))
            yield pd.DataFrame(out, columns=["site_id", "x", "y", "vx", "vy"])

    return rows.mapInPandas(clip, _polygon_columns(dict(sites.dtypes)["site_id"]))


def _with_reach(polygons: DataFrame) -> DataFrame:
    """The box around all circles that pass through the site and are centred on a vertex."""
    radius = F.zip_with("vx", "vy", lambda vx, vy: F.sqrt(
        (vx - F.col("x")) * (vx - F.col("x")) + (vy - F.col("y")) * (vy - F.col("y"))
    ))
    return polygons.withColumn("_r", radius).withColumns({
        "min_x": F.array_min(F.zip_with("vx", "_r", lambda v, r: v - r)),
        "max_x": F.array_max(F.zip_with("vx", "_r", lambda v, r: v + r)),
        "min_y": F.array_min(F.zip_with("vy", "_r", lambda v, r: v - r)),
        "max_y": F.array_max(F.zip_with("vy", "_r", lambda v, r: v + r)),
    })


def _cutting_sites(polygons: DataFrame, sites: DataFrame) -> DataFrame:
    """Per polygon the sites that can still cut it, the deepest first.

    One more than a round applies is kept, as the sign that there are others.
    """
    others = sites.select(F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = points_in_boxes(others, "ox", "oy", _with_reach(polygons), per_side=3)
    # Squared distance to a vertex over the squared radius of its circle: below 1 is inside.
    depth = F.array_min(F.transform(F.arrays_zip("vx", "vy", "_r"), lambda c: F.try_divide(
        (c["vx"] - F.col("ox")) * (c["vx"] - F.col("ox")) + (c["vy"] - F.col("oy")) * (c["vy"] - F.col("oy")),
        c["_r"] * c["_r"],
    )))
    cutting = (
        met.where((F.col("x") != F.col("ox")) | (F.col("y") != F.col("oy")))
        .select("site_id", "ox", "oy", depth.alias("_depth")).where(F.col("_depth") < CUT_MARGIN)
    )
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("_depth", "ox", "oy"))
    return (
        cutting.withColumn("_rank", rank).where(F.col("_rank") <= CUTS_PER_ROUND + 1)
        .groupBy("site_id").agg(F.collect_list("ox").alias("ox"), F.collect_list("oy").alias("oy"))
    )


def site_cells(sites: DataFrame, envelope: Envelope | None = None) -> DataFrame:
    """The part of the envelope nearest to each site: site_id, x, y, vx, vy (vertices in order).

    ``sites(site_id, x, y)``; ids and coordinates are both unique. Cells at the rim end at the
    envelope (default: the box around the sites, grown by a tenth). The result is a
    checkpointed table.
    """
    sites = sites.select("site_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sites = cut_lineage(sites)
    if envelope is None:
        envelope = envelope_of((sites, "x", "y"))
    schema = _polygon_columns(dict(sites.dtypes)["site_id"]) + ", more boolean"

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rings, more = [], []
            for row in batch.itertuples(index=False):
                ring = before = list(zip(row.vx.tolist(), row.vy.tolist()))
                if row.ox is not None:
                    ring = nearest_part(ring, row.x, row.y, row.ox, row.oy)
                rings.append(ring)
                # A site cuts a convex polygon exactly if a vertex is nearer to it, that is if its
                # depth is below 1. Sites come by rising depth, so when the first ones change nothing,
                # their depth is 1 but for rounding, and that of all others is no smaller.
                more.append(row.ox is not None and len(row.ox) > CUTS_PER_ROUND and ring is not before)
            yield pd.DataFrame({
                "site_id": batch["site_id"], "x": batch["x"], "y": batch["y"],
                "vx": [[v[0] for v in ring] for ring in rings],
                "vy": [[v[1] for v in ring] for ring in rings], "more": more,
            })

    n_open, n_ids, n_spots = sites.agg(
        F.count("*"), F.count_distinct("site_id"), F.count_distinct("x", "y")
    ).first()
    if not n_open == n_ids == n_spots:
        raise ValueError("sites need unique ids at distinct coordinates")
    work = cut_lineage(_first_polygons(sites, envelope, n_open))
    done = None
    # Every round cuts every open cell, so the rounds end; the second has few cells left.
    while True:
        cut = work.join(_cutting_sites(work, sites), "site_id", "left").repartition(_tasks(n_open), "site_id")
        cut = cut_lineage(cut.select("site_id", "x", "y", "vx", "vy", "ox", "oy").mapInPandas(clip, schema))
        finished = cut.where("not more").drop("more")
        done = finished if done is None else done.unionByName(finished)
        work = cut.where("more").drop("more")
        n_open = work.count()
        if n_open == 0:
            return done


def cell_edges(cells: DataFrame) -> DataFrame:
    """One row per side of each cell: site_id, edge_no, x1, y1, x2, y2."""
    points = F.arrays_zip("vx", "vy")
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    sides = F.zip_with(points, following, lambda a, b: F.struct(
        a["vx"].alias("x1"), a["vy"].alias("y1"), b["vx"].alias("x2"), b["vy"].alias("y2")
    ))
    return cells.select("site_id", F.posexplode(sides).alias("edge_no", "_e")).select("site_id", "edge_no", "_e.*")


def ring_from_edges(edges: DataFrame, key: str = "site_id") -> DataFrame:
    """One closed clockwise ring per cell from its sides in any order: ``key``, ring.

    Every vertex must end two sides. A cell with exactly two loose ends is open and gets
    the side between them; any other number of loose ends fails the query. Cells are
    convex, so the vertices are put in the order of their angle about their mean.
    """
    ends = edges.select(key, F.explode(F.array(
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    )).alias("v"))
    degrees = ends.groupBy(key, "v").agg(F.count("*").alias("degree"))
    cells = degrees.groupBy(key).agg(
        F.count_if(F.col("degree") == 1).alias("loose"), F.avg("v.x").alias("_cx"), F.avg("v.y").alias("_cy"),
        F.collect_list("v").alias("_vertices"),
    )
    message = F.concat(F.lit("cell with "), F.col("loose").cast("string"), F.lit(" loose ends"))
    checked = cells.where(F.when(F.col("loose").isin(0, 2), True).otherwise(F.raise_error(message).cast("boolean")))
    by_angle = F.array_sort(F.transform("_vertices", lambda v: F.struct(
        (-F.atan2(v["y"] - F.col("_cy"), v["x"] - F.col("_cx"))).alias("turn"), v["x"].alias("x"), v["y"].alias("y")
    )))
    ring = F.transform(by_angle, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return checked.withColumn("_ring", ring).select(
        key, F.concat("_ring", F.slice("_ring", 1, 1)).alias("ring")
    )


def cell_boxes(cells: DataFrame) -> DataFrame:
    """The box around each cell, a hair wider than its vertices."""
    slack = (
        F.array_max("vx") - F.array_min("vx") + F.array_max("vy") - F.array_min("vy")
    ) * F.lit(1e-6)
    return cells.select(
        "site_id", F.col("x").alias("site_x"), F.col("y").alias("site_y"),
        (F.array_min("vx") - slack).alias("min_x"), (F.array_min("vy") - slack).alias("min_y"),
        (F.array_max("vx") + slack).alias("max_x"), (F.array_max("vy") + slack).alias("max_y"),
    )


def nearest_site(
    points: DataFrame, sites: DataFrame, x: str = "longitude", y: str = "latitude",
    cells: DataFrame | None = None,
) -> DataFrame:
    """Each point with its nearest site (``site_id``, ``site_distance``), planar.

    Equally near sites: the smallest site_id. The boxes of the sites' cells give the
    candidates: the nearest site is always among them, and only a few boxes overlap at a
    point, dense area or not. Each distinct coordinate is solved once. ``cells`` are the
    sites' cells if they are at hand; their envelope must hold all points.
    """
    if cells is None:
        cells = site_cells(sites, envelope_of((points, x, y), (sites, "x", "y")))
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).distinct()
    met = points_in_boxes(spots, x, y, cell_boxes(cells))
    dx, dy = F.col(x) - F.col("site_x"), F.col(y) - F.col("site_y")
    best = met.groupBy(x, y).agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "site_id")).alias("_best"))
    found = best.select(x, y, F.col("_best.site_id").alias("site_id"), F.sqrt("_best.d2").alias("site_distance"))
    return spread_join(points, found, [x, y])
