"""Regions: rings, point-in-region join, rent per region, map table.

A region table has one row per ring: region, part, ring_no, ring (array of struct x, y);
x is longitude and y latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import haversine_miles, signed_turns
from ..functions.geo import EARTH_RADIUS_MILES
from ..session import cut_lineage
from .grid import CELL, cell_no, cell_side, join_on_cells, level_for, points_in_boxes
from .listings import with_monthly_rent


# A cell index of up to this many rows (a side each, some tens of megabytes) is broadcast.
BROADCAST_SIDES = 1_000_000


def box_ring(min_x, min_y, max_x, max_y) -> Column:
    """The closed five-point ring of a box, counter-clockwise from its lower left corner."""
    west, south, east, north = (F.col(c) if isinstance(c, str) else c for c in (min_x, min_y, max_x, max_y))
    corners = ((west, south), (east, south), (east, north), (west, north), (west, south))
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def regions_from_boxes(
    boxes: DataFrame, min_x="min_lon", min_y="min_lat", max_x="max_lon", max_y="max_lat"
) -> DataFrame:
    """Box regions as a region table of single rings."""
    return boxes.select(
        "region", F.lit(0).alias("part"), F.lit(0).alias("ring_no"),
        box_ring(min_x, min_y, max_x, max_y).alias("ring"),
    )


def bounding_boxes(regions: DataFrame) -> DataFrame:
    """The box of each region (over all its rings), that box as a closed ring, and its vertices."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return (
        regions.groupBy("region")
        .agg(
            F.min(F.array_min(xs)).alias("min_x"), F.min(F.array_min(ys)).alias("min_y"),
            F.max(F.array_max(xs)).alias("max_x"), F.max(F.array_max(ys)).alias("max_y"),
            F.sum(F.size("ring")).alias("vertices"),
        )
        .withColumn("box", box_ring("min_x", "min_y", "max_x", "max_y"))
    )


def orient_clockwise(regions: DataFrame) -> DataFrame:
    """Reverse the rings that run counter-clockwise; adds nothing else."""
    return regions.withColumn(
        "ring", F.when(signed_turns(F.col("ring")) > 0, F.reverse("ring")).otherwise(F.col("ring"))
    )


def region_edges(regions: DataFrame) -> DataFrame:
    """One row per side of every ring, the side back to the start included.

    Every ring is a path of its own, so parts and holes never get joined up.
    """
    ring = F.col("ring")
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, following, lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
    ))
    edges = regions.where(F.size("ring") > 0).select(
        "region", "part", "ring_no", F.posexplode(sides).alias("edge_no", "edge")
    )
    return edges.select("region", "part", "ring_no", "edge_no", "edge.*").where("x1 <> x2 or y1 <> y2")


def _edge_at(y: Column) -> Column:
    """Where an edge (columns x1, y1, x2, y2, the lower end first) is at height ``y``: monotone in ``y``, never beyond its ends."""
    at = F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    return F.coalesce(F.least(F.greatest(at, F.least("x1", "x2")), F.greatest("x1", "x2")), F.col("x1"))


def _spans(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def _line_above(line: Column, y: Column) -> Column:
    """Does an edge that crosses the vertical at ``line`` do so above height ``y``?

    Summed over all edges of a ring that cross the vertical, this is the number of edges that a ray from
    (line, y) towards growing x crosses, modulo two: of edges further right each vertex counts twice.
    """
    right_end = F.when(F.col("x1") >= line, F.col("y1")).otherwise(F.col("y2"))
    return (_spans(y) & (_edge_at(y) >= line)) != (right_end > y)


def region_cells(regions: DataFrame, rule: str = "union", per_side: int = 8) -> DataFrame:
    """The grid index of a region table: level, cx, cy, region, rings, path, carry, x1, y1, x2, y2, turns.

    A row is one edge in one cell that it passes, or a cell wholly inside (edge null). A ray from a point to the
    right border of its cell, then up along that border, meets the edges of the cell first;
    ``carry`` says whether the edges that cross the border's line further up are odd in number, and ``turns`` whether
    the edge crosses it within the cell. So rows grow with the edges and the cells that they pass, and no row holds
    more than one edge. Regions with many vertices get finer cells; with more cells ``per_side`` of a region fewer
    points need a test, and the index is larger. ``rings`` is how many paths the region has.

    ``rule``: with ``union`` a point is inside when any ring holds it (holes count as
    inside); with ``even_odd`` all rings of a region are counted together, as one path.

    Write the result as a table to use it for many joins (``assign_regions(cells=...)``).
    """
    if rule not in ("union", "even_odd"):
        raise ValueError("rule must be union or even_odd")
    sizes = bounding_boxes(regions)
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    wanted = F.greatest(F.lit(float(per_side)), F.sqrt(F.col("vertices")))
    paths = regions.groupBy("region").agg(F.count_distinct("part", "ring_no").alias("_rings"))
    rings = F.lit(1) if rule == "even_odd" else F.col("_rings").cast("int")
    levels = sizes.join(paths, "region").select("region", level_for(extent, wanted).alias("level"), rings.alias("rings"))

    level, side = F.col("level"), cell_side(F.col("level"))
    up = F.col("y1") <= F.col("y2")
    lower, upper = ([F.when(up, F.col(a)).otherwise(F.col(b)).alias(name) for a, b, name in ends] for ends in (
        (("x1", "x2", "x1"), ("y1", "y2", "y1")), (("x2", "x1", "x2"), ("y2", "y1", "y2"))))
    path = F.lit("") if rule == "even_odd" else F.concat_ws(" ", "part", "ring_no")
    edges = region_edges(regions).select("region", path.alias("path"), *lower, *upper).join(levels, "region")
    # A level edge is crossed by verticals only, below it; it lies in the strip that ends at it or holds it.
    flat = F.col("y1") == F.col("y2")
    below = F.ceil(F.col("y1") / side).cast("bigint") - 1
    strips = edges.withColumn("cy", F.explode(F.sequence(
        F.when(flat, below).otherwise(cell_no(F.col("y1"), level)), F.when(flat, below).otherwise(cell_no(F.col("y2"), level)))))
    floor_y, top_y = F.col("cy") * side, (F.col("cy") + 1) * side
    first = F.when(F.col("y1") >= floor_y, F.col("x1")).otherwise(_edge_at(floor_y))
    last = F.when(F.col("y2") <= top_y, F.col("x2")).otherwise(_edge_at(top_y))
    reach = _edge_at(F.least(F.col("y2"), top_y))
    passed = strips.withColumn("cx", F.explode(F.sequence(
        cell_no(F.least(first, last, reach), level), cell_no(F.greatest(first, last, reach), level))))
    line = (F.col("cx") + 1) * side
    crosses_line = (F.col("x1") >= line) != (F.col("x2") >= line)
    turns = crosses_line & _line_above(line, floor_y) & ~_line_above(line, top_y)
    placed = passed.withColumn("turns", turns)

    # Per column of cells, how many edges cross its right line in higher cells, and the next higher cell with an edge.
    column = ("region", "path", "cx")
    found = placed.groupBy(*column, "cy", "level", "rings").agg(F.count_if("turns").alias("_turns"))
    higher = Window.partitionBy(*column).orderBy(F.desc("cy"))
    carried = found.withColumns({
        "carry": (F.coalesce(F.sum("_turns").over(higher.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).cast("int"),
        "_next": F.lag("cy").over(higher)})
    border = placed.join(carried.select(*column, "cy", "carry"), [*column, "cy"])
    gap = F.sequence(F.col("cy") + 1, F.col("_next") - 1)
    inner = carried.where("carry = 1 AND _next > cy + 1").withColumn("cy", F.explode(gap))
    columns = [*CELL, "region", "rings", "path", "carry"]
    ends = ("x1", "y1", "x2", "y2")
    return border.select(*columns, *ends, "turns").unionByName(
        inner.select(*columns, *[F.lit(None).cast("double").alias(e) for e in ends], F.lit(False).alias("turns")))


def assign_regions(
    points: DataFrame, regions: DataFrame | None = None, cells: DataFrame | None = None,
    x: str = "longitude", y: str = "latitude", rule: str = "union", max_broadcast: int = BROADCAST_SIDES,
) -> DataFrame:
    """Each point with each region that holds it (a column ``region`` is added).

    A point may lie in several regions; regions and points without a match are absent.
    Borders are half-open: lower and left borders are inside, upper and right are not.
    Points in a cell with edges have their crossings summed per point and ring, partly before the shuffle.
    """
    if cells is None:
        # Written once: the size check and the join both read it.
        cells = cut_lineage(region_cells(regions, rule))
    several = not cells.where("rings > 1").isEmpty()
    own = F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point")
    at = points.select(own, F.col(x).alias("_x"), F.col(y).alias("_y"), F.monotonically_increasing_id().alias("_row"))
    met = join_on_cells(at, "_x", "_y", cells.withColumn("_line", (F.col("cx") + 1) * cell_side(F.col("level"))), max_rows=max_broadcast)
    met = met.withColumn("_inner", F.col("x1").isNull())
    px, py, line = F.col("_x"), F.col("_y"), F.col("_line")
    here = _edge_at(py)
    crossed = (_spans(py) & (px < here) & (here < line)).cast("int") + (F.col("turns") & _line_above(line, py)).cast("int")
    # Cells wholly inside need no test, and no shuffle where a region is one ring.
    alone = F.col("_inner") & (F.col("rings") == 1)
    odd = met.where(~alone).groupBy("_row", "region", "path").agg(
        F.first("_point").alias("_point"), (F.max("carry") + F.coalesce(F.sum(crossed), F.lit(0))).alias("_n")).where("_n % 2 = 1")
    if several:
        odd = odd.dropDuplicates(["_row", "region"])
    return met.where(alone).select("_point.*", "region").unionByName(odd.select("_point.*", "region"))


def rent_by_region(assigned: DataFrame) -> DataFrame:
    """Mean monthly rent, priced and unpriced listings per region.

    Regions without any priced listing are left out. Sums are folded before the shuffle.
    """
    if "monthly_rent" not in assigned.columns:
        assigned = with_monthly_rent(assigned)
    return (
        assigned.groupBy("region")
        .agg(
            F.avg("monthly_rent").alias("mean_rent"), F.count("monthly_rent").alias("priced"),
            F.count_if(F.col("monthly_rent").isNull()).alias("unpriced"),
        )
        .where("priced > 0")
    )


def rent_range(means: DataFrame, max_price: float | None = None) -> DataFrame:
    """One row: lowest and highest mean, and the colour cap. No rows without means."""
    cap = F.max("mean_rent") if max_price is None else F.least(F.max("mean_rent"), F.lit(float(max_price)))
    return means.agg(
        F.min("mean_rent").alias("min_price"), F.max("mean_rent").alias("observed_max"), cap.alias("max_price")
    ).where("min_price is not null")


def rent_map_table(regions: DataFrame, means: DataFrame, max_price: float | None = None) -> DataFrame:
    """Every region with its mean, its share of the colour cap (at most 1) and its label."""
    cap = rent_range(means, max_price).select("max_price").scalar()
    every = regions.select("region").distinct()
    # format_number rounds the exact binary value, half to even; its thousands marks go.
    pounds = F.replace(F.format_number("mean_rent", 2), F.lit(","), F.lit(""))
    label = F.concat("region", F.lit("\n£"), pounds, F.lit(" pcm"))
    return every.join(means.select("region", "mean_rent"), "region", "left").select(
        "region", "mean_rent",
        F.when(F.col("mean_rent").isNotNull(), F.least(F.col("mean_rent") / cap, F.lit(1.0))).alias("shade"),
        F.coalesce(label, F.col("region")).alias("label"),
    )


def within_miles(
    df: DataFrame, places: DataFrame, miles: float, regions: DataFrame | None = None
) -> DataFrame:
    """Each listing with each place (column ``name``) at most ``miles`` away, and ``miles_away``.

    Radius 0 means inside the place's own area: ``regions`` whose region is the place's
    name. Circles may reach over the 180th meridian.
    """
    if miles == 0:
        if regions is None:
            raise ValueError("radius 0 needs the places' areas")
        areas = regions.join(places.select(F.col("name").alias("region")), "region", "left_semi")
        return assign_regions(df, areas).withColumnRenamed("region", "name").withColumn("miles_away", F.lit(0.0))
    # A hair wider than the circle, so that rounding never cuts off a listing.
    reach = math.degrees(miles / EARTH_RADIUS_MILES) * (1 + 1e-9)
    lat, lon = F.col("_plat"), F.col("_plon")
    # Widest half-angle of longitude of a circle of angular radius ``reach`` at this latitude.
    ratio = F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(lat))
    widen = F.when((F.abs(lat) + reach < 90) & (ratio < 1), F.degrees(F.asin(ratio)) * (1 + 1e-9)).otherwise(360.0)
    # A box that leaves the map on one side comes in again on the other. One that goes all the way
    # round stays single, so that no listing meets it twice.
    turns = F.when(widen >= 180, F.array(F.lit(0.0))).otherwise(F.array(*map(F.lit, (-360.0, 0.0, 360.0))))
    turned = places.select("name", F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon")).withColumn(
        "_turn", F.explode(turns))
    boxes = turned.withColumns({
        "min_x": lon - widen + F.col("_turn"), "max_x": lon + widen + F.col("_turn"), "min_y": lat - reach, "max_y": lat + reach,
    }).where("min_x <= 180 and max_x >= -180").drop("_turn")
    met = points_in_boxes(df, "longitude", "latitude", boxes)
    return (
        met.withColumn("miles_away", haversine_miles("latitude", "longitude", "_plat", "_plon"))
        .where(F.col("miles_away") <= miles)
        .drop("_plat", "_plon", "min_x", "max_x", "min_y", "max_y")
    )
