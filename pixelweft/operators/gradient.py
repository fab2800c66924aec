"""Gradient fill: nearest border, the border opposite of it, interpolation between both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.plans.fixpoint import settle
from pixelweft.schema import CROSS, VOID

from .spatial import boxes, in_cells, near_cells, prefixed
from .stencil import neighbor_values


def value_borders(grid: DataFrame) -> DataFrame:
    """(image_id, value, bvalue, by, bx): pixels of other values beside the pixels of a value; void ones don't count."""
    n = neighbor_values(grid, CROSS).where((F.col("value") != VOID) & (F.col("nvalue") != VOID) & (F.col("value") != F.col("nvalue")))
    return n.select("image_id", "value", F.col("nvalue").alias("bvalue"), F.col("ny").alias("by"), F.col("nx").alias("bx")).distinct()


def nearest_borders(grid: DataFrame) -> DataFrame:
    """(image_id, y, x, value, cvalue, cy, cx): the nearest border pixel, by (value, y, x) on a tie.

    Cells of pixels are compared with cells of border pixels first; only cells that can hold the nearest are searched.
    """
    keys = ["image_id", "value"]
    own, border = grid.where(F.col("value") != VOID), value_borders(grid)
    held = border.select(*keys, "bvalue", F.col("by").alias("y"), F.col("bx").alias("x"))
    left = prefixed(boxes(own, keys), "l_", keys)
    cells = near_cells(left, prefixed(boxes(held, keys), "r_", keys), keys, [*keys, "l_cell_y", "l_cell_x"])
    p = prefixed(in_cells(own), "l_", [*keys, "y", "x"])
    b = prefixed(in_cells(held), "r_", [*keys, "bvalue"]).withColumnRenamed("r_y", "by").withColumnRenamed("r_x", "bx")
    s = cells.join(p, [*keys, "l_cell_y", "l_cell_x"]).join(b, [*keys, "r_cell_y", "r_cell_x"])
    d2 = (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")) + (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx"))
    near = s.groupBy("image_id", "y", "x", "value").agg(F.min(F.struct(d2.alias("d2"), "bvalue", "by", "bx")).alias("c"))
    return near.select("image_id", "y", "x", "value", F.col("c.bvalue").alias("cvalue"), F.col("c.by").alias("cy"), F.col("c.bx").alias("cx"))


def fill(grid: DataFrame) -> DataFrame:
    """(image_id, y, x, value, filled): each pixel's interpolated value.

    The opposite anchor is the nearest border pixel within two pixels of the ray that leaves the first anchor behind;
    if there is none, the nearest one at all, which is the first anchor again. All tests are in whole numbers. Cells
    of border pixels that the ray's strip can't meet are left out first. If both anchors are lighter or both darker
    than the pixel's value, the point halfway with that value takes the place of the second. Anchor values are
    averaged with the pixel's own, and weigh 1 - d / sum(d).
    """
    near = settle(nearest_borders(grid), "nearest-borders")
    held = in_cells(value_borders(grid).withColumn("y", F.col("by")).withColumn("x", F.col("bx")))
    cells = held.groupBy("image_id", "value", "cell_y", "cell_x").agg(F.min("by").alias("y0"), F.max("by").alias("y1"), F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.collect_list(F.struct("bvalue", "by", "bx")).alias("held"))
    ay, ax = F.col("cy") - F.col("y"), F.col("cx") - F.col("x")
    my, mx = (F.col("y0") + F.col("y1")) / 2 - F.col("y"), (F.col("x0") + F.col("x1")) / 2 - F.col("x")
    size = F.sqrt((ay * ay + ax * ax).cast("double"))
    radius = F.sqrt(F.pow((F.col("y1") - F.col("y0")) / 2, 2) + F.pow((F.col("x1") - F.col("x0")) / 2, 2)) + F.lit(1e-6)
    meets = (F.abs(ay * mx - ax * my) <= size * (radius + 2)) & (ay * my + ax * mx <= size * radius)
    s = near.join(cells, ["image_id", "value"]).where(meets).select(*near.columns, F.explode("held").alias("b")).select(*near.columns, "b.*")
    ry, rx = F.col("by") - F.col("y"), F.col("bx") - F.col("x")
    c2, d2 = (ay * ay + ax * ax).cast("long"), (ry * ry + rx * rx).cast("long")
    dot = -(ay * ry + ax * rx).cast("long")
    within = ((d2 - 4) * c2 <= dot * dot) & (dot >= 0)
    found = s.where(within).groupBy("image_id", "y", "x").agg(F.min(F.struct(d2.alias("d2"), "bvalue", "by", "bx")).alias("o"))
    best = near.join(found, ["image_id", "y", "x"], "left")
    best = best.withColumn("ov", F.coalesce("o.bvalue", "cvalue")).withColumn("oy", F.coalesce("o.by", "cy").cast("double")).withColumn("ox", F.coalesce("o.bx", "cx").cast("double"))
    v = F.col("value")
    middle = ((F.col("cvalue") > v) & (F.col("ov") > v)) | ((F.col("cvalue") < v) & (F.col("ov") < v))
    best = best.select("image_id", "y", "x", "value", ((F.col("cvalue") + v) / 2).alias("v1"), "cy", "cx", F.when(middle, v.cast("double")).otherwise((F.col("ov") + v) / 2).alias("v2"), F.when(middle, (F.col("cy") + F.col("oy")) / 2).otherwise(F.col("oy")).alias("oy"), F.when(middle, (F.col("cx") + F.col("ox")) / 2).otherwise(F.col("ox")).alias("ox"))
    dist = lambda a, b: F.sqrt((F.col("y") - F.col(a)) * (F.col("y") - F.col(a)) + (F.col("x") - F.col(b)) * (F.col("x") - F.col(b)))
    best = best.withColumn("d1", dist("cy", "cx")).withColumn("d2", dist("oy", "ox"))
    total = F.col("d1") + F.col("d2")
    return best.select("image_id", "y", "x", "value", F.round(F.col("v1") * (1 - F.col("d1") / total) + F.col("v2") * (1 - F.col("d2") / total), 6).alias("filled"))
