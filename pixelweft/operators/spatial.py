"""Nearest, range and pattern joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Side of the square cells by which nearest joins leave out what is too far away.
CELL = 8


def in_cells(points: DataFrame) -> DataFrame:
    return points.withColumn("cell_y", F.floor(F.col("y") / CELL)).withColumn("cell_x", F.floor(F.col("x") / CELL))


def boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell_y, cell_x, y0, y1, x0, x1): the box of the points of each cell that has some."""
    return in_cells(points).groupBy(*keys, "cell_y", "cell_x").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def box_distances(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest squared distance that points of two boxes, named by their prefixes, can have."""
    c = F.col
    gap = lambda k: F.greatest(c(f"{a}{k}0") - c(f"{b}{k}1"), c(f"{b}{k}0") - c(f"{a}{k}1"), F.lit(0))
    reach = lambda k: F.greatest(c(f"{a}{k}1") - c(f"{b}{k}0"), c(f"{b}{k}1") - c(f"{a}{k}0"))
    return gap("y") * gap("y") + gap("x") * gap("x"), reach("y") * reach("y") + reach("x") * reach("x")


def near_cells(left: DataFrame, right: DataFrame, on: list[str], per: list[str], which: Column | None = None) -> DataFrame:
    """Pairs of cells (boxes with prefixes l_ and r_) that can hold a nearest pair of their group `per`."""
    least, most = box_distances("l_", "r_")
    pairs = left.join(right, on)
    pairs = (pairs if which is None else pairs.where(which)).withColumn("__least", least).withColumn("__most", most)
    return pairs.withColumn("__best", F.min("__most").over(Window.partitionBy(*per))).where("__least <= __best").drop("__least", "__most", "__best")


def prefixed(rows: DataFrame, prefix: str, kept: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c in kept else prefix + c) for c in rows.columns])


def nearest_pairs(points: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(keys, a, b, d2, ay, ax, by, bx): the closest points of every two groups, by (y, x) on a tie.

    Cells are compared first: a pair of cells whose boxes are farther apart than another pair's points can be is left
    out, and only the points of the others are.
    """
    b = boxes(points, [*keys, group])
    left, right = prefixed(b.withColumnRenamed(group, "a"), "l_", [*keys, "a"]), prefixed(b.withColumnRenamed(group, "b"), "r_", [*keys, "b"])
    cells = near_cells(left, right, keys, [*keys, "a", "b"], F.col("a") < F.col("b"))
    p = in_cells(points.select(*keys, group, "y", "x"))
    x = p.select(*keys, F.col(group).alias("a"), F.col("y").alias("ay"), F.col("x").alias("ax"), F.col("cell_y").alias("l_cell_y"), F.col("cell_x").alias("l_cell_x"))
    y = p.select(*keys, F.col(group).alias("b"), F.col("y").alias("by"), F.col("x").alias("bx"), F.col("cell_y").alias("r_cell_y"), F.col("cell_x").alias("r_cell_x"))
    d2 = (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")) + (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx"))
    both = cells.join(x, [*keys, "a", "l_cell_y", "l_cell_x"]).join(y, [*keys, "b", "r_cell_y", "r_cell_x"])
    best = both.groupBy(*keys, "a", "b").agg(F.min(F.struct(d2.alias("d2"), "ay", "ax", "by", "bx")).alias("m"))
    return best.select(*keys, "a", "b", "m.d2", "m.ay", "m.ax", "m.by", "m.bx")


def rect_contacts(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): rectangles (rect_id, top, left, bottom, right; ends included) that touch, corners too.

    One side of each contact is a key, the end of one next to the start of the other; only the other axis is a range.
    """
    a, b = rects.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("rect_id", "top", "left", "bottom", "right")]), rects.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("rect_id", "top", "left", "bottom", "right")])
    down = a.withColumn("k", F.col("a_bottom") + 1).join(b.withColumn("k", F.col("b_top")), [*keys, "k"]).where("a_left <= b_right + 1 AND b_left <= a_right + 1")
    side = a.withColumn("k", F.col("a_right") + 1).join(b.withColumn("k", F.col("b_left")), [*keys, "k"]).where("a_top <= b_bottom + 1 AND b_top <= a_bottom + 1")
    both = down.select(*keys, "a_rect_id", "b_rect_id").unionByName(side.select(*keys, "a_rect_id", "b_rect_id"))
    return both.select(*keys, F.least("a_rect_id", "b_rect_id").alias("a"), F.greatest("a_rect_id", "b_rect_id").alias("b")).distinct()


def rects_in_window(rects: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    return rects.where((F.col("top") <= bottom) & (F.col("bottom") >= top) & (F.col("left") <= right) & (F.col("right") >= left))


def substitute(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replaces values by a table (source, target); others stay."""
    m = mapping.select(F.col("source").alias("__s"), F.col("target").alias("__t"))
    return rows.join(m, F.col(column) == F.col("__s"), "left").withColumn(column, F.coalesce("__t", column)).drop("__s", "__t")


def pattern_codes(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, code): the 5 x 5 surroundings of each pixel among the listed ones as 24 bits, the middle left out."""
    steps = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if (dy, dx) != (0, 0)]
    at = points.select(*keys, "y", "x").distinct()
    s = F.explode(F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(steps)]))
    beside = at.withColumn("s", s).select(*keys, (F.col("y") - F.col("s.dy")).alias("y"), (F.col("x") - F.col("s.dx")).alias("x"), F.col("s.bit").alias("bit"))
    return at.join(beside, [*keys, "y", "x"], "left").groupBy(*keys, "y", "x").agg(F.coalesce(F.sum("bit"), F.lit(0)).cast("int").alias("code"))
