"""Point tables: grids, pictures of points, filters by direction, lookups, ranks and edits of ordered lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.schema import CROSS, RING, VOID, around, dealt

# --- grids and pictures ------------------------------------------------------------------------------------------------


def full_grid(sizes: DataFrame) -> DataFrame:
    """Every (y, x) of grids (keys, height, width); a grid without rows or columns has none."""
    keys = [c for c in sizes.columns if c not in ("height", "width")]
    rows = sizes.where("height > 0 AND width > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return rows.select(*keys, "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def scatter(sizes: DataFrame, points: DataFrame, value: str, default: int = VOID) -> DataFrame:
    """Full grids with the value of each listed point, and a default elsewhere."""
    keys = [c for c in sizes.columns if c not in ("height", "width")]
    return full_grid(sizes).join(points.select(*keys, "y", "x", value), [*keys, "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def picture(sizes: DataFrame, points: DataFrame, color: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """(image_id, y, x, r, g, b, a): listed points in a colour, the others black; `to_png` makes files of it."""
    marks = points.select("image_id", "y", "x").distinct().withColumn("__on", F.lit(True))
    rows = full_grid(sizes).join(dealt(marks), ["image_id", "y", "x"], "left")
    paint = [F.when(F.col("__on"), F.lit(v)).otherwise(F.lit(0)).alias(c) for c, v in zip("rgb", color, strict=True)]
    return rows.select("image_id", "y", "x", *paint, F.lit(255).alias("a"))


def sizes_of(pixels: DataFrame) -> DataFrame:
    """(image_id, height, width) of pixel tables that begin at (0, 0)."""
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


# --- filters -----------------------------------------------------------------------------------------------------------


def border_pixels(region_pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, y, x): pixels that differ from one of four neighbours; beyond the image lies region -1."""
    other = region_pixels.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("region_id").alias("__other"))
    n = around(region_pixels.select("image_id", "y", "x", "region_id"), CROSS).join(dealt(other), ["image_id", "ny", "nx"], "left")
    return n.where(F.coalesce("__other", F.lit(VOID)) != F.col("region_id")).select("image_id", "region_id", "y", "x").distinct()


def cell_edges(points: DataFrame, size: int) -> DataFrame:
    """Points in the first or last row or column of their square cell."""
    y, x = F.pmod("y", F.lit(size)), F.pmod("x", F.lit(size))
    return points.where(y.isin(0, size - 1) | x.isin(0, size - 1))


def cell_crossings(points: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Points with one of eight listed neighbours in another cell."""
    listed = points.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx")).distinct()
    cell = lambda c: F.floor(F.col(c) / size)
    near = around(points.select(*keys, "y", "x").distinct(), RING).where((cell("y") != cell("ny")) | (cell("x") != cell("nx")))
    return near.join(listed, [*keys, "ny", "nx"], "left_semi").select(*keys, "y", "x").distinct()


def beyond_angle(points: DataFrame, keys: list[str], direction: DataFrame, cutoff: float) -> DataFrame:
    """Points (keys, dy, dx) whose direction turns by more than `cutoff` from their group's (keys, uy, ux).

    A point without a direction is no outlier.
    """
    far = F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))
    cos = (F.col("dy") * F.col("uy") + F.col("dx") * F.col("ux")) / F.when(far > 0, far)
    return points.join(direction, keys).where(F.round(cos, 9) < F.lit(round(math.cos(cutoff), 9))).drop("uy", "ux")


def unsearched(points: DataFrame, searched: DataFrame, keys: list[str]) -> DataFrame:
    """Points that aren't among those searched."""
    return points.join(searched.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")


# --- direction-weighted choice -----------------------------------------------------------------------------------------


def weight_shape(penalty: float, dropoff: float = 5.0) -> tuple[float, float, float]:
    """(a, b, ln c) such that a + b * exp(dot * ln c) is 1 at dot 1, `dropoff` at 0.5 and penalty - 0.5 at 0.

    ln c is 0 where no curve goes through all three, or a line does: then a + b * dot goes through the outer two.
    """
    side = penalty - 0.5
    c = ((1 - dropoff) / (dropoff - side)) ** 2 if abs(dropoff - side) > 1e-9 else 1.0
    if c <= 0 or abs(c - 1) < 1e-9:
        return side, 1 - side, 0.0
    b = (side - 1) / (1 - c)
    return side - b, b, math.log(c)


def direction_weight(dot: Column, penalty: float, dropoff: float = 5.0) -> Column:
    """Weight of a cut that turns by acos(dot): (1 - dot) / 2 and the curve of `weight_shape`."""
    a, b, f = weight_shape(penalty, dropoff)
    return (1 - dot) / 2 + F.lit(a) + F.lit(b) * (F.exp(dot * F.lit(f)) if f else dot)


def forward_nearest(rays: DataFrame, targets: DataFrame, keys: list[str], penalty: float) -> DataFrame:
    """The target ahead of each ray at the least distance * exp(-cos * ln penalty), cos being of the turn to it.

    rays: (keys, y0, x0, y1, x1), from the first point to the second; targets: (keys, y, x). A ray with nothing ahead
    has no row. Ties go to the lesser (y, x).
    """
    ry, rx, ty, tx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"), F.col("y") - F.col("y1"), F.col("x") - F.col("x1")
    far, ray = F.sqrt((ty * ty + tx * tx).cast("double")), F.sqrt((ry * ry + rx * rx).cast("double"))
    cos = (ry * ty + rx * tx) / (F.when(far > 0, far) * F.when(ray > 0, ray))
    ahead = rays.join(targets.select(*keys, "y", "x"), keys).where(ry * ty + rx * tx > 0)
    cost = F.round(far * F.exp(-cos * F.lit(math.log(penalty))), 9)
    best = ahead.groupBy(*keys, "y0", "x0", "y1", "x1").agg(F.min(F.struct(cost.alias("cost"), "y", "x")).alias("m"))
    return best.select(*keys, "y0", "x0", "y1", "x1", "m.y", "m.x", "m.cost")


# --- lookups -----------------------------------------------------------------------------------------------------------


def sublist_of(lists: DataFrame) -> DataFrame:
    """(y, x, list_id): which list holds each point; lists: (list_id, points array<struct<y, x>>). The first one wins."""
    each = lists.select("list_id", F.explode("points").alias("p"))
    return each.groupBy("p.y", "p.x").agg(F.min("list_id").alias("list_id")).select("y", "x", "list_id")


def code_of(points: DataFrame, codes: DataFrame, out: str = "vertex_id") -> DataFrame:
    """Points with their code in a table (y, x, code), -1 if they have none."""
    return points.join(codes.select("y", "x", F.col(out).alias("__code")), ["y", "x"], "left").withColumn(out, F.coalesce("__code", F.lit(-1))).drop("__code")


def induced_subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges (a, b) between kept nodes, which are numbered anew by rank: kept (node, rank)."""
    a, b = kept.select(F.col("node").alias("a"), F.col("rank").alias("ra")), kept.select(F.col("node").alias("b"), F.col("rank").alias("rb"))
    return edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def junctions(region_pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, others): pixels with more than one other region among eight neighbours; void and -1 count."""
    other = region_pixels.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("region_id").alias("__other"))
    n = around(region_pixels.select("image_id", "y", "x", "region_id"), RING).join(other, ["image_id", "ny", "nx"], "left")
    n = n.withColumn("__other", F.coalesce("__other", F.lit(VOID))).where("__other <> region_id")
    return n.groupBy("image_id", "y", "x").agg(F.countDistinct("__other").alias("others")).where("others > 1")


# --- ranks -------------------------------------------------------------------------------------------------------------


def rank_of(rows: DataFrame, keys: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    """The place of each row in the order of its group, from 0."""
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def least_per(rows: DataFrame, keys: list[str], loss: str, ties: list[str]) -> DataFrame:
    """The row of the least loss in each group, by `ties` if it is shared."""
    return rank_of(rows, keys, [loss, *ties], "__r").where("__r = 0").drop("__r")


def valid_first(points: DataFrame, keys: list[str], valid: Column, room: int) -> DataFrame:
    """The first `room` points of each group, valid ones before the others, each in their order; a top-k by design."""
    return rank_of(points.withColumn("valid", valid), keys, [F.desc("valid"), "pos"], "place").where(F.col("place") < room)


# --- ordered lists -----------------------------------------------------------------------------------------------------


def insert_after(points: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """(key, pos, y, x) with new rows put after the position that each names, numbered anew from 0."""
    both = points.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return rank_of(both, [key], ["pos", "__new", "y", "x"], "__p").select(key, F.col("__p").alias("pos"), "y", "x")


def delete_at(points: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """(key, pos, y, x) without the positions (key, pos), numbered anew from 0."""
    left = points.join(gone.select(key, "pos"), [key, "pos"], "left_anti")
    return rank_of(left, [key], ["pos"], "__p").select(key, F.col("__p").alias("pos"), "y", "x")


def sorted_insert(held: DataFrame, new: DataFrame) -> DataFrame:
    """(rank, y, x) of both tables' points, each once, in the order (y, x)."""
    from .mesh import rank_bucketed

    return rank_bucketed(held.select("y", "x").union(new.select("y", "x")).distinct(), ["y", "x"], "rank", "y").select("rank", "y", "x")


def list_edits(points: DataFrame, key: str) -> DataFrame:
    """(key, rolled, sliced, flipped, inserted): the edits of an array of points that the kernels use, as text.

    rolled: by one place; sliced: the second to the fourth; flipped: last first; inserted: the middle of the first
    edge, cut to whole numbers, behind the first point.
    """
    p = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "y", "x"))).alias("p"))
    show = lambda a: F.concat_ws(" ", F.transform(a, lambda s: F.concat_ws(",", s["y"].cast("string"), s["x"].cast("string"))))
    middle = lambda c: ((F.col("p")[0][c] + F.col("p")[1][c]) / 2).cast("int")
    n = F.size("p")
    rolled = F.concat(F.slice("p", n, F.lit(1)), F.slice("p", F.lit(1), n - 1))
    inserted = F.array_insert("p", F.lit(2), F.struct(F.lit(0).alias("pos"), middle("y").alias("y"), middle("x").alias("x")))
    return p.select(key, show(rolled).alias("rolled"), show(F.slice("p", 2, 3)).alias("sliced"), show(F.reverse("p")).alias("flipped"), show(inserted).alias("inserted"))
