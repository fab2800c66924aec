"""Neighbour joins over pixel tables: every lookup is an equi-join on shifted keys within an image."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.schema import CROSS, RING, VOID, around, dealt


def neighbor_values(grid: DataFrame, steps: tuple = RING, value: str = "value", points: DataFrame | None = None) -> DataFrame:
    """(image_id, y, x, value, i, ny, nx, nvalue): the value at each neighbour, -1 outside."""
    at = around(grid if points is None else points, steps)
    other = grid.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(value).alias("nvalue"))
    return at.join(other, ["image_id", "ny", "nx"], "left").withColumn("nvalue", F.coalesce("nvalue", F.lit(VOID)))


def match_counts(grid: DataFrame) -> DataFrame:
    """(image_id, y, x, n): how many of eight neighbours have the pixel's value; void pixels are left out."""
    n = neighbor_values(grid).where(F.col("value") != VOID)
    return n.groupBy("image_id", "y", "x").agg(F.sum((F.col("value") == F.col("nvalue")).cast("int")).alias("n"))


def _ring_linked(i: int, j: int) -> bool:
    """Cells of the ring that touch: next to each other, or two cells that share a side with the middle."""
    d = min((i - j) % 8, (j - i) % 8)
    return d == 1 or (d == 2 and i % 2 == 0 and j % 2 == 0)


def ring_components(mask: int) -> int:
    """Parts of the ring when touching cells of equal status are joined."""
    label = list(range(8))
    for _ in range(8):
        for i, j in combinations(range(8), 2):
            if _ring_linked(i, j) and (mask >> i & 1) == (mask >> j & 1):
                label[i] = label[j] = min(label[i], label[j])
    return len(set(label))


def geometry_issues(grid: DataFrame) -> DataFrame:
    """(image_id, y, x, reason): line tips (one equal neighbour) and single-width lines (two, in a split ring).

    The ring of each pixel is a mask of eight bits; a table of the masks that fail, computed once, decides.
    """
    bad = [m for m in range(256) if bin(m).count("1") == 2 and ring_components(m) != 2]
    n = neighbor_values(grid).where(F.col("value") != VOID)
    masks = n.groupBy("image_id", "y", "x").agg(F.sum(F.when(F.col("value") == F.col("nvalue"), F.expr("shiftleft(1, i)")).otherwise(0)).alias("mask"))
    reason = F.when(F.bit_count("mask") == 1, "tip").when(F.col("mask").isin(bad), "line")
    return masks.select("image_id", "y", "x", reason.alias("reason")).where("reason IS NOT NULL")


def highlight(pixels: DataFrame, issues: DataFrame) -> DataFrame:
    """The picture with failed pixels in red."""
    marks = issues.select("image_id", "y", "x").distinct().withColumn("bad", F.lit(True))
    out = pixels.join(marks, ["image_id", "y", "x"], "left")
    paint = lambda c, v: F.when(F.col("bad"), F.lit(v)).otherwise(F.col(c)).alias(c)
    return out.select("image_id", "y", "x", paint("r", 255), paint("g", 0), paint("b", 0), paint("a", 255))


def drawn_border(region_pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, other_id, y, x): border pixels of each pair, on the side that owns the border.

    Of two regions the larger id owns it; a region that isn't void owns it against a void one.
    """
    own = region_pixels.select("image_id", "y", "x", "region_id", "value")
    other = own.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("region_id").alias("other_id"), F.col("value").alias("nvalue"))
    n = around(own, CROSS).join(dealt(other), ["image_id", "ny", "nx"]).where("region_id <> other_id")
    solid, osolid = F.col("value") != VOID, F.col("nvalue") != VOID
    owns = F.when(solid & osolid, F.col("region_id") > F.col("other_id")).otherwise(solid & ~osolid)
    return n.where(owns).select("image_id", "region_id", "other_id", "y", "x").distinct()


def owned_border(region_pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, other_id, y, x, n): border pixels by owner with multiplicity.

    From pixel p of region o to a neighbour q of region m: (o, m, q) if m > o and neither is void; (m, o, q) if o is
    void and m isn't. Pixels in row 0 or column 0 border -1 themselves.
    """
    own = region_pixels.select("image_id", "y", "x", F.col("region_id").alias("o"), F.col("value").alias("vo"))
    other = region_pixels.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("region_id").alias("m"), F.col("value").alias("vm"))
    n = around(own, CROSS).join(other, ["image_id", "ny", "nx"]).where("o <> m")
    up = F.expr("m > o AND vo >= 0 AND vm >= 0")
    out = F.expr("vo = -1 AND vm <> -1")
    pairs = n.where(up | out).select("image_id", F.when(up, F.col("o")).otherwise(F.col("m")).alias("region_id"), F.when(up, F.col("m")).otherwise(F.col("o")).alias("other_id"), F.col("ny").alias("y"), F.col("nx").alias("x"))
    edge = own.where("y = 0 OR x = 0").select("image_id", F.col("o").alias("region_id"), F.lit(VOID).alias("other_id"), "y", "x")
    return pairs.unionByName(edge).groupBy("image_id", "region_id", "other_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def outward_border(region_pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, y, x, n): pixels of other regions next to each region, as often as they touch it."""
    own = region_pixels.select("image_id", "y", "x", "region_id")
    other = own.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("region_id").alias("m"))
    n = around(own, CROSS).join(dealt(other), ["image_id", "ny", "nx"]).where("region_id <> m")
    return n.groupBy("image_id", "region_id", F.col("ny").alias("y"), F.col("nx").alias("x")).agg(F.count(F.lit(1)).alias("n"))


def adjacency(points: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, y, x, ny, nx) between listed pixels that touch, per key."""
    other = points.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx")).distinct()
    return around(points.select(*keys, "y", "x").distinct(), RING).join(dealt(other), [*keys, "ny", "nx"], "left_semi").select(*keys, "y", "x", "ny", "nx")


def tiled_adjacency(points: DataFrame, keys: list[str], size: int = 16) -> DataFrame:
    """The edges of `adjacency`, tile by tile: a point lies in its own tile and in those that it is a neighbour of."""
    p = points.select(*keys, "y", "x").distinct()
    tile = lambda c: F.floor(F.col(c) / size)
    own = p.withColumn("ty", tile("y")).withColumn("tx", tile("x"))
    near = around(p, RING).select(*keys, "y", "x", tile("ny").alias("ty"), tile("nx").alias("tx")).union(own).distinct()
    a, b = own, near.select(*keys, "ty", "tx", F.col("y").alias("ny"), F.col("x").alias("nx"))
    at = around(a, RING)
    return at.join(b, [*keys, "ty", "tx", "ny", "nx"], "left_semi").select(*keys, "y", "x", "ny", "nx")


def border_adjacency(border: DataFrame, region_pixels: DataFrame) -> DataFrame:
    """Edges between border pixels of a pair that have a common neighbour in the other region."""
    keys = ["image_id", "region_id", "other_id"]
    edges = adjacency(border, keys)
    beside = around(border.select(*keys, "y", "x").distinct(), RING)
    there = region_pixels.select("image_id", F.col("region_id").alias("other_id"), F.col("y").alias("ny"), F.col("x").alias("nx"))
    beside = beside.join(dealt(there), ["image_id", "other_id", "ny", "nx"], "left_semi").select(*keys, "y", "x", F.col("ny").alias("cy"), F.col("nx").alias("cx"))
    far = beside.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), "cy", "cx")
    common = edges.join(dealt(beside), [*keys, "y", "x"]).join(dealt(far), [*keys, "ny", "nx", "cy", "cx"], "left_semi")
    return common.select(*keys, "y", "x", "ny", "nx").distinct()


def contact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of `a` with a neighbour in `b`."""
    near = around(b.select("image_id", "y", "x"), RING).select("image_id", F.col("ny").alias("y"), F.col("nx").alias("x"))
    return a.join(near, ["image_id", "y", "x"], "left_semi")


def stripes(points: DataFrame, k: int, i: int, j: int) -> DataFrame:
    return points.where((F.pmod("y", F.lit(k)) == i) & (F.pmod("x", F.lit(k)) == j))


def frame(grid: DataFrame) -> DataFrame:
    """Pixels in the first or last row or column of their image."""
    ends = grid.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    return grid.join(ends, "image_id").where("y IN (0, h) OR x IN (0, w)").drop("h", "w")


def window(grid: DataFrame, y: int, x: int, reach: int) -> DataFrame:
    return grid.where(F.col("y").between(y - reach, y + reach) & F.col("x").between(x - reach, x + reach))
