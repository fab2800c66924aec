"""5 x 5 patterns of pixels: a table of them in every orientation, and the edges that a match takes away.

A pattern is three sets of cells: set ones, free ones that may be set or not, and those that the middle is falsely
connected to. Each set is a whole number, cell (row, column) being bit 5 * row + column. Surroundings are compared by
that number, so a match is an equi-join without collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 5
MIDDLE = 12
_CELLS = [(row, column) for row in range(SIDE) for column in range(SIDE)]


def orientations() -> list[list[int]]:
    """Where each cell goes under the eight symmetries of the square: four turns, and each of them mirrored."""
    out = []
    for mirrored in (False, True):
        for turns in range(4):
            places = []
            for row, column in _CELLS:
                column = SIDE - 1 - column if mirrored else column
                for _ in range(turns):
                    row, column = column, SIDE - 1 - row
                places.append(SIDE * row + column)
            out.append(places)
    return out


def _moved(mask: Column, places: list[int]) -> Column:
    """The set with every cell moved to its place."""
    bit = lambda i: F.shiftright(mask, i).bitwiseAND(F.lit(1))
    return sum((F.shiftleft(bit(i), to) for i, to in enumerate(places)), F.lit(0).cast("int")).cast("int")


def oriented(patterns: DataFrame) -> DataFrame:
    """(pattern_id, code, false_cells): patterns (pattern_id, cells, free, false_cells) with every choice of their
    free cells, in every orientation, each once."""
    places = F.filter(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.call_function("getbit", F.col("free"), i) == 1)
    p = patterns.withColumn("__at", places).withColumn("__n", F.explode(F.expr("sequence(0, shiftleft(1, size(__at)) - 1)")))
    chosen = F.expr("aggregate(sequence(0, size(__at) - 1), 0, (s, j) -> s | shiftleft(getbit(__n, j), __at[j]))")
    p = p.withColumn("__code", F.col("cells").bitwiseOR(F.when(F.size("__at") > 0, chosen).otherwise(F.lit(0))))
    each = F.explode(F.array(*[F.struct(_moved(F.col("__code"), o).alias("code"), _moved(F.col("false_cells"), o).alias("false_cells")) for o in orientations()]))
    return p.select("pattern_id", each.alias("x")).select("pattern_id", "x.code", "x.false_cells").distinct()


def surroundings(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, code): the 5 x 5 cells around each listed pixel, itself included."""
    at = points.select(*keys, "y", "x").distinct()
    cells = F.explode(F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(row - 2).alias("dy"), F.lit(column - 2).alias("dx")) for i, (row, column) in enumerate(_CELLS)]))
    seen = at.withColumn("c", cells).select(*keys, (F.col("y") - F.col("c.dy")).alias("y"), (F.col("x") - F.col("c.dx")).alias("x"), F.col("c.bit").alias("bit"))
    return at.join(seen, [*keys, "y", "x"]).groupBy(*keys, "y", "x").agg(F.sum("bit").cast("int").alias("code"))


def false_edges(points: DataFrame, edges: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, ny, nx): edges that a pattern around a branch point calls false, in both directions."""
    branch = edges.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("__n")).where("__n > 2").drop("__n")
    hit = surroundings(points, keys).join(branch, [*keys, "y", "x"], "left_semi").join(F.broadcast(oriented(patterns)), "code")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(row - 2).alias("dy"), F.lit(column - 2).alias("dx")) for i, (row, column) in enumerate(_CELLS)])
    each = hit.withColumn("c", F.explode(F.filter(cells, lambda c: F.call_function("getbit", F.col("false_cells"), c["i"]) == 1)))
    one = each.select(*keys, "y", "x", (F.col("y") + F.col("c.dy")).alias("ny"), (F.col("x") + F.col("c.dx")).alias("nx"))
    back = one.select(*keys, F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("y").alias("ny"), F.col("x").alias("nx"))
    return one.union(back).distinct()


def true_edges(points: DataFrame, edges: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, y, x, ny, nx) without those that a pattern calls false. Without patterns all stay."""
    return edges.join(false_edges(points, edges, patterns, keys), [*keys, "y", "x", "ny", "nx"], "left_anti")


def unmatched(points: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """(code): the surroundings, each once, of points that keep more than two edges."""
    branch = left.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("__n")).where("__n > 2").drop("__n")
    return surroundings(points, keys).join(branch, [*keys, "y", "x"], "left_semi").select("code").distinct()


def sample_sheet(codes: DataFrame) -> DataFrame:
    """A picture (image_id, y, x, r, g, b, a) with the samples below each other in the order of their codes."""
    from .points import rank_of

    rows = rank_of(codes.withColumn("image_id", F.lit(0)), ["image_id"], ["code"], "k")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(row).alias("row"), F.lit(column).alias("column")) for i, (row, column) in enumerate(_CELLS)]))
    rows = rows.withColumn("c", cells).withColumn("v", F.call_function("getbit", F.col("code"), F.col("c.i")).cast("int") * 255)
    return rows.select("image_id", (F.col("k") * SIDE + F.col("c.row")).alias("y"), F.col("c.column").alias("x"), *[F.col("v").alias(c) for c in "rgb"], F.lit(255).alias("a"))


def read_patterns(spark: SparkSession, path: str | None) -> DataFrame:
    """(pattern_id, cells, free, false_cells) of a picture that has a pattern in every five rows: its cells, its free
    cells and its false connections beside each other, light pixels being set. No file, or no path: no patterns."""
    from pixelweft.sources.images import exists, read_images

    empty = spark.createDataFrame([], "pattern_id int, cells int, free int, false_cells int")
    if not path or not exists(spark, path):
        return empty
    lit = read_images(spark, path).where("r > 0").select(F.floor(F.col("y") / SIDE).cast("int").alias("pattern_id"), F.floor(F.col("x") / SIDE).alias("set"), F.expr("shiftleft(1, int(y % 5 * 5 + x % 5))").alias("bit"))
    mask = lambda k: F.coalesce(F.sum(F.when(F.col("set") == k, F.col("bit"))), F.lit(0)).cast("int")
    return lit.groupBy("pattern_id").agg(mask(0).alias("cells"), mask(1).alias("free"), mask(2).alias("false_cells"))
