"""Sentinels, neighbourhoods and table shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value of a pixel that no region owns, and region id beyond the image.
VOID = -1
#: The eight neighbours in the order that ties depend on (down, down-right, right, ...), and the four.
RING = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
CROSS = ((1, 0), (0, 1), (-1, 0), (0, -1))

GRID = "image_id int, y int, x int, value int"
REGION_PIXELS = "image_id int, y int, x int, region_id int, value int"


def offsets(steps: tuple[tuple[int, int], ...]) -> Column:
    """An array of (i, dy, dx), to explode."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(steps)])


def around(points: DataFrame, steps: tuple[tuple[int, int], ...]) -> DataFrame:
    """A row for each point and neighbour: adds i, ny, nx."""
    out = points.withColumn("__o", F.explode(offsets(steps)))
    return out.select("*", F.col("__o.i").alias("i"), (F.col("y") + F.col("__o.dy")).alias("ny"), (F.col("x") + F.col("__o.dx")).alias("nx")).drop("__o")


def dealt(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by shuffle whatever Spark takes its size for.

    Spark goes by the bytes of Parquet files and leaves out what `explode` and joins add, so it would have the driver
    gather and broadcast tables of pixels, edges or corners that take a hundred times the bytes it allows.
    """
    return rows.hint("merge")
