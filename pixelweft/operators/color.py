"""Brightness buckets and the folding of rare ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.schema import VOID


def opaque(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, value) of pixels with alpha above 10; value is r + g + b, three times the brightness."""
    return pixels.where("a > 10").select("image_id", "y", "x", (F.col("r") + F.col("g") + F.col("b")).cast("int").alias("value"))


def histogram(pixels: DataFrame, skip_first_row: bool = True) -> DataFrame:
    """(image_id, value, n, first_y, first_x): counts, and the first pixel in raster order. Row 0 is left out."""
    rows = opaque(pixels)
    rows = rows.where("y <> 0") if skip_first_row else rows
    return rows.groupBy("image_id", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("y", "x")).alias("f")).select("image_id", "value", "n", F.col("f.y").alias("first_y"), F.col("f.x").alias("first_x"))


def thresholds(pixels: DataFrame, share: float = 0.01) -> DataFrame:
    """(image_id, least): a bucket with fewer pixels is rare. Row 0 counts here."""
    return opaque(pixels).groupBy("image_id").agg((F.count(F.lit(1)) * F.lit(share)).alias("least"))


def fold_independent(pixels: DataFrame, share: float = 0.01) -> DataFrame:
    """(image_id, value, target): every rare value goes to the nearest frequent one, the earlier one on a tie.

    An image without frequent values keeps its values.
    """
    h = histogram(pixels).join(thresholds(pixels, share), "image_id").withColumn("rare", F.col("n") < F.col("least"))
    often = h.where("NOT rare").select("image_id", F.col("value").alias("other"), F.col("first_y").alias("oy"), F.col("first_x").alias("ox"))
    gap = (F.col("value") - F.col("other")) * (F.col("value") - F.col("other"))
    best = h.where("rare").join(often, "image_id", "left").groupBy("image_id", "value").agg(F.min_by("other", F.struct(gap, "oy", "ox")).alias("to"))
    return h.join(best, ["image_id", "value"], "left").select("image_id", "value", F.coalesce("to", "value").alias("target"))


def fold_sequential(pixels: DataFrame, share: float = 0.01) -> DataFrame:
    """(image_id, value, target) when values fold one after another, in the order of their first pixels.

    A value that earlier folds made frequent stays; one that folds goes with all that it took in. At most 766 values
    an image reach the kernel.
    """
    h = histogram(pixels).join(thresholds(pixels, share), "image_id")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["first_y", "first_x"])
        alive = dict(zip(rows.value.tolist(), rows.n.tolist(), strict=True))
        goes: dict[int, int] = {}
        least = float(rows.least.iloc[0])
        for v in rows.value.tolist():
            if alive[v] < least and len(alive) > 1:
                n = alive.pop(v)
                to = min(alive, key=lambda o: (o - v) ** 2)
                alive[to] += n
                goes[v] = to

        def end(v: int) -> int:
            while v in goes:
                v = goes[v]
            return v

        return pd.DataFrame({"image_id": rows.image_id, "value": rows.value, "target": [end(v) for v in rows.value]})

    return h.groupBy("image_id").applyInPandas(fold, "image_id int, value int, target int")


def value_grid(pixels: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """(image_id, y, x, value): every pixel, void ones (clear, or in row 0) with -1."""
    folds = fold_independent(pixels) if folds is None else folds
    full = pixels.withColumn("value", F.when((F.col("a") > 10) & (F.col("y") != 0), F.col("r") + F.col("g") + F.col("b")))
    return full.join(folds, ["image_id", "value"], "left").select("image_id", "y", "x", F.coalesce("target", F.lit(VOID)).cast("int").alias("value"))


def grey(values: DataFrame, column: str = "value") -> DataFrame:
    """Adds r, g, b, a: grey and fully opaque."""
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.col(column).cast("int")))
    return values.select("*", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))


def levels(values: DataFrame, column: str = "value") -> DataFrame:
    """Rescales a column to 0..255 between the extremes of its image."""
    w = Window.partitionBy("image_id")
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return values.withColumn("level", F.when(hi > lo, (F.col(column) - lo) * 255.0 / (hi - lo)).otherwise(F.lit(0.0)))
