"""Pixel tables that grow: brightness counts over a stream of arriving images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweft.operators.color import opaque


def pixel_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("image_id int, y int, x int, r int, g int, b int, a int").parquet(folder)


def running_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, value, count), kept up to date; complete or update mode."""
    return opaque(pixels).where("y <> 0").groupBy("image_id", "value").count()
