"""Set and order operators on point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sorted_distinct(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, y, x): distinct points, numbered by (y, x) from 0."""
    return points.select(*keys, "y", "x").distinct().withColumn("rank", (F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x")) - 1).cast("int"))


def middle(points: DataFrame, keys: list[str]) -> DataFrame:
    """The point of rank floor(n / 2)."""
    r = sorted_distinct(points, keys).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return r.where(F.col("rank") == F.floor(F.col("n") / 2)).drop("rank", "n")


def reverse_prefix(points: DataFrame, keys: list[str], upto: int) -> DataFrame:
    """Points with pos up to `upto` in reverse, then the others."""
    return points.withColumn("pos", F.when(F.col("pos") <= upto, upto - F.col("pos")).otherwise(F.col("pos")).cast("int"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def minus(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def common(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_semi")


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).distinct()
