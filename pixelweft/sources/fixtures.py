"""Rasters, polylines, polygons and meshes derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b, a): complete 32 x 32 tiles; a disc in a disc, a stripe, a clear corner, rare noise."""
    orders = table(spark, sf_dir, "orders")
    images = orders.count() // SIDE**2
    k = orders.where(F.col("o_orderkey") < images * SIDE**2).select(
        F.floor(F.col("o_orderkey") / SIDE**2).cast("int").alias("image_id"),
        F.floor(F.col("o_orderkey") % SIDE**2 / SIDE).cast("int").alias("y"),
        (F.col("o_orderkey") % SIDE).cast("int").alias("x"),
        F.col("o_custkey").alias("c"),
    )
    far = (F.col("y") - 16) * (F.col("y") - 16) + (F.col("x") - 16) * (F.col("x") - 16)
    v = F.when(F.col("c") % 211 == 0, 1).when(far < 16, 80).when(far < 90, 200).when(F.col("x") < 10 + F.col("image_id") % 5, 140).otherwise(110).cast("int")
    a = F.when((F.col("y") >= 28) & (F.col("x") >= 28), 0).otherwise(255).cast("int")
    return k.select("image_id", "y", "x", v.alias("r"), v.alias("g"), v.alias("b"), a.alias("a"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, pos, y, x): the values of one user over time."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("line_id"), pos.cast("int").alias("pos"), F.col("value").alias("y")).withColumn("x", F.col("pos").cast("double"))


def _spread(df: DataFrame, steps: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    s = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(step, names, strict=True)]) for step in steps]))
    return df.withColumn("__s", s).select("*", "__s.*").drop("__s")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(polygon_id, pos, y, x): star-shaped octagons."""
    rays = [(0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)]
    p = _spread(table(spark, sf_dir, "part").select("p_partkey"), rays, ["pos", "dy", "dx"])
    length = 4 + (F.col("p_partkey") * 7 + F.col("pos") * 5) % 9
    return p.select(F.col("p_partkey").alias("polygon_id"), "pos", (32 + F.col("dy") * length).cast("int").alias("y"), (32 + F.col("dx") * length).cast("int").alias("x"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(polygon_id, pos, y, x): a mesh of ten cells a row with jittered corners."""
    p = _spread(table(spark, sf_dir, "part").select("p_partkey"), [(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)], ["pos", "oy", "ox"])
    p = p.withColumn("gy", F.floor(F.col("p_partkey") / 10).cast("int") + F.col("oy")).withColumn("gx", (F.col("p_partkey") % 10).cast("int") + F.col("ox"))
    y = 8 * F.col("gy") + (F.col("gy") * 7 + F.col("gx") * 3) % 3
    x = 8 * F.col("gx") + (F.col("gy") * 5 + F.col("gx") * 2) % 3
    return p.select(F.col("p_partkey").alias("polygon_id"), "pos", y.cast("int").alias("y"), x.cast("int").alias("x"))
