"""Images in and out: the built-in image source, pixel tables, PNG bytes per image, text and CSV."""

from __future__ import annotations

import json
import struct
import sys
import zlib
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Parameters of the pipeline with their defaults."""

    region_proportion_threshold: float = 0.01
    region_defuzz_threshold: int = 10
    sideways_cut_penalty: float = 100
    border_defuzz_threshold: float = 5
    border_traversal_failure_tolerance: int = 5
    decimate_deviation_cutoff: float = 3
    edge_subdivide_ratio: float = 3
    mesh_smooth_convergence_ratio: float = 0.05
    polygon_subdivisions: int = 2
    batch_stripe_distance: int = 5

    @classmethod
    def load(cls, path: str | None) -> Options:
        """Defaults, with the keys of a JSON file in their place; a missing file is reported and ignored."""
        if not path:
            return cls()
        try:
            with open(path) as f:
                found = json.load(f)
        except FileNotFoundError:
            print(f"no configuration at {path}", file=sys.stderr)
            return cls()
        return replace(cls(), **{k: v for k, v in found.items() if k in {f.name for f in fields(cls)}})


def default_output(path: str, suffix: str) -> str:
    """The name with a suffix before its extension."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}{suffix}.{end}" if dot and "/" not in end else f"{path}{suffix}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, r, g, b, a) of image files, numbered by name. Rows hold bytes in BGR(A) order, or grey."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    names = raw.select("origin").distinct().selectExpr("origin", "cast(row_number() over (order by origin) - 1 as int) as image_id")
    at = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + k + 1, 1)), 16, 10).cast("int")
    p = raw.join(names, "origin").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)))
    one = F.col("nChannels") == 1
    return p.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.when(one, at(0)).otherwise(at(2)).alias("r"), F.when(one, at(0)).otherwise(at(1)).alias("g"), at(0).alias("b"), F.when(F.col("nChannels") == 4, at(3)).otherwise(255).alias("a"))


def png(rows: np.ndarray) -> bytes:
    """PNG bytes of an array (height, width, 4)."""
    h, w, _ = rows.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows.reshape(h, w * 4).astype(np.uint8)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_png(pixels: DataFrame) -> DataFrame:
    """(image_id, png): one picture for each image; pixels not listed are clear."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((rows.y.max() + 1, rows.x.max() + 1, 4), np.uint8)
        out[rows.y, rows.x] = rows[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame({"image_id": [rows.image_id.iloc[0]], "png": [png(out)]})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id int, png binary")


def issue_lines(issues: DataFrame) -> DataFrame:
    """One line "y, x" for each failed pixel."""
    return issues.select(F.concat_ws(", ", "y", "x").alias("value"))


def matrix_csv(values: DataFrame) -> DataFrame:
    """(image_id, y, line): rows of an image as comma-separated text."""
    return values.groupBy("image_id", "y").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("x", F.col("value").cast("string").alias("v")))), lambda s: s["v"])).alias("line"))
