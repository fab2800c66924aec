"""Driver-iterated fixpoints whose rounds end in tables of the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new one where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pixelweft-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows that a file of a small table holds, and its files at least.
ROWS_A_FILE, LEAST_FILES = 250_000, 24
#: Scratch tables are read by the driver that wrote them, after the write: a marker that they are whole serves nobody.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def files_for(rows: int) -> int:
    """Files for a table of narrow rows. On local folders Hadoop starts processes (chmod) for each file that it creates."""
    return max(LEAST_FILES, -(-rows // ROWS_A_FILE))


def settle(df: DataFrame, name: str = "round", files: int | None = None) -> DataFrame:
    """Cuts lineage with a written table, which goes with `discard` or when the application ends; in `files` files at most."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = _folder(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    (df.coalesce(files) if files else df).write.options(**UNMARKED).parquet(path + "/table")
    out = spark.read.schema(df.schema).parquet(path + "/table")
    out.scratch = path
    return out


def discard(settled: DataFrame) -> None:
    """Deletes the table behind what `settle` gave; nothing that is still to be computed may read it."""
    where, fs = _folder(settled.sparkSession, settled.scratch)
    fs.delete(where, True)


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def connected_components(edges: DataFrame, max_rounds: int = 40, files: int | None = None) -> DataFrame:
    """Labels (node, root) of the nodes that edges (a, b) name; root: the least node of the component.

    Alternates large-star and small-star steps (Kiveris et al., 2014): O(log^2 n) rounds. A hub's neighbours are
    never gathered: the least neighbour is an aggregate, and the join back to the edges can be split where it is
    skewed. Self loops and repeated edges are allowed, nulls are dropped; no edges, no rows. files: of the first table of
    edges, at most; rounds leave few edges more than there were and get files by their count.
    """
    edges = edges.select(F.col("a"), F.col("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    work = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files=files)

    def mark(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(work)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = work.union(work.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        last, work = work, settle(small.where("a <> b").distinct(), files=files_for(seen[0]))
        now = mark(work)
        discard(last)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("root", "node").alias("root"))
