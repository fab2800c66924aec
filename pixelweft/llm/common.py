"""What the training-data operators share: scratch tables, stable ordering, byte-level word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweft.plans.fixpoint import UNMARKED

#: What the word pattern treats as a word, for Java regular expressions and for bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none (tests, one machine), sets one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="pixelweft-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. It goes when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage ends there, and losing an executor loses nothing.

    files: at most so many files, for tables that are small (`files_for`).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name) + "/table"
    (df.coalesce(files) if files else df).write.options(**UNMARKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def name_of(key: Column) -> Column:
    """A key as text; null has a name of its own."""
    return F.coalesce(key.cast("string"), F.lit("\0null"))


def stable_hash(*keys: Column) -> Column:
    """52 bits of an MD5, as a long: every engine computes the same, and doubles hold it exactly."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 13), 16, 10).cast("long")


HASH_SPAN = float(1 << 52)


def buckets_for(rows: int, target: int = 50_000) -> int:
    """Buckets that hold about `target` rows each, at least 64."""
    return max(64, -(-rows // target))


def running_sum(df: DataFrame, group: str, bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of `value` over the rows before this one in its group, in the order (bucket, order).

    A group of any size is dealt over its buckets: the bucket totals are few, their prefix sums are joined back,
    and each window holds one bucket only. Null groups and nulls in `order` are ordinary values.
    """
    g, b = f"__g_{out}", f"__b_{out}"
    totals = df.groupBy(F.col(group).alias(g), F.col(bucket).alias(b)).agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(g, b, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = df.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = part.join(offsets, part[group].eqNullSafe(offsets[g]) & (part[bucket] == offsets[b]), "left")
    return joined.withColumn(out, F.col("__off") + F.col("__in")).drop(g, b, "__off", "__in")


# --- bytes ---------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _MUL), ("down", _INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with hash(data[i:j]) = mix64((H[j] - H[i]) * down[i]); see `span_hash`."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


def reuse_freed() -> None:
    """Has the C library keep freed memory, up to 128 MB, for the next array of up to 32 MB in this process.

    Else it gives the room of each batch's arrays back and takes it again for the next batch, page by page.
    """
    trim, mapped = -1, -3  # M_TRIM_THRESHOLD and M_MMAP_THRESHOLD of glibc; other libraries are left as they are
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(trim, 128 << 20)
    mallopt(mapped, 32 << 20)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array (null: none) and the offsets of the texts in it."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(held) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a batch of texts: bounds in `data`, text of each word."""

    def __init__(self, texts: pa.Array, fold: bool = True):
        self.data, self.offsets = text_bytes(texts)
        if fold:
            self.data = _FOLD[self.data]
        n = len(self.data)
        word = ~_SPACE[self.data]
        first, last = self.offsets[:-1], self.offsets[1:]
        filled = first < last
        left = np.zeros(n + 1, bool)
        left[1:] = word
        left[first[filled]] = False
        right = np.zeros(n + 1, bool)
        right[:n] = word
        right[last[filled]] = False
        self.start = np.flatnonzero(word & ~left[:n])
        self.end = np.flatnonzero(word & ~right[1:]) + 1
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        # Empty texts share their offset with the next one; the search above finds the last of them, the one with bytes.
        self.count = np.bincount(self.text, minlength=len(first)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.start, self.end)


def batches(source: Iterator[pa.RecordBatch], column: str, limit: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of one hold about `limit` bytes; one longer text stays whole."""
    for batch in source:
        if not batch.num_rows:
            continue
        sizes = text_bytes(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
