"""Benchmark decontamination in DataFrame functions: SimHash of item-sized windows, multi-index Hamming search, exact check.

A window of a document is as long, in words, as an item. Windows are placed where they can pass the exact check at
all: it compares five-word shingles, so a window that shares none with any item has similarity 0 and isn't made; each
shingle that a document shares with an item puts a window of the item's length where the item would begin. Windows
are then known by their fingerprints only. Fingerprints of 64 bits are cut into blocks; two within the radius differ
in at most radius // blocks bits of some block, so probing every item's blocks with that many bits turned over finds
all windows within the radius, of any item of that length. Weighted Jaccard similarity of the shingles decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS, BLOCKS = 64, 4
#: Fixed value: marks that don't tell words apart.
MARKS = ".,;:!?*#$%&|<>\"'`()[]{}=+~^_/\\-"
SPACES = " \t\n\x0b\f\r"


def normal_words(text: Column) -> Column:
    """Lower-case words without marks; those of marks only are left out, and a null text has none."""
    plain = F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, ""), F.lit(SPACES))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: str, width: int) -> Column:
    """Hash of each run of `width` words, in order; fewer words: none."""
    n = F.size(words)
    one = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), one)).otherwise(F.array().cast("array<bigint>"))


def shingle_table(rows: DataFrame, keys: list[str], words: str, width: int) -> DataFrame:
    """(keys, h, n, weight): multiplicity of each shingle, and its length in characters as weight."""
    one = lambda i: F.struct(F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]).alias("h"), sum((F.length(F.get(F.col(words), i + k)) for k in range(width)), F.lit(0)).alias("w"))
    each = rows.where(F.size(words) >= width).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.size(words) - width), one)).alias("x"))
    return each.groupBy(*keys, F.col("x.h").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max("x.w").alias("weight"))


def fingerprints(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, fp): SimHash over the words of each row, every occurrence counting."""
    each = rows.select(*keys, F.explode(words).alias("__w")).select(*keys, F.xxhash64("__w").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    summed = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, fp.alias("fp"))


def _block(b: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _blocks(rows: DataFrame, turned: int) -> DataFrame:
    """A row for each block of each fingerprint and each way to turn over up to `turned` bits of it."""
    masks = [sum(1 << b for b in c) for k in range(turned + 1) for c in combinations(range(BITS // BLOCKS), k)]
    own = F.array(*[F.struct(F.lit(b).alias("block"), _block(b).alias("value")) for b in range(BLOCKS)])
    out = rows.withColumn("__x", F.explode(own))
    if turned:
        out = out.withColumn("__m", F.explode(F.array(*[F.lit(m) for m in masks])))
        return out.withColumn("block", F.col("__x.block")).withColumn("value", F.col("__x.value").bitwiseXOR(F.col("__m"))).drop("__x", "__m")
    return out.withColumn("block", F.col("__x.block")).withColumn("value", F.col("__x.value")).drop("__x")


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = 15, width: int = 5, similarity: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Best window of each document for each item that it holds: doc_id, item_id, start, n_words, distance, similarity.

    Items of fewer than `width` words are too short to be told from chance and match nothing; so do null texts and
    ids of items. A window that would reach beyond the text is moved inside, and is the whole text if that is shorter.
    Documents that repeat a doc_id are answered together; a null doc_id is an id. Of several windows the most similar,
    then the first, is returned. The shingles of the benchmark are broadcast up to `broadcast_rows` rows (they are
    counted first, about 24 bytes a row); a larger benchmark is joined by shuffle. Without documents or items there are
    no rows; other columns of both tables are left out.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") >= width)
    items = materialize(items.distinct(), "benchmark-words")
    seeds = items.select(F.size("words").alias("n_words"), F.posexplode(shingle_hashes("words", width)).alias("q", "h")).distinct()
    many = seeds.count() > broadcast_rows
    texts = docs.select("doc_id", normal_words(F.col("text")).alias("words"))
    shingles = texts.select("doc_id", F.size("words").alias("n"), F.posexplode(shingle_hashes("words", width)).alias("p", "h"))
    placed = shingles.join(seeds if many else F.broadcast(seeds), "h")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("n_words")))
    placed = placed.select("doc_id", start.alias("start"), "n_words").distinct()
    asked = placed.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list(F.struct("start", "n_words")).alias("__asked"))
    asked = materialize(asked.withColumn("__many", F.size("__asked")), "placed-windows")
    # Few documents share a shingle with an item as a rule: their windows are broadcast after counting, and texts stay where they are.
    small = (asked.agg(F.sum("__many")).first()[0] or 0) <= broadcast_rows
    windows = docs.select("doc_id", "text").join(F.broadcast(asked) if small else asked, docs["doc_id"].eqNullSafe(F.col("__d"))).select("doc_id", normal_words(F.col("text")).alias("words"), "__asked")
    windows = windows.select("doc_id", "words", F.explode("__asked").alias("x")).select("doc_id", F.col("x.start").alias("start"), F.col("x.n_words").alias("n_words"), F.slice("words", F.col("x.start") + 1, F.col("x.n_words")).alias("words"))
    windows = materialize(windows.where(F.size("words") > 0).withColumn("window", F.xxhash64("words")), "windows")
    # Equal windows have one fingerprint and one similarity: copies of a passage are compared once.
    distinct = windows.groupBy("window", "n_words").agg(F.first("words").alias("words"))
    window_fps = fingerprints(distinct, ["window", "n_words"], "words")
    item_fps = fingerprints(items.withColumn("n_words", F.size("words")), ["item_id", "n_words"], "words")
    left = _blocks(window_fps, 0)
    right = _blocks(item_fps, radius // BLOCKS).withColumnRenamed("fp", "fp2")
    found = left.join(right, ["n_words", "block", "value"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))))
    found = materialize(found.where(F.col("distance") <= radius).select("window", "n_words", "item_id", "distance").distinct(), "candidates")
    ours = shingle_table(distinct.join(found.select("window", "n_words").distinct(), ["window", "n_words"]), ["window", "n_words"], "words", width)
    theirs = shingle_table(items, ["item_id"], "words", width)
    zero = F.lit(0).cast("long")
    sides = found.join(ours, ["window", "n_words"]).select("window", "n_words", "item_id", "distance", "h", "weight", F.col("n").alias("a"), zero.alias("b"))
    sides = sides.unionByName(found.join(theirs, "item_id").select("window", "n_words", "item_id", "distance", "h", "weight", zero.alias("a"), F.col("n").alias("b")))
    each = sides.groupBy("window", "n_words", "item_id", "distance", "h").agg(F.max("weight").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    scored = each.groupBy("window", "n_words", "item_id", "distance").agg((F.sum(F.col("w") * F.least("a", "b")) / F.sum(F.col("w") * F.greatest("a", "b"))).alias("similarity"))
    scored = scored.where(F.col("similarity") >= similarity)
    hits = windows.select("doc_id", "start", "n_words", "window").join(scored, ["window", "n_words"])
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start", "n_words")
    hits = hits.withColumn("__r", F.row_number().over(best)).where("__r = 1")
    return hits.select("doc_id", "item_id", F.col("start").cast("int").alias("start"), "n_words", F.col("distance").cast("int").alias("distance"), "similarity")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """Documents in which no item was found, with their columns, whatever these are named.

    Cases are those of `contaminated`: null texts hold nothing and stay, all rows of a doc_id go or stay together, a
    null doc_id is an id, and with an empty benchmark all documents stay.
    """
    bad = materialize(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated-ids")
    # Few documents are contaminated as a rule: their ids are broadcast after counting, and texts stay where they are.
    bad = F.broadcast(bad) if bad.count() <= 1_000_000 else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad")), "left_anti")
