"""Weighted rendezvous hashing of stable record keys, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HASH_SPAN, buckets_for, name_of, running_sum, stable_hash


def rendezvous(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The shard with the lowest -ln(u) / weight, u being a hash of key and shard in (0, 1); the lower id on a tie.

    A shard's score depends on its own id and weight only, so one more shard takes keys into itself and moves no
    other, and a shard that goes gives up only its own keys. A null key is a key like any other.
    """
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("shards need ids with weights above zero")
    name = name_of(key)
    scores = [
        F.struct((-F.log((stable_hash(name, F.lit(str(i))) + 0.5) / F.lit(HASH_SPAN)) / F.lit(float(w))).alias("cost"), F.lit(int(i)).alias("shard"))
        for i, w in shards
    ]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(df: DataFrame, key: str, shards: Sequence[tuple[int, float]], out: str = "shard") -> DataFrame:
    """Adds the shard of each row in a column `out`, which replaces one of that name; other columns are kept.

    Repeated keys meet in one shard; empty tables stay empty.
    """
    return df.withColumn(out, rendezvous(F.col(key), shards))


def number_slots(df: DataFrame, key: str, ties: Sequence[str] = (), shard: str = "shard", out: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in a column `out`, which replaces one of that name.

    Rows stand in the order of a hash of key and `ties`, which tell rows with equal keys apart; rows equal in these
    too are numbered in any order. A shard is dealt over buckets of that hash that grow in number with the rows, so no
    task holds a whole shard, and a key that many rows share is dealt as well.
    """
    buckets = buckets_for(df.count())
    h = stable_hash(name_of(F.col(key)), *[name_of(F.col(t)) for t in ties], F.lit("slot"))
    df = df.withColumn("__h", h).withColumn("__bucket", F.floor(F.col("__h") * F.lit(buckets / HASH_SPAN)).cast("long"))
    order = [F.col("__h"), F.col(key), *[F.col(t) for t in ties]]
    return running_sum(df, shard, "__bucket", order, F.lit(1), out).drop("__h", "__bucket")


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Writes one folder per shard."""
    df.repartition(shard, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_report(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Row by row what sharding decides for documents, under the law "key": doc_id and shard count decide.

    Size: UTF-8 bytes of the text, null none, plus 1. A null text has the CRC of no bytes, 0. A null doc_id is a key
    of its own. Rows with the same doc_id share a shard and differ in slot. Columns beyond doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    equal = [(i, 1.0) for i in range(n_shards)]
    rows = assign_shards(rows, "doc_id", equal)
    rows = assign_shards(rows, "doc_id", [*equal, (n_shards, 1.0)], "grown_shard")
    rows = number_slots(rows, "doc_id", ("text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
