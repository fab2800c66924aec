"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HASH_SPAN, WORD, buckets_for, materialize, name_of, running_sum, stable_hash


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... to sources in code point order, null last."""
    return sources.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))


def water_fill(sources: DataFrame, max_epochs: float, share: float = 1.0) -> DataFrame:
    """Targets for rows (source, source_size, weight): `share` of all sizes by weight, none above max_epochs sizes.

    Clamping a source and resharing its excess by weight until none is above ends at one level L with
    target = min(cap, weight * L). In order of cap / weight the clamped sources come first, so L follows from running
    sums over the table of sources: L = (total - caps before) / weights from here on, at the first source whose cap
    isn't below its share. If no source is left above, every one is at its cap. An empty table has no targets.
    """
    whole = Window.partitionBy()
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.when(F.col("rest") / F.col("left") <= F.col("ratio"), F.col("rest") / F.col("left")))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("ratio", F.coalesce("source", F.lit(""))))).over(whole))
    clamped = F.col("level").isNull() | (F.col("ratio") < F.col("level"))
    return s.withColumn("target", F.when(clamped, F.col("cap")).otherwise(F.col("weight") * F.col("level"))).drop("ratio", "rest", "left", "level")


def repetitions(docs: DataFrame, key: str, sources: DataFrame, seed: str = "mix-1", large: float = 0.02) -> DataFrame:
    """Adds source_size, target and reps to rows (key, source, size).

    Each row is taken floor(target / source_size) times. For the fraction that remains, a seeded hash orders the rows
    of a source, and those that begin it are taken once more until the words so taken are nearest to what is missing.
    Rows above the share `large` of what is missing are settled first, by the same fraction, and the others make up
    for the difference, so a few long rows don't move a source off its target. Reruns agree. Hash buckets deal a
    large source over many tasks.
    """
    buckets = buckets_for(docs.count())
    rates = sources.select(F.col("source").alias("__s"), "source_size", "target")
    docs = docs.join(F.broadcast(rates) if rates.count() <= 100_000 else rates, docs["source"].eqNullSafe(F.col("__s")), "left").drop("__s")
    docs = docs.withColumn("__whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    docs = docs.withColumn("__missing", F.col("target") - F.col("__whole") * F.col("source_size"))
    docs = docs.withColumn("__large", F.col("size") > F.col("__missing") * F.lit(large))
    docs = docs.withColumn("__group", F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), F.col("__large").alias("l")))
    h = stable_hash(name_of(F.col(key)), F.col("size").cast("string"), F.lit(seed))
    docs = docs.withColumn("__h", h).withColumn("__bucket", F.floor(F.col("__h") * F.lit(buckets / HASH_SPAN)).cast("long"))
    docs = running_sum(docs, "__group", "__bucket", [F.col("__h"), F.col(key), F.col("size")], F.col("size"), "__before")
    long_size = docs.where("__large").groupBy("source").agg(F.sum("size").alias("__long_size"))
    long_size = long_size.withColumnRenamed("source", "__s")
    docs = docs.join(long_size, docs["source"].eqNullSafe(F.col("__s")), "left").drop("__s")
    middle = F.col("__before") + F.col("size") / F.lit(2.0)
    first = F.col("__large") & (middle <= F.col("__missing") * F.col("__long_size") / F.col("source_size"))
    settled = docs.where(first).groupBy("source").agg(F.sum("size").alias("__settled")).withColumnRenamed("source", "__s")
    docs = docs.join(settled, docs["source"].eqNullSafe(F.col("__s")), "left").drop("__s")
    then = ~F.col("__large") & (middle <= F.col("__missing") - F.coalesce("__settled", F.lit(0)))
    more = (F.col("size") > 0) & F.coalesce(first | then, F.lit(False))
    return docs.withColumn("reps", (F.col("__whole") + more.cast("int")).cast("int")).drop("__h", "__bucket", "__before", "__group", "__whole", "__missing", "__large", "__long_size", "__settled")


def _sources(rows: DataFrame, max_epochs: float) -> DataFrame:
    return water_fill(source_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), max_epochs)


def mix_plan(docs: DataFrame, max_epochs: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """Per document its size in words (null text: 0), its source's size and target, and the words the mix takes of it.

    A null source is a source, the last one. Repeated rows count as often as they stand. Sources without words have
    target 0 and nothing is taken of them.
    """
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = repetitions(rows, "doc_id", _sources(rows, max_epochs), seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"), "source", "reps")


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """The mixed documents themselves: each as often as the mix takes it, with the columns of `docs`.

    Rows without words belong to no share of any source and are left out. Repeated rows, and rows that share an id or
    have none, are taken as often as the plan takes each of them. An empty table gives no rows.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    keyed = docs.withColumn("__of", name("doc_id")).withColumn("__from", name("source")).withColumn("__words", word_count(F.col("text"))).withColumn("__th", F.xxhash64("text"))
    on = ["__of", "__from", "__words", "__th"]
    rows = materialize(keyed.select("doc_id", "source", F.col("__words").alias("size"), *on), "sizes")
    plan = repetitions(rows, "doc_id", _sources(rows, max_epochs), seed)
    # Rows that are equal in all this are numbered; `shares` tells how many of them are taken so often, most first.
    shares = plan.groupBy(*on, "reps").agg(F.count(F.lit(1)).alias("rows")).groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("reps", "rows")), asc=False).alias("__shares"))
    shares = shares.where("__shares[0].reps > 0")
    taken = keyed.join(shares, on).withColumn("__i", F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(0))))
    add = lambda got, x: F.struct((got["seen"] + x["rows"]).alias("seen"), F.when(got["seen"] < F.col("__i"), x["reps"]).otherwise(got["reps"]).alias("reps"))
    reps = F.aggregate("__shares", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("reps")), add)["reps"]
    taken = taken.withColumn("__reps", F.when(F.size("__shares") == 1, F.col("__shares")[0]["reps"]).otherwise(reps)).where("__reps > 0")
    return taken.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__reps")))).select(*[F.col(f"`{c}`") for c in docs.columns])
