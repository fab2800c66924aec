"""Line deduplication by a log-template tree, in DataFrame functions.

A line's path in the tree is fixed in depth: its number of tokens, then its leading tokens; a token with a digit is a
variable field and becomes <*>. A leaf holds the lines of one path. Tokens behind the leading ones are cut into
`BANDS` bands (single tokens in lines of up to as many, and then fewer of them); lines of a leaf belong to one template
if at least `AGREE` of `BANDS` of the bands that have tokens are equal at their places, and bands in which they differ
become fields of the template as well.

Lines are taken by frequency: one that agrees with no lead is a lead itself, others join the most frequent lead that
they agree with. Lines agree if they have all bands of some choice in common, so each choice of as many bands as must
agree is a key, and all lines under a key agree. Leads are elected in rounds: a line that comes first under all its
keys is one, and the lines under its keys are settled. Aggregates and joins by key, no pairs within a leaf.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BANDS, AGREE, LEADING = 8, 5, 2


def mask(line: Column) -> Column:
    """Tokens with a digit become <*>."""
    return F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*", "<*>")).otherwise(line)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line, b0..b7): the lines of each text that have a token, by place from 0.

    A band's hash includes the path to its leaf, so equal bands are of one leaf. Bands without tokens are null.
    """
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.select("doc_id", "th", "pos", F.btrim(mask(F.col("line")), F.lit(" \t\x0b\f\r")).alias("line")).where("line <> ''")
    each = each.select("doc_id", "th", "pos", F.split("line", r"[\x20\x09-\x0D]+").alias("t")).withColumn("n", F.size("t"))
    each = each.withColumn("leaf", F.xxhash64("n", F.slice("t", 1, LEADING)))
    rest = F.greatest(F.col("n") - LEADING, F.lit(0))
    cut = lambda k: F.floor(rest * k / BANDS).cast("int")
    bands = [F.when(cut(k + 1) > cut(k), F.hash("leaf", F.slice("t", LEADING + 1 + cut(k), cut(k + 1) - cut(k)))).alias(f"b{k}") for k in range(BANDS)]
    return each.select("doc_id", "th", "pos", F.xxhash64("t").alias("line"), *bands)


def choices(filled: int) -> list[tuple[int, ...]]:
    """Every choice of as many bands as must agree, of those that have tokens in lines with so many filled bands."""
    own = [k for k in range(BANDS) if filled * (k + 1) // BANDS > filled * k // BANDS]
    return list(combinations(own, -(-filled * AGREE // BANDS)))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(line, many, b0..b7): each line once, with how often it stands."""
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("many"), *[F.first(f"b{k}").alias(f"b{k}") for k in range(BANDS)])


def looked_up(rows: DataFrame, key: str, place: list[str], found: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with `value` of a table (key, value), null if it has none, of a table `found` whose keys may be very common.

    hot: the rows (key, value or null) of keys that hold a thousandth of all rows or more each, so there are at most a
    thousand and they are broadcast. Their rows go to the other join under a hash of their `place` instead, which
    spreads them; what they might meet there by chance doesn't count.
    """
    few = hot.select(F.col(key).alias("__k"), F.col("value").alias("__v"), F.lit(True).alias("__hot"))
    rows = rows.join(F.broadcast(few), F.col(key) == F.col("__k"), "left")
    rows = rows.withColumn("__key", F.when(F.col("__hot"), F.xxhash64(*place)).otherwise(F.col(key)))
    rows = rows.join(found.select(F.col(key).alias("__f"), F.col("value").alias("__w")), F.col("__key") == F.col("__f"), "left")
    return rows.withColumn("value", F.when(F.col("__hot"), F.col("__v")).otherwise(F.col("__w"))).drop("__k", "__v", "__hot", "__key", "__f", "__w")


def templates(own: DataFrame) -> DataFrame:
    """(line, template) of those of the distinct lines that join another one."""
    names = [f"b{k}" for k in range(BANDS)]
    # Lines that agree differ in at most three bands and have one of four pairs of bands in common: others are left out.
    pairs = [F.when(F.coalesce(f"b{k}", f"b{k + 1}").isNotNull(), F.xxhash64(F.lit(k), F.col(f"b{k}"), F.col(f"b{k + 1}"))) for k in range(0, BANDS, 2)]
    keyed = own.select("line", F.explode(F.array_compact(F.array(*pairs))).alias("key")).repartition("key")
    met = keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key", "left_semi")
    own = materialize(own.join(met.select("line").distinct(), "line", "left_semi"), "lines-that-meet")
    filled = sum(F.col(b).isNotNull().cast("int") for b in names)
    keys = F.array().cast("array<bigint>")
    for n in range(1, BANDS + 1):
        keys = F.when(filled == n, F.array(*[F.xxhash64(F.lit(sum(1 << k for k in c)), *[F.col(f"b{k}") for k in c]) for c in choices(n)])).otherwise(keys)
    keyed = own.select("line", (-F.col("many")).alias("m"), F.explode(keys).alias("key")).repartition("key")
    # One line under a key: nobody to agree with. The most frequent comes first; the line's hash settles ties, so reruns agree.
    keyed = materialize(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key", "left_semi").select("line", "m", "key"), "agreeing-lines")
    left, leads = keyed, keyed.select("line").limit(0)
    while not left.isEmpty():
        first = left.groupBy("key").agg(F.min(F.struct("m", "line")).alias("x"))
        new = left.join(first, "key").groupBy("line").agg(F.bool_and(F.col("x.line") == F.col("line")).alias("lead")).where("lead").select("line")
        new = materialize(new, "leads")
        under = left.join(new, "line", "left_semi").select("key").distinct()
        left = materialize(left.join(left.join(under, "key", "left_semi").select("line").distinct(), "line", "left_anti"), "lines-without-lead")
        leads = leads.union(new)
    led = keyed.join(leads, "line", "left_semi").select("key", F.struct("m", F.col("line").alias("lead")).alias("x"))
    best = keyed.join(led, "key").groupBy("line").agg(F.min("x").alias("x"))
    return best.select("line", F.col("x.lead").alias("template")).where("line <> template")


def recurring_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Per row of documents: doc_id, th (hash of the text), n_lines, n_dropped and the places of the lines to drop.

    A template recurs if it stands in at least `min_docs` documents; all its lines go. n_lines counts lines with a
    token; other lines are kept as they are. Null and empty texts have no lines. Rows with equal doc_id and text are
    one document, and rows with a null doc_id and one text too.
    """
    lines = materialize(lines_of(docs), "lines")
    own = materialize(distinct_lines(lines), "distinct-lines")
    total = own.agg(F.sum("many")).first()[0] or 0
    joined = materialize(templates(own).withColumnRenamed("template", "value"), "joined-lines")
    hot = own.where(F.col("many") * 1000 > total).select("line").join(joined, "line", "left")
    named = looked_up(lines.select("doc_id", "th", "pos", "line"), "line", ["doc_id", "th", "pos"], joined, hot)
    named = materialize(named.select("doc_id", "th", "pos", F.coalesce("value", "line").alias("template")), "line-templates")
    often = materialize(named.select("template", "doc_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("value")), "template-documents")
    total = often.agg(F.sum("value")).first()[0] or 0
    often = often.where(F.col("value") >= min_docs)
    marked = looked_up(named, "template", ["doc_id", "th", "pos"], often, often.where(F.col("value") * 1000 > total))
    found = marked.groupBy("doc_id", "th").agg(F.countDistinct("pos").alias("n_lines"), F.collect_set(F.when(F.col("value").isNotNull(), F.col("pos"))).alias("dropped"))
    found = found.select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), "n_lines", F.array_sort("dropped").alias("dropped"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("__d")) & (rows["th"] == F.col("__h")), "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "th", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def drop_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Documents without the lines of recurring templates; the other columns stay, whatever their names.

    Lines are dropped, not documents: one of which nothing is left has the text "". Null texts stay null, lines without
    a token stay, rows that repeat lose the same lines. Whole texts count, however long. An empty table gives no rows.
    """
    found = recurring_lines(docs, min_docs).where("n_dropped > 0").select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), F.col("dropped").alias("__drop")).distinct()
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    out = keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h")), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
