"""Quality rules: document metrics, and lines that too many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, Words, batches, materialize, mix64, prefix_hash, span_hash

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def measure(texts: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """Metrics of whole texts; `line_text`, `line_hash`, `line_words`: their lines that have words, normalised."""
    w = Words(texts, fold=False)
    data, offsets, n = w.data, w.offsets, len(texts)
    prefix = prefix_hash(data)
    h = span_hash(prefix, w.start, w.end)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    out = {"n_words": w.count, "n_symbols": _per_text(_SYMBOL[data], offsets)}
    out["word_chars"] = np.bincount(w.text, points[w.end] - points[w.start], n).astype(np.int64)
    # Windows of words that stand twice or more in their text; every word in one of them counts once.
    repeat = np.zeros(n, np.int64)
    m = len(h) - window + 1
    if m > 0:
        g = np.zeros(m, np.uint64)
        for k in range(window):
            g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
        at = np.flatnonzero(w.text[:m] == w.text[window - 1 :])
        key = mix64(g[at] ^ mix64(w.text[at].astype(np.uint64) + np.uint64(1)))
        _, back, many = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[many[back] > 1]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        repeat = np.bincount(w.text, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)
    out["n_repeat_words"] = repeat
    # Lines: from the text's start or behind a line feed, to the next line feed or the text's end.
    feeds = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], feeds + 1]))
    start = start[start < len(data)]
    end = np.minimum(np.concatenate([feeds, [len(data)]])[np.searchsorted(feeds, start)], offsets[np.searchsorted(offsets, start, "right")]) if len(start) else start
    line = np.searchsorted(start, w.start, "right") - 1
    words = np.bincount(line, minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    filled = np.flatnonzero(words > 0)
    text = np.searchsorted(offsets, start[filled], "right") - 1
    raw = span_hash(prefix, start[filled], end[filled])
    key = mix64(raw ^ mix64(text.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    dup = np.ones(len(filled), np.int64)
    dup[first] = 0
    out["n_dup_lines"] = np.bincount(text, dup, n).astype(np.int64)
    folded = span_hash(prefix_hash(_FOLD[data]), w.start, w.end)
    place = np.arange(len(folded)) - (np.cumsum(words) - words)[line] if len(line) else line
    value = mix64(folded + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    heads = np.cumsum(words[filled]) - words[filled]
    out |= {"line_text": text, "line_words": words[filled].astype(np.int64), "line_hash": mix64(np.add.reduceat(value, heads)) if len(filled) else np.zeros(0, np.uint64)}
    return out


def metrics(docs: DataFrame, key: str = "doc_id", host: str = "source", window: int = 8) -> DataFrame:
    """(key, host, th, metrics, lines): lines as distinct normalised hashes with the words that they hold."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "__text", 2_000_000):
            x = measure(batch.column(2), window)
            n = batch.num_rows
            keys = np.lexsort((x["line_hash"], x["line_text"]))
            t, h, c = x["line_text"][keys], x["line_hash"][keys], x["line_words"][keys]
            new = np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])) if len(t) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            sums = np.add.reduceat(c, head) if len(head) else c
            sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(t[head], minlength=n))]).astype(np.int32)
            lines = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(h[head].view(np.int64)), pa.array(sums)], ["h", "w"]))
            cols = [batch.column(0), batch.column(1), batch.column(3), *[pa.array(x[f.split()[0]].astype(np.int64)) for f in FIELDS.split(", ")], lines]
            yield pa.record_batch(cols, ["__key", "__host", "th", *[f.split()[0] for f in FIELDS.split(", ")], "lines"])

    kind, at = docs.schema[key].dataType.simpleString(), docs.schema[host].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(host).alias("__host"), F.col("text").alias("__text"), F.xxhash64("text").alias("__th"))
    return rows.mapInArrow(run, f"__key {kind}, __host {at}, th long, {FIELDS}, lines array<struct<h:long,w:long>>")


def verdicts(docs: DataFrame, max_docs: int = 50, min_left: float = 0.5, min_words: int = 20, salts: int = 16) -> DataFrame:
    """Metrics and verdict of each row of documents.

    Lines are compared by their lower-case words. A line that more than `max_docs` documents of one host (column
    source; null is a host) have is removed. A document is depleted, and rejected, if less than the share `min_left`
    of its words or fewer than `min_words` words are left. base_failed: fewer than 20 words, or over 30 % of them in
    repeated eight-word windows; such a document is rejected as well. Null texts have no words. Repeated rows count as
    one document of their host. Lines over the limit are joined by salted keys, so a line that a third of all
    documents share is spread.
    """
    rows = materialize(metrics(docs), "line-metrics")
    lines = rows.select("__key", "__host", "th", F.explode("lines").alias("x")).select("__key", "__host", "th", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    many = lines.select("__host", "h", "__key").distinct().groupBy("__host", "h").count().where(F.col("count") > max_docs)
    many = many.select(F.col("__host").alias("__host2"), F.col("h").alias("__h2"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s2"))
    lines = lines.withColumn("__s", F.pmod(F.xxhash64("th", "__key"), F.lit(salts)).cast("int"))
    hit = lines.join(many, lines["__host"].eqNullSafe(F.col("__host2")) & (F.col("h") == F.col("__h2")) & (F.col("__s") == F.col("__s2")))
    lost = hit.select("__key", "th", "__host", "h", "w").distinct().groupBy(F.col("__key").alias("__k"), F.col("th").alias("__t"), F.col("__host").alias("__o")).agg(F.sum("w").alias("removed"), F.count(F.lit(1)).alias("n_removed_lines"))
    rows = rows.drop("lines").join(lost, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("th") == F.col("__t")) & F.col("__host").eqNullSafe(F.col("__o")), "left")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    kept = ~failed & (left >= F.col("n_words") * F.lit(min_left)) & (left >= min_words)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return rows.select(F.col("__key").alias("doc_id"), "__host", "th", *names, failed.alias("base_failed"), kept.alias("kept"), F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed_words"), F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"))


def judge(docs: DataFrame, **limits: float) -> DataFrame:
    """`verdicts` by doc_id alone: a row for each row of documents."""
    return verdicts(docs, **limits).drop("__host", "th")


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """Documents that the rules keep, with their columns; each row by its own verdict, also where rows share an id.

    Rows without words fail. Rows that repeat stay as often as they stand. An empty table gives no rows.
    """
    good = verdicts(docs, **limits).where("kept").select(F.col("doc_id").alias("__good"), F.col("__host").alias("__of"), F.col("th").alias("__th")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__good")) & docs["source"].eqNullSafe(F.col("__of")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    return docs.join(good, same, "left_semi")
