"""The operators as registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, htmltext, linedrop, mixing, ngram, quality, sharding, simhash, suffixdedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedrop.recurring_lines(table(spark, sf_dir, "documents")).drop("th")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_report(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_report(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("source", "reps")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sharding, op2_toxicity, op3_line_dedup, op4_lm_scoring, op5_html_extraction, op6_quality_rules, op7_suffix_dedup, op8_mixing, op9_decontamination, op10_simhash_dedup)
    return {f.__name__: f for f in every}


_HASH = "('0x' || substr(md5({}), 1, 13))::BIGINT"


def _op1() -> str:
    step = "c"
    for _ in range(8):
        step = f"xor({step} >> 1, CASE WHEN ({step}) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    key = "coalesce(doc_id::VARCHAR, chr(0) || 'null')"
    cost = lambda n: f"(SELECT list_sort([{', '.join(f'''{{'cost': -ln(({_HASH.format(key + f" || '|{i}'")} + 0.5) / 4503599627370496.0), 'shard': {i}}}''' for i in range(n))}])[1].shard)"
    return f"""
WITH RECURSIVE step(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, length(x) // 2 AS n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT) AS v FROM d),
c AS (SELECT doc_id, (n + 1)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, v), lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1])), 4294967295::BIGINT)::BIGINT AS text_crc32 FROM b, tab),
s AS (SELECT *, {cost(16)}::INT AS shard, {cost(17)}::INT AS grown_shard, {_HASH.format(key + " || '|' || text_crc32 || '|' || size || '|slot'")} AS h FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM s"""


_OP8 = f"""
WITH n AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
r AS (SELECT *, {_HASH.format("coalesce(doc_id::VARCHAR, chr(0) || 'null') || '|' || size || '|mix-1'")} AS h FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM r GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS "left" FROM c
    WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(rest / "left", (ratio, coalesce(source, ''))) AS level FROM l WHERE rest / "left" <= ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN cap ELSE weight * level END::DOUBLE AS target FROM l, v),
m AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, target - whole * source_size AS missing, size > (target - whole * source_size) * 0.02 AS big FROM m),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, big ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS mid,
    sum(CASE WHEN big THEN size END) OVER (PARTITION BY source) AS long_size FROM g),
f AS (SELECT *, coalesce(big AND mid <= missing * long_size / source_size, false) AS first FROM p),
a AS (SELECT *, coalesce(sum(CASE WHEN first THEN size END) OVER (PARTITION BY source), 0) AS settled FROM f)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN size > 0 AND (first OR (NOT big AND mid <= missing - settled)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM a"""

_OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM d)),
c AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS m FROM g WHERE k = 8),
v AS (SELECT r, count(DISTINCT i + j) AS n FROM h, range(8) t(j) WHERE m > 1 GROUP BY r),
l AS (SELECT r, source, doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT r, source, doc_id, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM f GROUP BY r),
o AS (SELECT source, x FROM f GROUP BY source, x HAVING count(DISTINCT doc_id) > 50),
e AS (SELECT f.r, sum(len(f.x)) AS n, count(DISTINCT f.x) AS k FROM f JOIN o ON f.x = o.x AND f.source IS NOT DISTINCT FROM o.source GROUP BY f.r),
t AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
    coalesce(e.n, 0)::BIGINT AS n_removed_words, coalesce(e.k, 0)::BIGINT AS n_removed_lines
  FROM d LEFT JOIN c USING (r) LEFT JOIN v USING (r) LEFT JOIN u USING (r) LEFT JOIN e USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= 0.5 * n_words AND n_words - n_removed_words >= 20 AS kept, n_removed_words, n_removed_lines
FROM b"""

_OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
k AS (SELECT doc_id, n, c, substr(x, (2000 * c + 1)::INT, 2098) AS y FROM (SELECT doc_id, x, n, unnest(range(0, n // 1000 + 1)) AS c FROM b)),
z AS (SELECT doc_id, n, 1000 * c + j AS i, substr(y, (2 * j + 1)::INT, 100) AS s FROM (SELECT *, unnest(range(0, greatest(0, least(1000, n - 1000 * c)))) AS j FROM k)),
s AS (SELECT doc_id, i, s FROM z WHERE i + 50 <= n),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM s),
e AS (SELECT doc_id, i, 1 AS k FROM m WHERE hit UNION ALL SELECT doc_id, i + 50, -1 FROM m WHERE hit),
p AS (SELECT doc_id, i, sum(k) AS k FROM e GROUP BY doc_id, i),
q AS (SELECT z.doc_id, z.i, substr(s, 1, 2) AS y, sum(coalesce(k, 0)) OVER (PARTITION BY z.doc_id ORDER BY z.i) > 0 AS gone FROM z LEFT JOIN p ON p.doc_id = z.doc_id AND p.i = z.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM q),
a AS (SELECT doc_id, sum(gone::INT) AS n_removed, sum(head::INT) AS n_spans, string_agg(CASE WHEN NOT gone THEN y END, '' ORDER BY i) AS kept FROM r GROUP BY doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN a USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _op1(), "op6_quality_rules": _OP6, "op7_suffix_dedup": _OP7, "op8_mixing": _OP8}
