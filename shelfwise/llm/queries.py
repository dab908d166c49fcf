"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.decontaminate import benchmark_hits
from shelfwise.llm.hard_negatives import hard_negatives
from shelfwise.llm.host_rules import host_quality
from shelfwise.llm.lattice_lm import lattice_scores
from shelfwise.llm.line_dedup import drop_common_lines
from shelfwise.llm.ngram_join import ngram_jaccard_components
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.pii import find_pii
from shelfwise.llm.quality_gbdt import quality_scores
from shelfwise.llm.ranked_search import ranked_documents
from shelfwise.llm.secrets import find_secrets
from shelfwise.llm.sharding import extendible_shards
from shelfwise.llm.text import table
from shelfwise.llm.toxicity import toxicity_scores

SHARD_BYTES = 16 << 20

#: Words of a text, as DuckDB: A-Z lowered, split at ASCII white space.
SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP1_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g
  FROM w),
k AS MATERIALIZED (SELECT list_sort(g) AS g, min(doc_id) AS d, count(*) AS n_class FROM s WHERE len(g) > 0 GROUP BY 1),
e AS MATERIALIZED (SELECT d, len(g) AS n, unnest(g) AS x FROM k),
p AS MATERIALIZED (
  SELECT a.d AS a, b.d AS b FROM e a JOIN e b ON a.x = b.x AND a.d < b.d
    AND b.n * 10 >= a.n * 9 AND a.n * 10 >= b.n * 9
  GROUP BY a.d, b.d, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
near AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(d, r) AS (SELECT d, d FROM k UNION SELECT reach.d, near.b FROM reach JOIN near ON near.a = reach.r),
comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id,
  CAST(coalesce(k.n_class, 1) AS BIGINT) AS n_class
FROM s LEFT JOIN k ON list_sort(s.g) = k.g LEFT JOIN comp ON comp.d = k.d
"""

def op2_zstd_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), single_words=True)


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), length=2048)


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents"), host="source")


#: Words of a text in DuckDB, as they stand.
SQL_RAW_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP9_SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, source AS host, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS MATERIALIZED (SELECT r, {SQL_RAW_WORDS.format("text")} AS w FROM t),
five AS MATERIALIZED (
  SELECT r, unnest(range(1, len(w) - 3)) AS i,
    unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)]) AS g
  FROM w WHERE len(w) > 4),
twice AS (SELECT r, i FROM five QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM line
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS MATERIALIZED (
  SELECT t.doc_id, t.host, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
m AS MATERIALIZED (
  SELECT *, unnest([{{'rule': 'symbols', 'x': n_symbols / greatest(n_words, 1), 'strict': 0.1, 'loose': 0.3}},
    {{'rule': 'dup_lines', 'x': n_dup_lines / greatest(n_lines, 1), 'strict': 0.3, 'loose': 0.6}},
    {{'rule': 'repeats', 'x': n_repeat_words / greatest(n_words, 1), 'strict': 0.1, 'loose': 0.2}},
    {{'rule': 'long_words', 'x': word_chars / greatest(n_words, 1), 'strict': 15, 'loose': 30}}], recursive := true),
    row_number() OVER () AS k
  FROM (SELECT *, row_number() OVER () AS r FROM s)),
h AS (SELECT host, rule, count(*) AS n, sum(CAST(x > strict AS INTEGER)) AS f FROM m GROUP BY host, rule),
a AS (SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2
    - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * (count(*) - 1) / sum(n) AS tau2 FROM h GROUP BY rule),
b AS (SELECT rule, mean, CASE WHEN tau2 <= 0 THEN 1e6
    ELSE least(greatest(mean * (1 - mean) / tau2 - 1, 1.0), 1e6) END AS strength FROM a),
v AS (SELECT host, rule, (f + mean * strength) / (n + strength) AS rate, mean FROM h JOIN b USING (rule)),
j AS (SELECT m.r, bool_or(m.x > CASE WHEN v.rate > 0.2 AND v.rate > 1.5 * v.mean THEN strict ELSE loose END) AS beyond
  FROM m JOIN v ON m.rule = v.rule AND m.host IS NOT DISTINCT FROM v.host GROUP BY m.r)
SELECT s.* EXCLUDE (r), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT beyond AS kept
FROM (SELECT *, row_number() OVER () AS r FROM s) s JOIN j USING (r)
"""


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP10_SQL = f"""
WITH t AS MATERIALIZED (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS MATERIALIZED (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS b, count(*) AS c, min(h) = max(h) AS single
  FROM t, range(0, 25) x(d) GROUP BY ALL),
leaf AS (SELECT n.* FROM p n LEFT JOIN p up ON up.d = n.d - 1 AND up.p = n.p >> 1
  WHERE (n.b <= {SHARD_BYTES} OR n.single) AND (n.d = 0 OR NOT (up.b <= {SHARD_BYTES} OR up.single)))
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), CAST(d AS INTEGER), '0') END AS shard,
  CAST(d AS INTEGER) AS depth, CAST(b AS BIGINT) AS shard_bytes, c AS shard_rows
FROM t JOIN leaf ON leaf.p = t.h >> (60 - leaf.d)
"""


def op11_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: A line less the white space at its ends, A-Z lowered, as DuckDB.
SQL_LINE_KEY = r"translate(regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (
  SELECT r, doc_id, i, line, {SQL_LINE_KEY.format("line")} AS k
  FROM (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM t)),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY l.r, l.doc_id
"""


def op12_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label, scale=256, positives=5, negatives=5, low=80, high=100)


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""


def op13_rmq_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


#: Maximal runs of letters, digits and anything beyond ASCII, A-Z lowered, as DuckDB.
SQL_TERMS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {SQL_TERMS.format("text")} AS w FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({SQL_TERMS.format("text")}) AS term FROM benchmark),
s AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, s GROUP BY term, n_docs),
m AS MATERIALIZED (SELECT r, doc_id, 100 - 90 + (90 * len(w) * n_docs) // n_terms AS m FROM t, s WHERE len(w) > 0),
sc AS MATERIALIZED (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 10
"""

_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_zstd_secret_scan": op2_zstd_secret_scan,
    "op3_subword_lattice": op3_subword_lattice,
    "op4_toxic_segments": op4_toxic_segments,
    "op5_pigeonhole_decontamination": op5_pigeonhole_decontamination,
    "op6_quality_trees": op6_quality_trees,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_weak_supervision_pii": op8_weak_supervision_pii,
    "op9_host_rules": op9_host_rules,
    "op10_extendible_sharding": op10_extendible_sharding,
    "op11_levelled_line_dedup": op11_levelled_line_dedup,
    "op12_strassen_hard_negatives": op12_strassen_hard_negatives,
    "op13_rmq_ranked_search": op13_rmq_ranked_search,
}

_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op9_host_rules": OP9_SQL,
    "op10_extendible_sharding": OP10_SQL,
    "op11_levelled_line_dedup": OP11_SQL,
    "op12_strassen_hard_negatives": OP12_SQL,
    "op13_rmq_ranked_search": OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_RUN)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
