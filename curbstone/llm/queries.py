"""The queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstone.llm.common import table
from curbstone.llm.descent import near_vectors
from curbstone.llm.divergence import LEAST_DOCS, TERM_RANKS, audit
from curbstone.llm.forest import search
from curbstone.llm.lexical import TOP
from curbstone.llm.lexical import search as lexical_search
from curbstone.llm.lines import LEAST_PAGES, RATIO, dedup_lines
from curbstone.llm.mixing import mix
from curbstone.llm.near import near_duplicates
from curbstone.llm.packing import pack
from curbstone.llm.products import NEIGHBOURS
from curbstone.llm.products import search as product_search
from curbstone.llm.quality import classify
from curbstone.llm.quality import train as train_quality
from curbstone.llm.secrets import find_secrets
from curbstone.llm.sharding import shard_by_ring
from curbstone.llm.warc import archive_folder, read_packages, write_packages

#: The vocabulary that packing counts tokens by.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mix(table(spark, sf_dir, "documents"))
    same = ["h", "digest", "copy", "doc_id", "size", "source_size", "target"]
    return pieces.groupBy(*same).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).drop("h", "digest", "copy")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    packages = write_packages(table(spark, sf_dir, "pages"), folder)
    return read_packages(packages, folder).drop("url", "payload")


def op6_shard_by_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_ring(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_quality_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rated = classify(docs, train_quality(docs, table(spark, sf_dir, "labels")), with_text=False)
    return rated.select("doc_id", *(F.round(p, 6).alias(p) for p in ("p_good", "p_toxic")), "keep")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, nullif(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '') AS key FROM lines),
pages AS (SELECT source, count(*) AS site_pages FROM documents GROUP BY source),
seen AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM keyed WHERE key IS NOT NULL GROUP BY source, key),
bad AS (
  SELECT s.source, s.key FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
  WHERE s.n >= {LEAST_PAGES} AND s.n > {RATIO} * p.site_pages),
marked AS (
  SELECT k.doc_id, k.line, k.pos, b.key IS NOT NULL AS dropped
  FROM keyed k LEFT JOIN bad b ON k.key = b.key AND k.source IS NOT DISTINCT FROM b.source),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text, count(*) AS n_lines,
    count(*) FILTER (dropped) AS n_dropped
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, k.text, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


#: The SHA-1 in base32: four letters for every five hex digits.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (1 + ((('0x' || substr(hex, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

#: What links reach, from pairs (a, b) and all ids: links(a, b) both ways.
REACH = """
reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
tops AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

#: All pairs that share a shingle, compared in full; for the small tables of the SQL check.
OP7_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
ids AS (SELECT doc_id AS id, len(s) AS n FROM sets),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
{REACH}
SELECT i.id AS doc_id, i.n::BIGINT AS n_shingles, t.component_id, i.id = t.component_id AS kept FROM ids i JOIN tops t USING (id)
"""

OP10_SQL = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM tops
"""

OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w))
SELECT query_id, (row_number() OVER r)::INT AS rank, vec_id, score FROM s
WINDOW r AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER r <= {NEIGHBOURS}
"""


def _terms_sql(text: str, others: str) -> str:
    return rf"unnest(regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{others}\x5B-\x60\x7B-\x7F]+'))"


_NO_TERM = r"\x00-\x2F\x3A-\x40"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, {_terms_sql("text", _NO_TERM)} AS t FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
whole AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM sizes),
items AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, {_terms_sql("text", _NO_TERM)} AS t FROM benchmark)),
tf AS (SELECT doc_id, t, count(*) AS tf FROM t WHERE t IN (SELECT t FROM items) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * (SELECT n FROM whole) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY t),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * s.n * whole.n) // whole.l))))::BIGINT AS score
  FROM items JOIN tf USING (t) JOIN w USING (t) JOIN sizes s USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER r)::INT AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER r <= {TOP}
"""

_NO_LETTER = r"\x00-\x40"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
t AS (SELECT doc_id, lang, source, {_terms_sql("text", _NO_LETTER)} AS t FROM d),
kept AS (SELECT lang, t FROM t GROUP BY lang, t HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, t, count(*) AS n FROM t JOIN kept USING (lang, t) GROUP BY lang, source, t),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN seen USING (lang, source) GROUP BY lang, source),
ln AS (SELECT lang, sum(n)::BIGINT AS total FROM seen GROUP BY lang),
p AS (
  SELECT lang, source, t, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, t)),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (any_value(total) + any_value(v)) AS q FROM seen JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, t),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER r)::INT AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
WINDOW r AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER r <= {TERM_RANKS}
"""


def queries() -> dict:
    found = (
        op1_mix_sources,
        op2_prefix_forest,
        op3_secret_scan,
        op4_line_dedup,
        op5_warc_packages,
        op6_shard_by_ring,
        op7_minhash_dedup,
        op8_pack_windows,
        op9_quality_posterior,
        op10_nn_descent,
        op11_norm_buckets,
        op12_block_max,
        op13_source_divergence,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": OP4_SQL, "op5_warc_packages": OP5_SQL, "op7_minhash_dedup": OP7_SQL, "op10_nn_descent": OP10_SQL, "op11_norm_buckets": OP11_SQL, "op12_block_max": OP12_SQL, "op13_source_divergence": OP13_SQL,
    }
