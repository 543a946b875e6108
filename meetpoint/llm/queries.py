"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .common import WORD, table
from .decontaminate import find_contamination
from .fim import fill_in_middle, restored
from .langid import identify_languages
from .licenses import find_licenses
from .mixing import mix_sources
from .multiindex import link_vectors
from .pii import find_pii
from .runs import periodic_runs
from .secrets import find_secrets
from .simhash import near_duplicates
from .suffix_tree import score_texts
from .topk import exact_top_k
from .warc import archive_round_trip


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs, with a periodic tail in a tenth of the texts, chosen by the id's crc32."""
    c = F.col
    words = docs.select("doc_id", "text", F.crc32(F.coalesce(c("doc_id").cast("string"), F.lit(""))).alias("h")).withColumn("g", F.expr("h div 10"))
    some = words.withColumn("w", F.when(c("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    some = some.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("a", c("g") % c("n")).withColumn("times", 3 + c("g") % 8)
    some = some.withColumn("p", F.expr("1 + (n - a) div times"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int(times))), 1, int(n - a))")
    return some.select("doc_id", F.when(c("n").isNull(), c("text")).otherwise(F.array_join(F.concat(F.expr("slice(w, 1, int(a))"), tail), " ")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda x: F.struct(x.length.alias("length"), (-x.start).alias("start"), (-x.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.format_string("%d,%d,%d\n", x.start, x.length, x.period)), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def queries() -> dict:
    return {"op1_topk": op1_topk, "op2_warc": op2_warc, "op3_secrets": op3_secrets, "op4_langid": op4_langid, "op5_licenses": op5_licenses, "op6_pii": op6_pii, "op7_simhash": op7_simhash, "op8_decontaminate": op8_decontaminate, "op9_suffix_tree": op9_suffix_tree, "op10_mix": op10_mix, "op11_runs": op11_runs, "op12_multiindex": op12_multiindex, "op13_fim": op13_fim}


OP1_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_page < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page < page_id THEN first_page END AS refers_to
FROM d LEFT JOIN g ON g.payload_digest = d.payload_digest AND payload_bytes >= 100
"""

OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight,
             source_size * CAST(2.0 AS DOUBLE) AS most FROM s),
o AS (SELECT *, most / weight AS ratio FROM w),
fill AS (  -- the level if the sources with smaller ratios stop at their most
  SELECT ratio, (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s)
          - coalesce((SELECT sum(b.most) FROM o b WHERE b.ratio < a.ratio), 0))
          / (SELECT sum(b.weight) FROM o b WHERE b.ratio >= a.ratio) AS level,
         coalesce((SELECT max(b.ratio) FROM o b WHERE b.ratio < a.ratio), -1) AS below
  FROM (SELECT DISTINCT ratio FROM o) a),
level AS (SELECT min(level) AS level FROM fill WHERE below < level AND level <= ratio),
t AS (SELECT source, source_size, least(weight * level, most) AS target FROM w, level),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
u AS (SELECT docs.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM docs)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken
FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source
"""


OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
m AS (SELECT a, min(b) AS m FROM reached GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), k, 8) AS BIGINT)) AS h
  FROM documents),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict:
    return {"op1_topk": OP1_SQL, "op2_warc": OP2_SQL, "op10_mix": OP10_SQL, "op12_multiindex": OP12_SQL, "op13_fim": OP13_SQL}
