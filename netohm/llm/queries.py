"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.llm import (
    decontamination,
    line_dedup,
    order_minhash,
    packing,
    quality_classifier,
    robust_outliers,
    spelling,
    substring_dedup,
    token_counts,
    token_files,
    tokens,
    toxicity,
    warc,
    whitening,
)
from netohm.llm.work import shared_dir, table


def _rest(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.quality_rules(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(_rest(3) != 1)
    out = toxicity.score(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (_rest(3) == 1).alias("held_out"), "score", "predicted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark)}/netohm-{uuid.uuid4().hex}/token_files"
    token_files.write_token_files(table(spark, sf_dir, "documents"), target, tokens.default_path(), end_id=2)
    return token_files.read_token_files(spark, target)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return out.select("page_id", "record_id", "warc_type", "refers_to", "target_uri", "block_digest", "payload_digest", "content_length")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=0)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(_rest(5) != 0)
    out = quality_classifier.classify(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (_rest(5) == 0).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damaged=31)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokens.default_path())


QUERIES = {
    f.__name__: f
    for f in (
        op1_robust_outliers, op2_toxicity, op3_token_files, op4_substring_dedup, op5_decontamination,
        op6_warc_derivatives, op7_line_dedup, op8_packing, op9_order_minhash, op10_quality_classifier,
        op11_whitening, op12_spelling_variants, op13_token_counts,
    )
}

_UUID = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'"

_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<title[^>]*>.*?</title>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'),
 '(?i)</(p|div|li|h[1-6]|tr|ul|ol|article|nav)>|<br ?/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
 '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""

SQL = {
    "op6_warc_derivatives": rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, {_UUID.format("md5('response|' || page_id || '|' || url)")} AS rid, 'sha1:' || sha1(html) AS payload_digest, {_PLAIN} AS txt FROM p),
m AS (SELECT *, 'title: ' || regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\r\n]+', ' ', 'g') || e'\r\nlanguage: '
  || regexp_extract(html, '(?i)<html[^>]* lang=.([A-Za-z-]+)', 1) || e'\r\nlinks: ' || len(regexp_extract_all(html, '(?i)<a [^>]*href='))
  || e'\r\ntext-chars: ' || length(txt) || e'\r\nsource-payload-digest: ' || payload_digest
  || e'\r\nsource-headers: HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: ' || strlen(html) || e'\r\n' AS meta FROM r)
SELECT page_id, {_UUID.format("md5('metadata|' || rid)")} AS record_id, 'metadata' AS warc_type, rid AS refers_to, url AS target_uri,
  'sha1:' || sha1(meta) AS block_digest, payload_digest, CAST(strlen(meta) AS BIGINT) AS content_length FROM m
UNION ALL
SELECT page_id, {_UUID.format("md5('conversion|' || rid)")}, 'conversion', rid, url, 'sha1:' || sha1(txt), payload_digest, CAST(strlen(txt) AS BIGINT) FROM m
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS i FROM d WHERE text IS NOT NULL),
t AS (SELECT *, trim(raw, e' \t\n\x0b\x0c\r') AS line FROM l),
s AS (SELECT doc_id, i, line, len(string_split_regex(line, '[\x20\x09-\x0D]+')) AS n FROM t WHERE line <> ''),
w AS (SELECT doc_id, i, line, n, lead(line) OVER x AS line2, lead(i) OVER x AS i2, lead(n) OVER x AS n2 FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER x AS k, first_value(doc_id) OVER x AS fd, first_value(i) OVER x AS f1, first_value(i2) OVER x AS f2
  FROM w WHERE line2 IS NOT NULL AND n + n2 >= 10 WINDOW x AS (PARTITION BY line, line2 ORDER BY doc_id, i)),
g AS (SELECT doc_id, i FROM r WHERE k > 1 AND NOT (doc_id = fd AND i IN (f1, f2)) UNION SELECT doc_id, i2 FROM r WHERE k > 1 AND NOT (doc_id = fd AND i2 IN (f1, f2))
  UNION SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM s WHERE n >= 50) WHERE k > 1),
k AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.i) AS kept FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_deleted,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.kept, '')) END AS text_md5
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
""",
}
