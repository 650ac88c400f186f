"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, html_extract, langid, linededup, packing, quality, secrets, simhash, vectors, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.roundtrip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLE_SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS key,
              len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT doc_id, source, text, unnest(ls) AS l FROM w)),
freq AS (SELECT source, key FROM ln GROUP BY source, key HAVING count(DISTINCT text) > 30),
lft AS (SELECT l.doc_id, sum(CASE WHEN f.key IS NULL THEN l.words ELSE 0 END) AS words FROM ln l LEFT JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.key = f.key GROUP BY l.doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lft.words, 0) AS words_left, w.source IN (SELECT source FROM freq) AS marked
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN lft ON w.doc_id = lft.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (marked AND (words_left < 10 OR words_left < 0.3 * n_words)) AS kept FROM f
"""


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op6_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '(?s).*?(?:\n|[.!?] |。|\z)'), lambda u: u <> '') AS us FROM documents),
l AS (SELECT doc_id, i, us[i + 1] AS unit, len(us) AS n, instr('0123456789abcdef', md5(us[i + 1])[1]) - 1 AS h FROM (SELECT *, unnest(range(0, len(us))) AS i FROM d)),
b AS (SELECT *, (5 * lag(h) OVER w + h) % 16 < 12 AND i > 0 AND i < n - 1 AS ends FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT doc_id, i, n, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM b WHERE ends OR i = n - 1),
c AS (SELECT doc_id, coalesce(was - 1, 0) AS chunk, i - coalesce(was - 1, 0) + 1 AS size FROM e WHERE n > 1),
t AS (SELECT c.doc_id, c.chunk, c.size, array_to_string(d.us[c.chunk + 1 : c.chunk + c.size], '') AS body FROM c JOIN d ON c.doc_id = d.doc_id),
m AS (SELECT doc_id, chunk, size, row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk, size) > 1 AS again FROM t WHERE length(body) >= 32),
g AS (SELECT DISTINCT doc_id, unnest(range(chunk, chunk + size)) AS i FROM m WHERE again),
k AS (SELECT l.doc_id, l.i, l.unit, lag(l.i) OVER w AS was, lag(l.unit) OVER w AS prev FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.i)),
o AS (SELECT k.doc_id, string_agg(CASE WHEN k.was < k.i - 1 AND gap.unit LIKE '%' || chr(10) AND k.prev NOT LIKE '%' || chr(10) THEN chr(10) ELSE '' END || k.unit, '' ORDER BY k.i) AS text
      FROM k LEFT JOIN l AS gap ON gap.doc_id = k.doc_id AND gap.i = k.i - 1 GROUP BY k.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN r.n IS NULL THEN d.text ELSE regexp_replace(coalesce(o.text, ''), '[ \n]+\z', '') END AS text,
       coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(d.us), 0)::BIGINT AS n_units, coalesce(r.n, 0)::BIGINT AS n_removed
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@query
def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op5_warc_roundtrip"] = """
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to
FROM (SELECT *, octet_length(encode(body)) >= 1000 AND page_id <> keeper AS again
      FROM (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages))
"""


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
