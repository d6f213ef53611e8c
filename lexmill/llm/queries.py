"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language, lattice, line_dedup, mixing, ngram_join, quality, secrets, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.digest(F.col("base"), secrets.KINDS), 256).alias("base_sha256"), secrets.digest(F.col("spans"), secrets.KINDS).alias("spans"),
    )


def capture_records(pages: DataFrame) -> DataFrame:
    """Two records of each page: its capture, page_id minutes after the epoch, and a 304 answer a thousand minutes later.

    The capture has its own entity tag (of url and html), date and type; the 304 answer repeats the tag and has a date of its own.
    """
    tag = F.md5(F.concat_ws("\x00", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    page = pages.select("page_id", "url", tag.alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("length"))
    kinds = F.explode(F.array(F.struct(F.lit("response").alias("kind"), F.lit(0).alias("later")), F.struct(F.lit("revisit").alias("kind"), F.lit(60_000).alias("later"))))
    rows = page.withColumn("x", kinds).withColumn("time", F.col("page_id") * 60 + F.col("x.later"))
    first = F.col("x.kind") == "response"
    headers = F.map_from_arrays(
        F.array(F.lit("ETag"), F.lit("Date"), F.lit("Content-Type"), F.lit("X-Cache")),
        F.array(F.concat(F.lit('"'), "digest", F.lit('"')), F.col("time").cast("string"), F.when(first, "text/html").otherwise("text/plain"), F.when(first, "MISS").otherwise("HIT")),
    )
    return rows.select(F.concat_ws("-", F.col("page_id").cast("string"), "x.kind").alias("record_id"), "page_id", "url", "time", "x.kind", headers.alias("headers"), F.when(first, F.col("digest")).alias("digest"), F.when(first, F.col("length")).alias("length"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(capture_records(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "page_id", "canonical", "kind", "resolution", "refers_to", "body_digest", "body_length", headers.alias("headers"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Where the sources of the test tables are said to come from.
BOOKS = [f"src{k}" for k in range(15, 20)]
WEIGHTS = {("web",): 0.7, ("books",): 0.3, ("web", "en"): 2.0, ("books", "en"): 2.0}


def domain_of(source):
    return F.when(source.isin(BOOKS), "books").otherwise("web")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mix(docs, domain_of(F.col("source")), 0.5, WEIGHTS).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.identify(rows, model, keep_text=False)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_lm_scoring, op5_secret_scans, op6_warc, op7_quality_rules, op8_mixing, op9_language_id, op10_html_extraction)}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_line_dedup": r"""
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
worded AS (SELECT doc_id, k, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM lines),
tokens AS (SELECT doc_id, k, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM worded WHERE len(w) > 0),
classes AS (SELECT s, row_number() OVER () AS c, min(doc_id * 1000000 + k) AS f FROM tokens GROUP BY s),
parts AS (SELECT c, f, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, a.f AS fa, b.f AS fb, a.n AS na, b.n AS nb, count(*) AS o FROM parts a JOIN parts b ON a.t = b.t AND a.f < b.f GROUP BY ALL),
later AS (SELECT DISTINCT b AS c FROM pairs WHERE 4 * o >= 3 * (na + nb - o)),
gone AS (SELECT t.doc_id, t.k FROM tokens t JOIN classes USING (s) LEFT JOIN later ON later.c = classes.c WHERE later.c IS NOT NULL OR t.doc_id * 1000000 + t.k > f)
SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '') AS text
FROM lines l LEFT JOIN gone g USING (doc_id, k) GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM links UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.r, s.doc_id)) AS component_id FROM sets s LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1) m USING (doc_id)""",
    "op3_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS t FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS t FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT doc_id, item_id, k, p FROM dw JOIN iw USING (k, t)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.l, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, url, md5(coalesce(url, '') || chr(0) || coalesce(html, '')) AS digest, coalesce(strlen(html), 0)::BIGINT AS length, regexp_replace(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '#.*$', '') AS u FROM pages),
c AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?([^?]*)(?:\?(.*))?$', ['a', 'b', 'c', 'd', 'e']) AS x FROM p),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(x.e, '&'), lambda v: v <> '' AND NOT regexp_matches(v, '(?i)^(?:utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(?:=|$)'))), '&') AS query FROM c),
k AS (SELECT page_id, digest, length, CASE WHEN x.a = '' THEN u ELSE regexp_replace(lower(x.a), '^https$', 'http') || '://' || regexp_replace(lower(x.b), '^www\.|\.$', '', 'g') || regexp_replace(x.c, '^:(?:80|443)?$', '') || regexp_replace(x.d, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM q),
r AS (SELECT *, page_id * 60 AS t, page_id::VARCHAR || '-response' AS id FROM k),
v AS (SELECT *, page_id * 60 + 60000 AS t, page_id::VARCHAR || '-revisit' AS id FROM k),
j AS (SELECT v.id, v.page_id, v.canonical, v.digest, v.t, arg_max(r.id, [r.t, r.page_id]) AS rid, arg_max(r.digest, [r.t, r.page_id]) AS rdigest, arg_max(r.length, [r.t, r.page_id]) AS rlength FROM v LEFT JOIN r ON r.canonical = v.canonical AND r.t <= v.t GROUP BY ALL)
SELECT id AS record_id, page_id, canonical, 'response' AS kind, CASE WHEN canonical IS NULL THEN 'unusable' ELSE 'response' END AS resolution, NULL::VARCHAR AS refers_to, CASE WHEN canonical IS NOT NULL THEN digest END AS body_digest, CASE WHEN canonical IS NOT NULL THEN length END AS body_length,
'content-type=text/html;date=' || t || ';etag="' || digest || '";x-cache=MISS' AS headers FROM r
UNION ALL SELECT id, page_id, canonical, 'revisit', CASE WHEN canonical IS NULL THEN 'unusable' WHEN rid IS NULL THEN 'no-response' WHEN digest = rdigest THEN 'resolved' ELSE 'mismatch' END, CASE WHEN digest = rdigest THEN rid END, CASE WHEN digest = rdigest THEN rdigest END, CASE WHEN digest = rdigest THEN rlength END,
CASE WHEN digest = rdigest THEN 'content-type=text/html;date=' || t || ';etag="' || digest || '";x-cache=MISS' ELSE 'content-type=text/plain;date=' || t || ';etag="' || digest || '";x-cache=HIT' END FROM j""",
}
