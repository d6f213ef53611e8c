"""The query catalogue: one query for each operator over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from ..operators import bpe, clean, dedup, evaluate, lid, mixture, report
from ..operators.tables import cut_lineage
from ..sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def r6(c):
    return F.bround(c, 6)


def doc_text():
    return F.col("text")


WORD = r"[\p{L}\p{N}]+"

def by_digest():
    return [F.col("text_sha256"), F.col("doc_id")]



def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("bytes"))


# --- normalization -------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '[\n\x{2028}\x{2029}]'), lambda l: trim(regexp_replace(l, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS clean FROM documents""")
def normalize_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.squeeze_lines(T.nfc(T.line_feeds(doc_text()))).alias("clean"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]'))::BIGINT AS removed, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g') AS clean FROM documents")
def control_char_strip(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.count(doc_text(), T.CONTROL).alias("removed"), F.regexp_replace("text", T.CONTROL, "").alias("clean"))


@query()
def redact_personal_data(spark, sf_dir):
    """E-mail addresses, then IPv4 addresses, with look-around; no SQL here has that."""
    d = T.normalize(docs(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "tx.*", "clean_text")


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)\[\[|\]\]|\{\{|\}\}'))::BIGINT AS markers FROM pages")
def wiki_marker_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.count(F.col("html"), r"(?i)\[\[|\]\]|\{\{|\}\}").alias("markers"))


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE trim(CASE WHEN strpos(reverse(substr(text, 1, 2000)), chr(10)) > 0 AND 2000 - strpos(reverse(substr(text, 1, 2000)), chr(10)) >= 1000 THEN substr(text, 1, 2000 - strpos(reverse(substr(text, 1, 2000)), chr(10))::BIGINT) ELSE substr(text, 1, 2000) END, chr(10) || chr(32)) END AS cut FROM documents WHERE strpos(text, chr(10) || chr(10)) = 0")
def truncate_documents(spark, sf_dir):
    return docs(spark, sf_dir).where(~F.contains("text", F.lit("\n\n"))).select("doc_id", T.cut(doc_text(), 2000).alias("cut"))


@query()
def truncate_all_documents(spark, sf_dir):
    """truncate_documents over the whole table, texts with blank lines too; tested against a brute-force version."""
    return docs(spark, sf_dir).select("doc_id", T.cut(doc_text(), 2000).alias("cut"))


# --- measures and cascade ------------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, length(text)::BIGINT AS char_length, strlen(text)::BIGINT AS byte_length, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS word_count FROM documents")
def text_length_metrics(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in T.lengths(doc_text()).items()])


@query(r"SELECT doc_id, round_even(len(regexp_extract_all(text, '(?i)https?://\S+')) / greatest(1.0, length(text) / 1000), 6)::DOUBLE AS url_density, len(regexp_extract_all(text, '<[^>]{1,500}>'))::BIGINT AS html_tags FROM documents")
def url_html_density(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(T.url_density(doc_text())).alias("url_density"), T.html_tags(doc_text()).alias("html_tags"))


@query(r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS ns, len(regexp_extract_all(text, '\p{L}')) AS l, len(regexp_extract_all(text, '[\x{400}-\x{481}\x{48a}-\x{52f}]')) AS cy, len(regexp_extract_all(text, '[A-Za-z]')) AS la, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS an, len(regexp_extract_all(text, '[ҢңӨөҮү]')) AS sp FROM documents)
SELECT doc_id, round_even(CASE WHEN ns > 0 THEN l / ns ELSE 0 END, 6)::DOUBLE AS alpha_ratio, round_even(CASE WHEN l > 0 THEN cy / l ELSE 0 END, 6)::DOUBLE AS cyrillic_ratio, round_even(CASE WHEN l > 0 THEN la / l ELSE 0 END, 6)::DOUBLE AS latin_ratio, round_even(CASE WHEN ns > 0 THEN (ns - an) / ns ELSE 0 END, 6)::DOUBLE AS special_ratio, sp::BIGINT AS specific FROM c""")
def script_profile(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in T.script_counts(doc_text()).items()])
    c = F.col
    return d.select("doc_id", r6(T.ratio(c("letters"), c("nonspace"))).alias("alpha_ratio"), r6(T.ratio(c("cyrillic"), c("letters"))).alias("cyrillic_ratio"), r6(T.ratio(c("latin"), c("letters"))).alias("latin_ratio"), r6(T.ratio(c("special"), c("nonspace"))).alias("special_ratio"), "specific")


WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(column: str) -> str:
    """SQL of a text without white space of any kind at its ends."""
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


LINES_SQL = f"lines AS (SELECT doc_id, {stripped('l')} AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)), lc AS (SELECT doc_id, l, count(*) AS n FROM lines WHERE length(l) >= 20 GROUP BY 1, 2), lr AS (SELECT doc_id, sum(n) AS total, coalesce(sum(n) FILTER (n > 1), 0) AS rep FROM lc GROUP BY 1)"
GRAMS_SQL = rf"w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}')[1:50000] AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 10), gc AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2), gr AS (SELECT doc_id, sum(n) AS total, coalesce(sum(n) FILTER (n > 1), 0) AS rep FROM gc GROUP BY 1)"


@query(f"WITH {LINES_SQL} SELECT d.doc_id, coalesce(total, 0)::BIGINT AS lines, coalesce(rep, 0)::BIGINT AS repeated, CASE WHEN total >= 2 THEN round_even(rep / total, 6) ELSE 0 END::DOUBLE AS ratio FROM documents d LEFT JOIN lr USING (doc_id)")
def repeated_line_ratio(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.repeated_line_counts(doc_text()).alias("c"))
    return d.select("doc_id", F.col("c.total").alias("lines"), F.col("c.repeated").alias("repeated"), F.when(F.col("c.total") >= 2, r6(F.col("c.repeated") / F.col("c.total"))).otherwise(0.0).alias("ratio"))


@query(f"WITH {GRAMS_SQL} SELECT d.doc_id, coalesce(total, 0)::BIGINT AS ngrams, coalesce(rep, 0)::BIGINT AS repeated, CASE WHEN total > 0 THEN round_even(rep / total, 6) ELSE 0 END::DOUBLE AS ratio FROM documents d LEFT JOIN gr USING (doc_id)")
def repeated_ngram_ratio(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.repeated_ngram_counts(doc_text()).alias("c"))
    return d.select("doc_id", F.col("c.total").alias("ngrams"), F.col("c.repeated").alias("repeated"), F.when(F.col("c.total") > 0, r6(F.col("c.repeated") / F.col("c.total"))).otherwise(0.0).alias("ratio"))


@query()
def gzip_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(T.gzip_ratio(doc_text())).alias("gzip_ratio"))


CASCADE_SQL = rf"""{LINES_SQL}, {GRAMS_SQL}, m AS (SELECT doc_id, source, length(text) AS n, len(regexp_extract_all(text, '(?i)https?://\S+')) / greatest(1.0, length(text) / 1000) AS urls, len(regexp_extract_all(text, '<[^>]{{1,500}}>')) AS tags, length(regexp_replace(text, '\s', '', 'g')) AS ns, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]')) AS an FROM documents),
c AS (SELECT m.doc_id, m.source, CASE WHEN n < 100 THEN 'too_short' WHEN urls > 2 THEN 'url_density' WHEN tags > 2 THEN 'html_tags' WHEN CASE WHEN ns > 0 THEN letters / ns ELSE 0 END < 0.45 THEN 'low_alpha_ratio' WHEN CASE WHEN ns > 0 THEN (ns - an) / ns ELSE 0 END > 0.2 THEN 'high_special_ratio'
WHEN coalesce(lr.total, 0) >= 2 AND lr.rep / lr.total > 0.35 THEN 'repeated_lines' WHEN coalesce(gr.total, 0) > 0 AND gr.rep / gr.total > 0.25 THEN 'repeated_ngrams' ELSE 'accepted' END AS reason FROM m LEFT JOIN lr USING (doc_id) LEFT JOIN gr USING (doc_id))"""


def reasons(spark, sf_dir):
    """The generic cascade on texts as they are, without the compression gate."""
    d = docs(spark, sf_dir).withColumns({**{k: v for k, v in T.lengths(doc_text()).items()}, "urls": T.url_density(doc_text()), "tags": T.html_tags(doc_text()), **T.script_counts(doc_text()), "l": T.repeated_line_counts(doc_text()), "g": T.repeated_ngram_counts(doc_text())})
    c = F.col
    reason = (
        F.when(c("char_length") < 100, "too_short").when(c("urls") > 2, "url_density").when(c("tags") > 2, "html_tags").when(T.ratio(c("letters"), c("nonspace")) < 0.45, "low_alpha_ratio").when(T.ratio(c("special"), c("nonspace")) > 0.2, "high_special_ratio")
        .when((c("l.total") >= 2) & (c("l.repeated") / c("l.total") > 0.35), "repeated_lines").when((c("g.total") > 0) & (c("g.repeated") / c("g.total") > 0.25), "repeated_ngrams").otherwise("accepted")
    )
    return d.select("doc_id", "source", reason.alias("reason"))


@query(f"WITH {CASCADE_SQL} SELECT doc_id, source, reason FROM c")
def reject_cascade(spark, sf_dir):
    return reasons(spark, sf_dir)


@query(f"WITH {CASCADE_SQL} SELECT source, reason, count(*)::BIGINT AS docs FROM c GROUP BY 1, 2")
def reject_funnel_by_source(spark, sf_dir):
    return reasons(spark, sf_dir).groupBy("source", "reason").agg(F.count("*").alias("docs"))


@query()
def clean_documents(spark, sf_dir):
    """Normalization, all measures and the whole cascade, compression gate included."""
    return clean.clean(docs(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "source", "reason", "tx.*", r6(F.col("metrics.gzip_ratio")).alias("gzip_ratio"), F.sha2("clean_text", 256).alias("text_sha256"))


@query()
def chunk_documents(spark, sf_dir):
    d = clean.chunk(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("upstream_id"), "text"), 5000)
    return d.select("parent_id", "upstream_id", "chunk_index", "chunk_count", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


# --- language ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang AS label, CASE WHEN lang IS NOT NULL THEN 1.0 END::DOUBLE AS score, coalesce(lang = 'en', false) AS accepted FROM documents")
def lid_accept(spark, sf_dir):
    d = lid.ColumnIdentifier("lang").identify(docs(spark, sf_dir).select("doc_id", "text", "lang"), "text")
    return d.select("doc_id", "lid.label", "lid.score", lid.accepts(F.col("lid"), "en").alias("accepted"))


@query("SELECT doc_id, 'en' AS label, n_chars / 1000000.0::DOUBLE AS score, true AS accepted FROM documents WHERE source = 'src0' UNION ALL SELECT doc_id, lang, CASE WHEN lang IS NOT NULL THEN 1.0 END::DOUBLE, coalesce(lang = 'en', false) FROM documents WHERE source <> 'src0'")
def lid_bypass(spark, sf_dir):
    d = lid.ColumnIdentifier("lang").identify(docs(spark, sf_dir), "text")
    d = lid.with_bypass(d, F.col("source") != "src0", "en", F.col("n_chars") / 1000000.0)
    return d.select("doc_id", "lid.label", "lid.score", F.col("lid_accepted").alias("accepted"))


@query()
def lid_naive_bayes(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", "lang")
    return lid.NaiveBayesIdentifier().fit(d, "text", "lang").identify(d, "text").select("doc_id", "lang", "lid.label", r6(F.col("lid.score")).alias("score"))


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|\\s)the(\\s|$)') THEN 'en' ELSE 'other' END AS label FROM conversations)
SELECT conv_id FROM s GROUP BY 1 HAVING bool_or(label = 'en') AND bool_or(label = 'other') ORDER BY conv_id LIMIT 200""".replace("\\\\", "\\"))
def mixed_language_docs(spark, sf_dir):
    """Turns stand for spans; marker words for the identifier."""
    t = F.lower("text")
    label = F.when(t.rlike(r"(^|\s)the(\s|$)"), "en").otherwise("other")
    d = table(spark, sf_dir, "conversations").select("conv_id", label.alias("label"), F.lit(1.0).alias("score"))
    return lid.mixed(d, "conv_id", ("en", "other"), 0.7, 200, F.col("conv_id"))


@query(rf"SELECT doc_id, k - 1 AS k, span FROM (SELECT doc_id, unnest(s) AS span, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {stripped('x')}), lambda x: length(x) >= 100)[1:30] AS s FROM documents))")
def document_spans(spark, sf_dir):
    return lid.spans(docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("k").cast("long").alias("k"), "span")


# --- dedup ---------------------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256, count(*)::BIGINT AS copies FROM documents GROUP BY 2")
def exact_dedup(spark, sf_dir):
    return sized(spark, sf_dir).groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents GROUP BY 2")
def exact_first_rows(spark, sf_dir):
    return dedup.exact(sized(spark, sf_dir), "text_sha256", F.col("doc_id")).select("doc_id", "text_sha256")


def caps_sql() -> str:
    """Three sources in turn, the first and second capped: a fold, written out."""
    base = "d AS (SELECT doc_id, source, sha256(text) AS sha, strlen(text)::BIGINT AS bytes FROM documents)"
    parts, before = [base], ""
    for k, (source, cap) in enumerate((("src0", 50_000), ("src1", 50_000), ("src2", None))):
        parts.append(f"f{k} AS (SELECT * FROM d WHERE source = '{source}'{before} QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1)")
        parts.append(f"a{k} AS (SELECT * FROM f{k}" + (f" QUALIFY sum(bytes) OVER (ORDER BY doc_id) - bytes < {cap}" if cap else "") + ")")
        before += f" AND sha NOT IN (SELECT sha FROM a{k})"
    return "WITH " + ", ".join(parts) + " SELECT doc_id, source, bytes FROM a0 UNION ALL SELECT doc_id, source, bytes FROM a1 UNION ALL SELECT doc_id, source, bytes FROM a2"


@query(caps_sql())
def exact_dedup_with_caps(spark, sf_dir):
    kept = dedup.exact_with_caps(sized(spark, sf_dir), ["src0", "src1", "src2"], {"src0": 50_000, "src1": 50_000}, "source", "text_sha256", "bytes", [F.col("doc_id")])
    return kept.select("doc_id", "source", "bytes")


SETS_SQL = rf"w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w), p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*)))"


@query(f"WITH {SETS_SQL} SELECT a, b, shared::BIGINT AS shared, na::BIGINT AS size_a, nb::BIGINT AS size_b FROM j")
def shingle_jaccard_pairs(spark, sf_dir):
    return dedup.similar_pairs(docs(spark, sf_dir), "doc_id", "text")


@query(rf"""WITH RECURSIVE {SETS_SQL}, n AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, list(o) AS nb FROM (SELECT b AS doc_id, a AS o FROM j) GROUP BY doc_id),
f(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN len(list_filter(n.nb, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, n.doc_id) ELSE gone END FROM f JOIN n ON n.k = f.k + 1),
g AS (SELECT gone FROM f ORDER BY k DESC LIMIT 1)
SELECT d.doc_id, NOT list_contains(gone, d.doc_id) AS kept, CASE WHEN list_contains(gone, d.doc_id) THEN (SELECT min(a) FROM j WHERE b = d.doc_id AND NOT list_contains(gone, a)) END AS near_duplicate_of FROM documents d, g""")
def near_dup_decisions(spark, sf_dir):
    return dedup.near_survivors(docs(spark, sf_dir), "doc_id", "text", F.col("doc_id"))


@query()
def lsh_near_pairs(spark, sf_dir):
    """Banded minhash candidates, verified: a subset of the exact pairs."""
    return dedup.lsh_pairs(docs(spark, sf_dir), "doc_id", "text")


@query("SELECT source, lang, doc_id, substr(sha256(text), 1, 16) AS ord FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY substr(sha256(text), 1, 16), doc_id) <= 10")
def audit_bottom_k(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("ord", hashing.audit_order(doc_text()))
    return dedup.bottom_k(d, ["source", "lang"], 10, F.col("ord"), F.col("doc_id")).select("source", "lang", "doc_id", "ord")


@query("SELECT source, doc_id, sha256(text) AS text_sha256, substr(text, 1, 2000) AS sample FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(text), doc_id) <= 20")
def accepted_sample(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text_sha256", hashing.sha256(doc_text()))
    return dedup.bottom_k(d, ["source"], 20, *by_digest()).select("source", "doc_id", "text_sha256", F.substring("text", 1, 2000).alias("sample"))


@query("SELECT doc_id, source, strlen(text)::BIGINT AS bytes FROM documents QUALIFY sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - strlen(text) < 60000")
def byte_cap_accept(spark, sf_dir):
    return dedup.accept_until(sized(spark, sf_dir), "bytes", 60_000, ["source"], [F.col("doc_id")]).select("doc_id", "source", "bytes")


@query(rf"""WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '{WORD}') FROM benchmark), g AS (SELECT DISTINCT k, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS shared FROM g d JOIN g b ON d.g = b.g AND d.k = 'd' AND b.k = 'b' GROUP BY 1, 2""")
def contamination_overlap(spark, sf_dir):
    side = lambda d, id: d.select(F.col(id), F.explode(F.filter(dedup.shingles(doc_text()), lambda s: F.size(F.split(s, " ")) == 5)).alias("g"))
    return side(docs(spark, sf_dir), "doc_id").join(side(table(spark, sf_dir, "benchmark"), "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


# --- mixture -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, (('0x' || substr(sha256(text), 1, 16))::UBIGINT % 100)::INTEGER AS bucket, CASE WHEN ('0x' || substr(sha256(text), 1, 16))::UBIGINT % 100 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    d = sized(spark, sf_dir)
    return d.select("doc_id", hashing.bucket(F.col("text_sha256"), 100).alias("bucket"), hashing.split_name(F.col("text_sha256")).alias("split"))


MIX = {"caps": {"src1": 40_000, "src3": 30_000}, "target": 150_000, "order": ["src3", "src1", "src0", "src2"]}


def mixture_sql() -> str:
    parts = ["d AS (SELECT doc_id, source, sha256(text) AS sha, strlen(text)::BIGINT AS bytes FROM documents)"]
    used = "0"
    for k, s in enumerate(MIX["order"]):
        room = f"least({MIX['caps'].get(s, MIX['target'])}, {MIX['target']} - ({used}))"
        parts.append(f"m{k} AS (SELECT doc_id, source, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY sha, doc_id ROWS UNBOUNDED PRECEDING) AS u FROM d WHERE source = '{s}') WHERE u <= {room})")
        used += f" + (SELECT coalesce(sum(bytes), 0) FROM m{k})"
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(len(MIX["order"])))


@query(mixture_sql())
def capped_mixture(spark, sf_dir):
    return mixture.capped_mixture(sized(spark, sf_dir), MIX["order"], MIX["caps"], MIX["target"], "source", "bytes", by_digest()).select("doc_id", "source", "bytes")


@query("WITH d AS (SELECT source, strlen(text) AS b, CASE WHEN ('0x' || substr(sha256(text), 1, 16))::UBIGINT % 100 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents) SELECT split, source, count(*)::BIGINT AS docs, sum(b)::BIGINT AS bytes FROM d GROUP BY CUBE (split, source)")
def split_totals(spark, sf_dir):
    d = sized(spark, sf_dir).withColumn("split", hashing.split_name(F.col("text_sha256")))
    return mixture.totals(d, "bytes", "split", "source")


@query("WITH a AS (SELECT source, sum(strlen(text))::HUGEINT AS bytes FROM documents GROUP BY 1), t AS (SELECT sum(bytes)::HUGEINT AS t FROM a), q AS (SELECT source, bytes, (bytes * 100000) // t AS f, (bytes * 100000) % t AS m FROM a, t) SELECT source, bytes::BIGINT AS bytes, (f + CASE WHEN row_number() OVER (ORDER BY m DESC, source DESC) <= 100000 - (SELECT sum(f) FROM q) THEN 1 ELSE 0 END)::BIGINT AS quota FROM q")
def largest_remainder_quotas(spark, sf_dir):
    a = sized(spark, sf_dir).groupBy("source").agg(F.sum("bytes").alias("bytes"))
    return mixture.largest_remainder(a, "source", "bytes", 100_000)


@query("""WITH RECURSIVE d AS (SELECT doc_id, source, strlen(text)::BIGINT AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IN ('src0', 'src1', 'src2')),
f(source, k, left_, taken, doc_id) AS (SELECT source, 0::BIGINT, 40000::BIGINT, false, NULL::BIGINT FROM (SELECT DISTINCT source FROM d) UNION ALL SELECT d.source, d.k, f.left_ - CASE WHEN d.b <= f.left_ THEN d.b ELSE 0 END, d.b <= f.left_, d.doc_id FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
SELECT source, doc_id FROM f WHERE taken""")
def skip_fit_sample(spark, sf_dir):
    return mixture.skip_fit(sized(spark, sf_dir), {"src0": 40_000, "src1": 40_000, "src2": 40_000}, "source", "doc_id", "bytes").select("source", "doc_id")


# --- reports -------------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, source, strlen(text) AS b, min(doc_id) OVER (PARTITION BY sha256(text)) AS o FROM documents), src AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'nothing')
SELECT src.source, count(d.doc_id)::BIGINT AS exact_unique, (count(d.doc_id) FILTER (o = d.doc_id))::BIGINT AS near_unique, coalesce(sum(b) FILTER (o = d.doc_id), 0)::BIGINT AS near_unique_bytes FROM src LEFT JOIN d USING (source) GROUP BY 1""")
def source_summary(spark, sf_dir):
    """Copies stand for near duplicates here; a source without documents counts 0."""
    d = docs(spark, sf_dir)
    first = F.min("doc_id").over(Window.partitionBy("text_sha256"))
    decided = sized(spark, sf_dir).withColumn("of", first).select("doc_id", F.when(F.col("of") != F.col("doc_id"), F.col("of")).alias("near_duplicate_of"))
    sources = d.select("source").distinct().unionByName(spark.createDataFrame([("nothing",)], "source string"))
    full = d.select("doc_id", "source", F.octet_length("text").cast("long").alias("byte_length")).join(decided, "doc_id")
    return report.source_summary(sources, full, "source")


@query(rf"SELECT source, unnest(['raw_documents', 'raw_bytes', 'raw_words']) AS metric, unnest([count(*), sum(strlen(text)), sum(len(regexp_extract_all(text, '{WORD}')))])::BIGINT AS value FROM documents GROUP BY 1")
def stats_counters(spark, sf_dir):
    return report.counters(docs(spark, sf_dir), "source", {"raw_documents": F.lit(1), "raw_bytes": F.octet_length("text"), "raw_words": T.count(doc_text(), WORD)})


@query("WITH r AS (SELECT source, length(text) AS v, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, max(n)::BIGINT AS n, max(v) FILTER (k = round_even((n - 1) * 0.1, 0))::BIGINT AS p10, max(v) FILTER (k = round_even((n - 1) * 0.5, 0))::BIGINT AS p50, max(v) FILTER (k = round_even((n - 1) * 0.9, 0))::BIGINT AS p90, max(v)::BIGINT AS max FROM r GROUP BY 1")
def length_percentiles(spark, sf_dir):
    return report.percentiles(docs(spark, sf_dir).select("source", F.length("text").cast("long").alias("v")), ["source"], "v")


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS char, unnest(range(length(text))) AS k FROM documents) SELECT char, count(*)::BIGINT AS n FROM c GROUP BY 1 ORDER BY n DESC, min([doc_id, k]) LIMIT 50")
def char_inventory(spark, sf_dir):
    return report.characters(docs(spark, sf_dir), "text", ["doc_id"]).select("char", "n")


@query("SELECT count(*)::BIGINT AS docs, (count(*) FILTER (nfc_normalize(text) <> text))::BIGINT AS not_nfc FROM documents")
def non_nfc_documents(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count("*").alias("docs"), F.count(F.when(T.nfc(doc_text()) != doc_text(), 1)).alias("not_nfc"))


@query(r"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-''][\p{L}\p{M}]+)*')) AS word FROM documents) GROUP BY 1")
def word_frequencies(spark, sf_dir):
    return report.word_frequencies(docs(spark, sf_dir), "text", evaluate.WORD)


@query("SELECT s.source, count(*)::BIGINT AS docs, sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic FROM documents s LEFT JOIN labels USING (doc_id) GROUP BY 1")
def label_summary(spark, sf_dir):
    joined = docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("docs"), F.sum("quality").cast("long").alias("quality"), F.sum("toxic").cast("long").alias("toxic"))


# --- tokenizer -----------------------------------------------------------------------------------------------------------


@query()
def pretokenize_cased(spark, sf_dir):
    return bpe.pretoken_counts(docs(spark, sf_dir), "text", "cased")


@query()
def pretokenize_sequential(spark, sf_dir):
    return bpe.pretoken_counts(docs(spark, sf_dir), "text", "sequential")


@query(r"SELECT pretoken, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+|\p{N}{1,3}')) AS pretoken FROM documents) GROUP BY 1")
def letter_number_pretokens(spark, sf_dir):
    return report.word_frequencies(docs(spark, sf_dir), "text", r"\p{L}+|\p{N}{1,3}").withColumnRenamed("word", "pretoken")


@query(r"WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\x00-\x20]+')) AS w FROM documents), c AS (SELECT hex(encode(w)) AS h, count(*) AS n FROM w GROUP BY 1), p AS (SELECT h, n, unnest(range(1, length(h) - 2, 2)) AS i FROM c WHERE length(h) > 2) SELECT substr(h, i, 2) AS \"left\", substr(h, i + 2, 2) AS \"right\", sum(n)::BIGINT AS n FROM p GROUP BY 1, 2".replace('\\"', '"'))
def byte_pair_counts(spark, sf_dir):
    return bpe.byte_pairs(docs(spark, sf_dir), "text")


@query(f"SELECT text || CASE WHEN k < n THEN chr(10) ELSE '' END AS line FROM (SELECT unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, len(string_split(text, chr(10))) AS n FROM documents) WHERE {stripped('text')} <> ''")
def training_lines(spark, sf_dir):
    return bpe.lines_with_ends(docs(spark, sf_dir), "text")


def model_of(spark, sf_dir, size: int = 400) -> bpe.Model:
    return bpe.train(docs(spark, sf_dir), "text", size)


@query()
def bpe_first_merges(spark, sf_dir):
    m = model_of(spark, sf_dir)
    return spark.createDataFrame([(k, a.hex(), b.hex()) for k, (a, b) in enumerate(m.merges)], "rank long, left string, right string")


@query()
def bpe_encode_lengths(spark, sf_dir):
    return bpe.token_lengths(docs(spark, sf_dir), model_of(spark, sf_dir), "doc_id", "text")


@query("SELECT count(*)::BIGINT AS records, 0::BIGINT AS failures FROM benchmark")
def bpe_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark")
    return d.withColumn("ok", bpe.round_trip(d, model_of(spark, sf_dir), "text")).agg(F.count("*").alias("records"), F.count(F.when(~F.col("ok"), 1)).alias("failures"))


@query("SELECT count(*)::BIGINT AS records, 0::BIGINT AS failures FROM documents")
def bpe_roundtrip_documents(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.withColumn("ok", bpe.round_trip(d, model_of(spark, sf_dir), "text")).agg(F.count("*").alias("records"), F.count(F.when(~F.col("ok"), 1)).alias("failures"))


@query("SELECT v AS vocab_size, least(v, 400) - 256 AS merges FROM (VALUES (256), (300), (350)) t(v)")
def nested_variants(spark, sf_dir):
    m = model_of(spark, sf_dir)
    return spark.createDataFrame([(v, len(m.variant(v).merges)) for v in (256, 300, 350)], "vocab_size int, merges int")


@query("SELECT 'bilingual-' || s || '-supplement' || lpad(r::VARCHAR, 2, '0') || '-' || v AS id, s AS style, v AS vocab_size FROM (VALUES (0), (10), (20), (30)) a(r), (VALUES ('sequential'), ('cased')) b(s), (VALUES (32768), (40960), (50000)) c(v)")
def experiment_matrix(spark, sf_dir):
    return spark.createDataFrame([(e["id"], e["style"], e["vocab_size"]) for e in bpe.experiments()], "id string, style string, vocab_size int")


# --- evaluation and selection --------------------------------------------------------------------------------------------

FACTS_SQL = r"f AS (SELECT lang AS dataset_id, count(*) AS records, sum(strlen(text)) AS utf8_bytes, sum(length(text)) AS characters, sum(len(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-''][\p{L}\p{M}]+)*'))) AS words, sum(length(text)) AS tokens FROM documents GROUP BY 1)"


def char_facts(spark, sf_dir):
    """A tokenizer of one token for each character."""
    return evaluate.facts(docs(spark, sf_dir), "text", "lang", F.length("text"), F.lit(0))


def rounded(d: DataFrame, *keys: str) -> DataFrame:
    return d.select(*keys, "records", "utf8_bytes", "characters", "words", "tokens", "roundtrip_failures", *[r6(F.col(c)).alias(c) for c in ("bytes_per_token", "characters_per_token", "sequence_fertility")])


OUT_SQL = "records::BIGINT AS records, utf8_bytes::BIGINT AS utf8_bytes, characters::BIGINT AS characters, words::BIGINT AS words, tokens::BIGINT AS tokens, 0::BIGINT AS roundtrip_failures, round_even(utf8_bytes / nullif(tokens, 0), 6)::DOUBLE AS bytes_per_token, round_even(characters / nullif(tokens, 0), 6)::DOUBLE AS characters_per_token, round_even(tokens / nullif(words, 0), 6)::DOUBLE AS sequence_fertility"
GROUPS = [("all", "en"), ("all", "de"), ("all", "fr"), ("all", "es"), ("romance", "fr"), ("romance", "es")]


@query(f"WITH {FACTS_SQL} SELECT dataset_id, {OUT_SQL} FROM f")
def eval_facts(spark, sf_dir):
    return rounded(char_facts(spark, sf_dir), "dataset_id")


@query(f"WITH {FACTS_SQL}, g AS (SELECT CASE WHEN k = 0 THEN 'all' ELSE 'romance' END AS group_id, sum(records) AS records, sum(utf8_bytes) AS utf8_bytes, sum(characters) AS characters, sum(words) AS words, sum(tokens) AS tokens FROM f, (VALUES (0), (1)) v(k) WHERE k = 0 OR dataset_id IN ('fr', 'es') GROUP BY 1) SELECT group_id, {OUT_SQL} FROM g")
def eval_metrics_grouped(spark, sf_dir):
    groups = spark.createDataFrame(GROUPS, "group_id string, dataset_id string")
    return rounded(evaluate.roll_up(char_facts(spark, sf_dir), groups), "group_id")


@query("SELECT lang AS dataset_id FROM documents GROUP BY 1 HAVING NOT ends_with(lang, 'validation')")
def external_only(spark, sf_dir):
    return evaluate.external(char_facts(spark, sf_dir)).select("dataset_id")


@query("WITH r AS (SELECT lang, length(text) AS v, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(v) FILTER (k = round_even((n - 1) * 0.5, 0))::BIGINT AS p50, max(v) FILTER (k = round_even((n - 1) * 0.9, 0))::BIGINT AS p90 FROM r GROUP BY 1")
def token_percentiles(spark, sf_dir):
    return report.percentiles(docs(spark, sf_dir).select("lang", F.length("text").cast("long").alias("v")), ["lang"], "v", (0.5, 0.9)).select("lang", "p50", "p90")


@query(r"WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-''][\p{L}\p{M}]+)*')) AS w FROM documents) SELECT round_even(sum(length(w)) / count(*), 6)::DOUBLE AS isolated_word_fertility, round_even((count(*) FILTER (length(w) = 1)) / count(*), 6)::DOUBLE AS single_token_word_rate FROM w")
def word_fertility(spark, sf_dir):
    out = evaluate.word_fertility(docs(spark, sf_dir), "text", lambda w: w.withColumn("tokens", F.length("word")))
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS form FROM conversations), p AS (SELECT form, substr(form, 1, length(form) - 2) AS lemma FROM w WHERE length(form) > 2)
SELECT count(*)::BIGINT AS eligible, (count(*) FILTER (length(lemma) % 3 = 0))::BIGINT AS aligned, round_even((count(*) FILTER (length(lemma) % 3 = 0)) / count(*), 6)::DOUBLE AS recall, round_even(sum((length(form) - 1) // 3 + 1) / count(*), 6)::DOUBLE AS tokens_per_word FROM p""")
def morphology_recall(spark, sf_dir):
    """Forms of the conversations, lemmas without the last two letters, tokens of three letters."""
    forms = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("form")).distinct().where(F.length("form") > 2)
    bounds = F.transform(F.sequence(F.lit(1), F.floor((F.length("form") - 1) / 3).cast("int")), lambda k: (k * 3).cast("int"))
    pairs = forms.select("form", F.expr("substring(form, 1, length(form) - 2)").alias("lemma"), F.when(F.length("form") > 3, bounds).otherwise(F.array().cast("array<int>")).alias("boundaries"))
    m = evaluate.morphology(pairs)
    return m.select("eligible", "aligned", r6(F.col("recall")).alias("recall"), r6(F.col("tokens_per_word")).alias("tokens_per_word"))


# Published figures of six candidates.
CANDIDATES = [("c10", 32768, 8.916, 6.477, 0), ("c20", 32768, 8.794, 6.886, 0), ("c30", 32768, 8.647, 7.102, 0), ("c10b", 40960, 8.916, 6.400, 0), ("big", 50000, 9.200, 7.300, 0), ("broken", 30000, 9.900, 9.900, 3)]
CANDIDATES_SQL = "c(id, vocab, main, other, fails) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE, {d}::DOUBLE, {e})" for a, b, c, d, e in CANDIDATES) + "), e AS (SELECT * FROM c WHERE fails = 0 AND main >= 0.9 * 8.983 AND other >= 1.2 * 4.786), p AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.vocab <= e.vocab AND o.main >= e.main AND o.other >= e.other AND (o.vocab < e.vocab OR o.main > e.main OR o.other > e.other)))"


def front(spark):
    c = spark.createDataFrame(CANDIDATES, "id string, vocab int, main double, other double, roundtrip_failures int")
    return evaluate.pareto_front(evaluate.eligible(c, (8.983, 4.786), "main", "other"), ["vocab"], ["main", "other"])


@query(f"WITH {CANDIDATES_SQL} SELECT id, vocab, main, other FROM p")
def pareto_front(spark, sf_dir):
    return front(spark).select("id", "vocab", "main", "other")


@query(f"WITH {CANDIDATES_SQL} SELECT id, vocab FROM p ORDER BY vocab, least(main / 8.983, other / 4.786) DESC LIMIT 1")
def constrained_choice(spark, sf_dir):
    return evaluate.choose(front(spark), "vocab", (8.983, 4.786), "main", "other").select("id", "vocab")


@query("SELECT p.p_partkey, p.p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_brand = p.p_brand AND o.p_size <= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size < p.p_size OR o.p_retailprice < p.p_retailprice))")
def pareto_front_by_brand(spark, sf_dir):
    return evaluate.pareto_front(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], [], ["p_brand"]).select("p_partkey", "p_brand")


@query("SELECT p_size, w AS width, p_size::BIGINT * w AS parameters FROM (SELECT DISTINCT p_size FROM part), (VALUES (768), (2048), (4096)) t(w)")
def embedding_cost(spark, sf_dir):
    return evaluate.embedding_cost(table(spark, sf_dir, "part").select("p_size").distinct(), "p_size")


# --- sources and sinks ---------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN doc_id = 0 THEN '000000000000' ELSE doc_id::VARCHAR END AS upstream_id, doc_id AS seq, source AS src FROM documents WHERE text <> ''")
def hub_scan(spark, sf_dir):
    d = readers.hub_rows(docs(spark, sf_dir), "documents", id_field="doc_id", metadata_fields=("source", "lang"), seq=F.col("doc_id"))
    return d.select("upstream_id", "seq", F.col("metadata")["source"].alias("src"))


@query()
def seeded_order(spark, sf_dir):
    return readers.seeded_shuffle(docs(spark, sf_dir).select("doc_id"), 20260829, "doc_id")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(string_split_regex(text, '\s+'), ' '), '\s+([,.;:!?%…)\]}»])', '\1', 'g'), '([(\[{«])\s+', '\1', 'g'), '\s+([’''])\s+', '\1', 'g')) AS text FROM documents")
def detokenize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.detokenize(F.split("text", r"\s+")).alias("text"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 2 AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT doc_id, source, n, b AS held, 0::BIGINT AS shard FROM d WHERE n = 1
UNION ALL SELECT d.doc_id, d.source, d.n, CASE WHEN held >= 20000 THEN d.b ELSE held + d.b END, shard + (held >= 20000)::BIGINT FROM f JOIN d ON d.source IS NOT DISTINCT FROM f.source AND d.n = f.n + 1)
SELECT doc_id, shard FROM f""")
def shard_numbers(spark, sf_dir):
    d = sinks.shard_numbers(sized(spark, sf_dir), "source", F.col("bytes"), [F.col("doc_id")], 20_000)
    return d.select("doc_id", F.col("shard").cast("long").alias("shard"))


@query(f"SELECT {stripped('t')} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents) WHERE {stripped('t')} <> ''")
def validation_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("t"))
    return lines.select(T.strip(F.col("t")).alias("text")).where("text != ''")


@query(f"SELECT conv_id, turn, role || chr(10) || {stripped('text')} AS text FROM conversations WHERE {stripped('text')} <> ''")
def joined_fields(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(T.strip(F.col("text")) != "").select("conv_id", "turn", readers.joined_fields("role", "text").alias("text"))


# --- flagship ------------------------------------------------------------------------------------------------------------


@query()
def corpus_build(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, cleaned, exact and near dedup, hash split: documents and bytes by source and split."""
    d = clean.clean(docs(spark, sf_dir).select("doc_id", "source", "text")).where("reason is null")
    d = d.select("doc_id", "source", "clean_text", hashing.sha256(F.col("clean_text")).alias("text_sha256"), F.octet_length("clean_text").cast("long").alias("bytes"))
    d = cut_lineage(dedup.exact(d, "text_sha256", F.col("doc_id")))
    decided = dedup.near_survivors(d, "doc_id", "clean_text", -F.col("bytes"), F.col("text_sha256"))
    kept = d.join(decided.where("kept").select("doc_id"), "doc_id", "left_semi").withColumn("split", hashing.split_name(F.col("text_sha256")))
    return kept.groupBy("source", "split").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
