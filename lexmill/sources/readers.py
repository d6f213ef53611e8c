"""Source readers, by kind.  Each gives source_id, seq, upstream_id, text, url, metadata (map<string,string>)."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import detokenize, strip

# Wiki namespaces, tags and headings that carry no prose.
HIDDEN_NAMESPACES = ("category", "file", "image", "media", "категория", "файл", "сүрөт")
HIDDEN_TAGS = ("gallery", "ref", "references")
TRAILING_SECTION = r"(?imu)^==+\s*(?:булактар|тышкы шилтемелер|шилтемелер|колдонулган адабияттар|дагы караңыз|эскертүүлөр|ссылки|примечания|литература)\s*==+\s*$"

SCHEMA = "source_id string, seq long, upstream_id string, text string, url string, metadata map<string,string>"


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """seq from 0 in the given order; without one, in the order of files and rows."""
    if not order:
        order = (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def hub_rows(df: DataFrame, source_id: str, text_field: str = "text", id_field: str | None = "id", url_field: str | None = None, metadata_fields: tuple[str, ...] = (), seq: Column | None = None) -> DataFrame:
    """Rows with a text.  An id that is missing, empty, the number 0 or false (not the text "0") becomes the row's number among all rows, in 12 digits."""
    d = df.withColumn("seq", seq.cast("long")) if seq is not None else numbered(df)
    id = F.col(id_field) if id_field and id_field in df.columns else F.lit(None).cast("string")
    kind = df.schema[id_field].dataType if id_field and id_field in df.columns else T.StringType()
    missing = id.isNull() | (~id if isinstance(kind, T.BooleanType) else id == 0 if isinstance(kind, T.NumericType) else id.cast("string") == "")
    id = id.cast("string")
    known = [f for f in metadata_fields if f in df.columns]
    pairs = F.map_filter(F.create_map(*[x for f in known for x in (F.lit(f), F.col(f).cast("string"))]), lambda k, v: v.isNotNull()) if known else F.create_map().cast("map<string,string>")
    url = F.when(F.col(url_field) != "", F.col(url_field)) if url_field and url_field in df.columns else F.lit(None).cast("string")
    rows = d.where(F.col(text_field).isNotNull() & (F.col(text_field) != ""))
    return rows.select(F.lit(source_id).alias("source_id"), "seq", F.when(missing, F.lpad(F.col("seq").cast("string"), 12, "0")).otherwise(id).alias("upstream_id"), F.col(text_field).alias("text"), url.alias("url"), pairs.alias("metadata"))


def seeded_shuffle(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """Rows in the order of a seeded hash: a full shuffle that any cluster repeats."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def plain_wikitext(text: Column) -> Column:
    """Prose of wiki text: a subset of the markup, by patterns (templates three deep, links, tags, headings, emphasis)."""
    t = F.split(text, TRAILING_SECTION, 2)[0]
    for tag in HIDDEN_TAGS:
        t = F.regexp_replace(F.regexp_replace(t, rf"(?is)<{tag}\b[^>/]*/>", ""), rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?iu)\[\[\s*(?:{'|'.join(HIDDEN_NAMESPACES)})\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "")
    for _ in range(3):
        t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"(?s)\{\|.*?\|\}", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), r"\[\[([^\[\]]*)\]\]", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\[https?://\S+\s+([^\]]*)\]", "$1"), r"\[https?://\S+\]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^==+\s*(.*?)\s*==+\s*$", "$1"), r"'{2,}", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")



def wiki_dump(spark: SparkSession, path: str, source_id: str, base_url: str) -> DataFrame:
    """Articles of a MediaWiki XML dump (.bz2 is split among tasks); broken pages are skipped."""
    raw = spark.read.format("xml").option("rowTag", "page").option("mode", "DROPMALFORMED").schema("ns long, title string, id long, redirect string, revision struct<id:long,text:struct<_VALUE:string>>").load(path)
    pages = raw.where((F.col("ns") == 0) & F.col("redirect").isNull() & F.col("revision").isNotNull())
    body = pages.withColumn("body", plain_wikitext(F.coalesce(F.col("revision.text._VALUE"), F.lit("")))).where("body != ''")
    text = F.when(F.startswith("body", "title"), F.col("body")).otherwise(F.concat("title", F.lit("\n\n"), "body"))
    d = numbered(body, F.col("id"))
    return d.select(F.lit(source_id).alias("source_id"), "seq", F.col("id").cast("string").alias("upstream_id"), text.alias("text"), F.concat(F.lit(base_url + "?curid="), "id").alias("url"), F.create_map(F.lit("title"), "title", F.lit("revision_id"), F.col("revision.id").cast("string")).alias("metadata"))


# Fixed value: an attribute of a text tag.
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')


def _vrt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, at, attributes, sentences) of each text element of zipped VRT files."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            members = [(path, content)] if not content[:2] == b"PK" else [(f"{path}!{n}", zipfile.ZipFile(io.BytesIO(content)).read(n)) for n in sorted(zipfile.ZipFile(io.BytesIO(content)).namelist()) if not n.endswith("/")]
            for name, data in members:
                rows, attributes, sentences, tokens = [], None, [], None
                for line in data.decode("utf-8", "replace").splitlines():
                    if line.startswith("<text"):
                        attributes, sentences = {k: html.unescape(v) for k, v in _ATTRIBUTE.findall(line)}, []
                    elif line.startswith("<s>") or line.startswith("<s "):
                        tokens = []
                    elif line.startswith("</s>"):
                        if tokens:
                            sentences.append(tokens)
                        tokens = None
                    elif line.startswith("</text>"):
                        if attributes is not None:
                            rows.append((name, len(rows), attributes, sentences))
                        attributes = None
                    elif tokens is not None and line and not line.startswith("<"):
                        tokens.append(line.split("\t")[0])
                yield pd.DataFrame(rows, columns=["file", "at", "attributes", "sentences"])


def vrt(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Texts of vertical files, plain or zipped: a text is its sentences, detokenized, one a line."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(_vrt, "file string, at int, attributes map<string,string>, sentences array<array<string>>")
    text = F.array_join(F.filter(F.transform("sentences", detokenize), lambda s: s != ""), "\n")
    d = numbered(rows.withColumn("text", text).where("text != ''"), F.col("file"), F.col("at"))
    a = lambda k: F.when(F.try_element_at("attributes", F.lit(k)) != "", F.try_element_at("attributes", F.lit(k)))
    return d.select(F.lit(source_id).alias("source_id"), "seq", F.coalesce(a("id"), F.sha2("text", 256)).alias("upstream_id"), "text", a("source").alias("url"), F.col("attributes").alias("metadata"))


def conllu(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(texts, forms) of CoNLL-U files: sentences by their text comment; words with form and lemma."""
    lines = spark.read.text(path)
    texts = lines.where(F.startswith("value", F.lit("# text = "))).select(F.lit(dataset).alias("dataset_id"), strip(F.substring("value", 10, 1 << 30)).alias("text")).where("text != ''")
    c = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).select(c.alias("c")).where((F.size("c") == 10) & ~F.col("c")[0].rlike("[-.]"))
    return texts, rows.where(F.col("c")[2] != "_").select(F.col("c")[1].alias("form"), F.col("c")[2].alias("lemma"), F.lit(dataset).alias("dataset"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record for each line that isn't blank, stripped; .zst, .gz and .bz2 by their endings."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text != ''")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def joined_fields(*fields: str) -> Column:
    """Stripped fields that aren't blank, one a line."""
    return F.concat_ws("\n", *[F.when(strip(F.col(f)) != "", strip(F.col(f))) for f in fields])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, sha1) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"))


def verified(spark: SparkSession, path: str, sha256: str) -> str:
    found = file_digests(spark, path).select("sha256").collect()
    if [r[0] for r in found] != [sha256]:
        raise ValueError(f"{path} isn't what the lock says")
    return path


KINDS: dict[str, Callable[..., DataFrame]] = {
    "parquet": lambda spark, path, source_id, **o: hub_rows(spark.read.parquet(path), source_id, **o),
    "jsonl": lambda spark, path, source_id, **o: hub_rows(spark.read.json(path), source_id, **o),
    "wikimedia_xml": wiki_dump,
    "vrt": vrt,
}


def open_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"no source is of kind {kind!r}; there are {', '.join(KINDS)}")
    return KINDS[kind](spark, **options)
