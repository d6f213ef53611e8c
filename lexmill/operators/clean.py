"""Chunking, measures and the ordered reject cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.rows import each

MARKS = ("\n\n", "\n", ". ", "! ", "? ")


@dataclass(frozen=True)
class Profile:
    """Thresholds of the cascade (fixed values); None switches a gate off."""

    min_chars: int = 100
    max_chars: int = 200_000
    max_urls_per_1000_chars: float | None = 2.0
    max_html_tags: int | None = 2
    min_alpha_ratio: float | None = 0.45
    min_cyrillic_ratio: float | None = 0.60
    max_latin_ratio: float | None = 0.30
    max_special_char_ratio: float | None = 0.20
    max_repeated_line_ratio: float | None = 0.35
    repeated_ngram_size: int = 5
    max_repeated_ngram_ratio: float | None = 0.25
    min_gzip_ratio: float | None = 0.16
    redact_pii: bool = True


CYRILLIC = Profile()
GENERIC = Profile(min_cyrillic_ratio=None, max_latin_ratio=None)


def chunks_of(text: str, most: int) -> list[str]:
    """Windows of at most `most` characters that end at the last mark in their second half, if there is one."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            place, mark = max((text.rfind(m, at, end), -len(m), m) for m in MARKS)[::2]
            if place >= at + most // 2:
                end = place + (0 if mark.isspace() else 1)
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def chunk(df: DataFrame, most: int, id: str = "upstream_id", text: str = "text") -> DataFrame:
    """Long rows become several: adds chunk_index, chunk_count, parent_id; id gets a suffix where a row was split.

    Only rows longer than `most` go through Python; all others stay in the JVM.
    """

    cut = each(lambda t: chunks_of(t, most), ArrayType(StringType()))
    base = df.withColumn("parent_id", F.col(id).cast("string"))
    short = base.where(F.coalesce(F.length(text), F.lit(0)) <= most).withColumns({"chunk_index": F.lit(0), "chunk_count": F.lit(1), id: F.col("parent_id")})
    long_ = base.where(F.length(text) > most).withColumn("__c", cut(text))
    long_ = long_.withColumn("chunk_count", F.size("__c")).select("*", F.posexplode("__c").alias("chunk_index", "__t"))
    long_ = long_.withColumns({text: F.col("__t"), id: F.format_string("%s#chunk-%05d", "parent_id", "chunk_index")})
    return short.unionByName(long_.select(*short.columns))


def clean(df: DataFrame, profile: Profile = GENERIC, text: str = "text") -> DataFrame:
    """df with clean_text, tx, metrics and reason (null: accepted).

    Gates apply in order and the first that fails names the reason; measures behind it are null.  The dear measures (lines,
    n-grams, compression) are only computed for rows that pass the cheap gates.
    """
    p = profile
    d = T.settled(T.normalize(df, text, p.max_chars, p.redact_pii), "clean_text", "tx")
    c = F.col("clean_text")
    s = T.script_counts(c)
    d = d.withColumns({f"__{k}": v for k, v in (T.lengths(c) | {"urls": T.url_density(c), "tags": T.html_tags(c)} | s).items()})
    d = T.settled(d, *[x for x in d.columns if x.startswith("__")])
    ratios = {"alpha_ratio": T.ratio(F.col("__letters"), F.col("__nonspace")), "cyrillic_ratio": T.ratio(F.col("__cyrillic"), F.col("__letters")), "latin_ratio": T.ratio(F.col("__latin"), F.col("__letters")), "special_char_ratio": T.ratio(F.col("__special"), F.col("__nonspace"))}
    d = d.withColumns({f"__{k}": v for k, v in ratios.items()})
    gates = [
        ("too_short", p.min_chars, F.col("__char_length") < p.min_chars),
        ("url_density", p.max_urls_per_1000_chars, F.col("__urls") > F.lit(p.max_urls_per_1000_chars)),
        ("html_tags", p.max_html_tags, F.col("__tags") > F.lit(p.max_html_tags)),
        ("low_alpha_ratio", p.min_alpha_ratio, F.col("__alpha_ratio") < F.lit(p.min_alpha_ratio)),
        ("low_cyrillic_ratio", p.min_cyrillic_ratio, F.col("__cyrillic_ratio") < F.lit(p.min_cyrillic_ratio)),
        ("high_latin_ratio", p.max_latin_ratio, F.col("__latin_ratio") > F.lit(p.max_latin_ratio)),
        ("high_special_ratio", p.max_special_char_ratio, F.col("__special_char_ratio") > F.lit(p.max_special_char_ratio)),
    ]
    reason = F.lit(None).cast("string")
    for name, limit, fails in reversed(gates):
        reason = reason if limit is None else F.when(fails, name).otherwise(reason)
    d = T.settled(d.withColumn("__cheap", reason), "__cheap")
    passed = F.col("__cheap").isNull()
    d = d.withColumns({
        "__lines": F.when(passed, T.repeated_line_counts(c)), "__grams": F.when(passed, T.repeated_ngram_counts(c, p.repeated_ngram_size)),
        "__gzip": F.when(passed, T.gzip_ratio(F.when(passed, c))) if p.min_gzip_ratio is not None else F.lit(None).cast("double"),
    })
    d = T.settled(d, "__lines", "__grams", "__gzip")
    lines = F.when(F.col("__lines.total") >= 2, F.col("__lines.repeated") / F.col("__lines.total")).otherwise(F.when(passed, 0.0))
    grams = F.when(F.col("__grams.total") > 0, F.col("__grams.repeated") / F.col("__grams.total")).otherwise(F.when(passed, 0.0))
    d = d.withColumns({"__repeated_line_ratio": lines, "__repeated_ngram_ratio": grams})
    dear = F.lit(None).cast("string")
    for name, limit, fails in (("template_repetition", p.min_gzip_ratio, F.col("__gzip") < F.lit(p.min_gzip_ratio)), ("repeated_ngrams", p.max_repeated_ngram_ratio, F.col("__repeated_ngram_ratio") > F.lit(p.max_repeated_ngram_ratio)), ("repeated_lines", p.max_repeated_line_ratio, F.col("__repeated_line_ratio") > F.lit(p.max_repeated_line_ratio))):
        dear = dear if limit is None else F.when(fails, name).otherwise(dear)
    long_enough = F.col("__char_length") >= p.min_chars
    metrics = F.struct(
        *[F.col(f"__{k}").alias(k) for k in ("char_length", "byte_length", "word_count")], F.when(long_enough, F.col("__urls")).alias("url_density"), F.when(long_enough, F.col("__tags")).alias("html_tags"),
        *[F.when(long_enough & ~F.coalesce(F.col("__cheap").isin("url_density", "html_tags"), F.lit(False)), F.col(f"__{k}")).alias(k) for k in ratios], F.col("__specific").alias("specific_chars"),
        F.col("__repeated_line_ratio").alias("repeated_line_ratio"), F.col("__repeated_ngram_ratio").alias("repeated_ngram_ratio"), F.col("__gzip").alias("gzip_ratio"),
    )
    # Out of a generator, so that a filter on the reason isn't pushed below the measures, which would compute them many times.
    found = F.struct("clean_text", "tx", metrics.alias("metrics"), F.coalesce("__cheap", dear).alias("reason"))
    return d.select(*df.columns, F.inline(F.array(found)))
