"""Text normalization and quality measures as Column builders.

Character classes are spelled out with Unicode properties, so that Java's regex engine counts what the definitions say:
a word character is a letter, a number or an underscore; a word is a run of letters and numbers.
"""

from __future__ import annotations

import unicodedata
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .rows import each

# Patterns of the cleaning steps.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
EMAIL = r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}(?![\p{L}\p{N}_.-])"
IPV4 = r"(?<!\p{Nd})(?:25[0-5]|2[0-4]\p{Nd}|1?\p{Nd}?\p{Nd})(?:\.(?:25[0-5]|2[0-4]\p{Nd}|1?\p{Nd}?\p{Nd})){3}(?!\p{Nd})"
WIKI_MARKER = r"(?i)\[\[|\]\]|\{\{|\}\}|(?<![\p{L}\p{N}_])thumb\|"
URL = r"(?i)https?://\S+"
HTML_TAG = r"<[^>]{1,500}>"
WORD = r"[\p{L}\p{N}]+"
SPECIFIC_LETTERS = "[ҢңӨөҮү]"
CYRILLIC = r"[\x{400}-\x{481}\x{48a}-\x{52f}]"


#: Covers all characters that have a combining class, are not their own composed form or compose with one before them.
COMPOSES = r"[\x{300}-\x{1fff}\x{2000}\x{2001}\x{20d0}-\x{20ff}\x{2126}-\x{212b}\x{2329}\x{232a}\x{2adc}-\x{2dff}\x{302a}-\x{309a}\x{a66f}-\x{abff}\x{f900}-\x{fe2f}\x{101fd}-\x{1e94a}\x{2f800}-\x{2fa1d}]"

_composed = each(lambda t: unicodedata.normalize("NFC", t), StringType())


def nfc(text: Column) -> Column:
    """Unicode normalization form C; Spark has no function for it.  Only texts that it may change go through Python."""
    may = text.rlike(COMPOSES)
    return F.when(may, _composed(F.when(may, text))).otherwise(text)


def _gzip_size(t: str) -> int:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(c.compress(t.encode())) + len(c.flush()) + 18


#: Bytes of a gzip member at level 6: raw deflate plus 18 bytes of header and trailer.
deflated_size = each(_gzip_size, IntegerType())


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip(text: Column) -> Column:
    """text without white space at its ends, line breaks, no-break spaces and the separators U+001C to U+001F included."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def squeeze_lines(text: Column) -> Column:
    """Each line stripped and its white space made single blanks; at most one blank line in a row; ends stripped."""
    lines = F.split(text, "[\n  ]")
    squeezed = F.array_join(F.transform(lines, lambda l: F.trim(F.regexp_replace(l, r"(?U)\s+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(squeezed, "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def cut(text: Column, most: int) -> Column:
    """At most `most` characters: up to the last blank line, else the last line feed, if that keeps half; else a hard cut."""
    head = F.substring(text, 1, most)
    back = lambda mark: F.length(head) - F.locate(mark, F.reverse(head)) - (len(mark) - 1)
    found = lambda mark: F.locate(mark, F.reverse(head)) > 0
    at = F.when(found("\n\n") & (back("\n\n") >= most // 2), back("\n\n")).when(found("\n") & (back("\n") >= most // 2), back("\n")).otherwise(most)
    return F.when(F.length(text) > most, F.regexp_replace(F.substring(head, F.lit(1), at.cast("int")), r"(?U)^\s+|\s+$", "")).otherwise(text)


def settled(df, *names: str):
    """df with the named columns out of a generator: the optimizer doesn't copy their expressions into those that use them."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def normalize(df, text: str = "text", most: int = 200_000, redact: bool = True, out: str = "clean_text"):
    """df with `out` and tx (counts of what was taken away).  The order of steps is part of the definition."""
    def step(d, pattern, name, with_):
        """Counted once; only texts that have matches are gone through again."""
        d = settled(d.withColumn(f"__{name}", F.regexp_count("__t", F.lit(pattern))), f"__{name}")
        return d.withColumn("__t", F.when(F.col(f"__{name}") > 0, F.regexp_replace("__t", pattern, with_)).otherwise(F.col("__t")))

    d = settled(df.withColumn("__t", line_feeds(F.coalesce(F.col(text), F.lit("")))), "__t")
    d = settled(d.withColumn("__t", nfc(F.col("__t"))), "__t")
    d = step(d, CONTROL, "control_chars_removed", "")
    if redact:
        d = step(step(d, EMAIL, "emails_redacted", " "), IPV4, "ipv4_redacted", " ")
    else:
        d = d.withColumns({"__emails_redacted": F.lit(0), "__ipv4_redacted": F.lit(0)})
    d = step(d, WIKI_MARKER, "residual_wiki_markers_removed", " ")
    d = settled(d.withColumn("__t", squeeze_lines(F.col("__t"))), "__t")
    d = d.withColumn("__truncated", (F.length("__t") > most).cast("int")).withColumn(out, cut(F.col("__t"), most))
    names = ["control_chars_removed", "emails_redacted", "ipv4_redacted", "residual_wiki_markers_removed", "truncated"]
    return d.withColumn("tx", F.struct(*[F.col(f"__{n}").alias(n) for n in names])).drop("__t", *[f"__{n}" for n in names])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def chars(text: Column, pattern: str) -> Column:
    """Characters of a class; runs of them are cut out, which is faster than counting them one by one."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 if whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def lengths(text: Column) -> dict[str, Column]:
    return {"char_length": F.length(text).cast("long"), "byte_length": F.octet_length(text).cast("long"), "word_count": count(text, WORD)}


def url_density(text: Column) -> Column:
    return count(text, URL) / F.greatest(F.lit(1.0), F.length(text) / 1000)


def html_tags(text: Column) -> Column:
    return count(text, HTML_TAG)


def script_counts(text: Column) -> dict[str, Column]:
    nonspace = F.length(F.regexp_replace(text, r"(?U)\s+", "")).cast("long")
    return {
        "nonspace": nonspace, "letters": chars(text, r"\p{L}"), "cyrillic": chars(text, CYRILLIC), "latin": chars(text, "[A-Za-z]"),
        "special": nonspace - chars(text, r"[\p{L}\p{N}]"), "specific": chars(text, SPECIFIC_LETTERS),
    }


def repeated_line_counts(text: Column) -> Column:
    """struct(repeated, total) of stripped lines with 20 characters or more."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda l: F.length(l) >= 20)
    return F.transform(F.array(F.array_sort(lines)), _runs)[0]


def repeated_ngram_counts(text: Column, n: int = 5, most_words: int = 50_000) -> Column:
    """struct(repeated, total) of the n-grams of the first words, lower-cased; (0, 0) below 2 * n words."""
    first = F.slice(words(F.lower(text)), 1, most_words)
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    some = F.transform(F.array(first), lambda w: F.when(F.size(w) >= 2 * n, grams(w)).otherwise(F.array().cast("array<bigint>")))
    return F.transform(F.transform(some, lambda g: F.sort_array(g)), _runs)[0]


def _runs(ordered: Column) -> Column:
    """struct(repeated, total) of a sorted array: an entry is repeated if a neighbour equals it."""
    repeated = F.filter(ordered, lambda x, i: (x == F.get(ordered, i - 1)) | (x == F.get(ordered, i + 1)))
    return F.struct(F.size(repeated).cast("long").alias("repeated"), F.size(ordered).cast("long").alias("total"))


def gzip_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, 1.0).otherwise(deflated_size(text) / F.octet_length(text))


def detokenize(tokens: Column) -> Column:
    """Tokens joined by blanks, without blanks before closing and after opening punctuation and around apostrophes."""
    text = F.array_join(tokens, " ")
    text = F.regexp_replace(text, r"\s+([,.;:!?%…)\]}»])", "$1")
    text = F.regexp_replace(text, r"([(\[{«])\s+", "$1")
    return F.trim(F.regexp_replace(text, r"\s+([’'])\s+", "$1"))
