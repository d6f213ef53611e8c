"""Quality rules whose cutoffs come from the data: mergeable quantile sketches per language and source.

The sketch is a histogram of logarithmic buckets (each about 2 % wide), so that a quantile is off by 1 % of its value at
most.  Sketches are rows (group, measure, bucket, count): merging is adding counts, which Spark does map-side, so the
result is the same however rows are dealt, and a group with a third of all rows weighs nothing.  Fences are upper
quartile plus `reach` interquartile ranges of a measure in a language and source.  A group's sketch also holds its
language's, scaled to `least` rows, and a language's that of all rows: the fewer rows a group has, the more it leans on
them, with no size at which the rule changes.  Shares of symbols, repeated lines and repeated words are 0 in most rows,
which leaves no interquartile range: there the cutoff is the `tail` quantile, but no less than the median of the values
above 0, so that one repeated line is no reason yet.  They are sketched from the rows that pass the base rule.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._rows import add_columns
from ._store import materialize, small
from ._words import blocks, grams

RUN = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_GROWTH = 1.02
#: Parts that a row counts as in a sketch with lent rows, so that counts stay whole numbers and sums don't hang on their order.
_UNIT = 1 << 20
#: Added before the logarithm, so that 0 has a bucket; ratios below it count as 0.
_SHIFT = 1e-3
MEASURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length")
#: The upper end of the bucket that 0 is in.
_ZERO = math.floor(math.log(_SHIFT) / math.log(_GROWTH))
_NOTHING = _GROWTH ** (_ZERO + 1) - _SHIFT


def _repeated(runs: np.ndarray, n: int) -> int:
    """Words in runs that are found twice or more."""
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    equal = runs[order][1:] == runs[order][:-1]
    if not equal.any():
        return 0
    again = np.zeros(len(runs), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    at = np.flatnonzero(again)
    gaps = np.diff(at)
    return int(np.minimum(gaps, n).sum()) + n


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def _measure():
    def run(column: pa.Array) -> list[pa.Array]:
        rows = len(column)
        out = {k: np.zeros(rows, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}
        for block in blocks(column, fold=False):
            at = slice(block.first, block.first + block.rows)
            out["n_words"][at] = np.diff(block.bounds)
            char = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
            ends = np.concatenate(([0], np.cumsum(char[block.ends] - char[block.starts])))
            out["word_chars"][at] = np.diff(ends[block.bounds])
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[block.data])))
            out["n_symbols"][at] = np.diff(symbols[block.offsets])
            lines = np.concatenate(([0], np.cumsum(block.data == 10)))
            out["n_lines"][at] = np.diff(lines[block.offsets]) + (np.diff(block.offsets) > 0)
            runs = grams(block.hashes, RUN)
            for i in range(block.rows):
                a, b = int(block.bounds[i]), int(block.bounds[i + 1])
                if b - a > RUN:
                    out["n_repeat_words"][block.first + i] = _repeated(runs[a : b - RUN + 1], RUN)
        for i in np.flatnonzero(out["n_lines"] > 1).tolist():
            out["n_dup_lines"][i] = _dup_lines(column[i].as_py())
        return [pa.array(x) for x in out.values()]

    return run


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long), without the text.

    A null text has zeros.  Columns of these names are replaced, all others stay.
    """
    return add_columns(df, [text], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long", _measure, drop=(text,))


def _values() -> dict:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def _base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): mergeable by adding n.  Word length is that of all rows, the shares those of rows that pass the base rule."""
    bucket = lambda v: F.floor(F.log(v + F.lit(_SHIFT)) / math.log(_GROWTH)).cast("int")
    cells = F.array(*[F.struct(F.lit(k).alias("measure"), (bucket(v) if k == "word_length" else F.when(~_base_failed(), bucket(v))).alias("bucket")) for k, v in _values().items()])
    return measured.select(*keys, F.explode(cells).alias("cell")).where("cell.bucket IS NOT NULL").groupBy(*keys, "cell.measure", "cell.bucket").agg(F.count("*").alias("n"))


def shrunk(own: DataFrame, parent: DataFrame, keys: list[str], up: list[str], least: int) -> DataFrame:
    """own's counts in parts of a row, with the parent's distribution added as `least` rows; keys begin with `up`."""
    whole = Window.partitionBy(*up, "measure")
    lent = parent.withColumn("lent", F.round(F.lit(float(least * _UNIT)) * F.col("n") / F.sum("n").over(whole)).cast("long"))
    lent = own.select(*keys, "measure").distinct().join(small(materialize(lent.drop("n"))), [*up, "measure"]).select(*keys, "measure", "bucket", F.col("lent").alias("n"))
    both = own.select(*keys, "measure", "bucket", (F.col("n") * _UNIT).alias("n")).unionByName(lent)
    return both.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n")).where("n > 0")


def quantiles(sketched: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, measure, n, one column for each named quantile)."""
    by = [F.col(k) for k in (*keys, "measure")]
    running = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketched.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    middle = F.pow(F.lit(_GROWTH), F.col("bucket") + 0.5) - _SHIFT
    return ranked.groupBy(*by).agg(F.max("all").alias("n"), *[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), middle)).alias(k) for k, q in at.items()])


def fences(sketched: DataFrame, keys: list[str], reach: float, tail: float) -> DataFrame:
    """(keys, measure, n, low, high).  Ends are those of buckets, so that equal values stay together and a spread is a bucket at least."""
    q = quantiles(sketched, keys, {"q1": 0.25, "q3": 0.75, "tail": tail})
    above = quantiles(sketched.where(F.col("bucket") > _ZERO), keys, {"middle": 0.5}).drop("n")
    upper = lambda c: (F.col(c) + _SHIFT) * math.sqrt(_GROWTH) * (1 + 1e-9) - _SHIFT
    lower = lambda c: (F.col(c) + _SHIFT) / math.sqrt(_GROWTH) * (1 - 1e-9) - _SHIFT
    spread = upper("q3") - lower("q1")
    share = F.when(F.col("q3") < _NOTHING, F.greatest(upper("tail"), upper("middle"))).otherwise(upper("q3") + reach * spread)
    high = F.when(F.col("measure") == "word_length", upper("q3") + reach * spread).otherwise(share)
    return q.join(above, [*keys, "measure"], "left").select(*keys, "measure", "n", (lower("q1") - reach * spread).alias("low"), high.alias("high"))


def apply_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 200, reach: float = 6.0, floor: dict[str, float] | None = None, tail: float = 0.95) -> DataFrame:
    """df without the text, with the counts of measure(), base_failed and kept (boolean).

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word runs.  kept: not base_failed, and no
    measure outside the fences of its language and source: symbols, repeated lines and repeated words only count above
    them, word length on both sides.  least: rows that a language counts as in the sketch of each of its sources, and all
    rows in that of each language.  floor: what a measure's fence is at least; none by default.  Null languages and sources are groups of their own; null and empty texts fail the base rule; no rows
    give no rows.  Columns named like added ones are replaced.
    """
    floor = floor or {}
    measured = materialize(measure(df, text))
    keys = ["__l", "__s"]
    m = measured.withColumns({"__l": F.coalesce(F.col(lang).cast("string"), F.lit("\x00")), "__s": F.coalesce(F.col(source).cast("string"), F.lit("\x00"))})
    fine = materialize(sketch(m, keys))
    merged = lambda by: fine.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    by_lang = shrunk(merged(["__l"]), merged([]), ["__l"], [], least)
    found = materialize(fences(materialize(shrunk(fine, by_lang, keys, ["__l"], least)), keys, reach, tail).groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == k, F.struct("low", "high"))).alias(f"__{k}") for k in MEASURES]))
    m = m.join(small(found, 160), keys, "left")
    ok = F.lit(True)
    for k, v in _values().items():
        fence = F.col(f"__{k}")
        ok &= F.coalesce(v <= (F.greatest(fence["high"], F.lit(floor[k])) if k in floor else fence["high"]), F.lit(True))
        if k == "word_length":
            ok &= F.coalesce(v >= fence["low"], F.lit(True))
    return m.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ok).drop(*keys, *[f"__{k}" for k in MEASURES])
