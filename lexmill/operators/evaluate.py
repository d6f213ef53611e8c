"""Tokenizer evaluation, roll-ups, constrained Pareto selection."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed value: the word pattern of evaluation.
WORD = r"[\p{L}\p{M}]+(?:[-'][\p{L}\p{M}]+)*"
WIDTHS = (768, 2048, 4096)


def divide(a: Column, b: Column) -> Column:
    """a / b; null if b is 0."""
    return F.when(b != 0, a / b)


def facts(df: DataFrame, text: str, dataset: str, tokens: Column, fails: Column) -> DataFrame:
    """One row for each dataset: sums and their ratios.  tokens and fails are each record's token count and whether its round trip fails."""
    rows = df.select(F.col(dataset).alias("dataset_id"), F.octet_length(text).cast("long").alias("b"), F.length(text).cast("long").alias("c"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"), tokens.cast("long").alias("t"), fails.cast("long").alias("f"))
    return ratios(rows.groupBy("dataset_id").agg(F.count("*").alias("records"), F.sum("b").alias("utf8_bytes"), F.sum("c").alias("characters"), F.sum("w").alias("words"), F.sum("t").alias("tokens"), F.sum("f").alias("roundtrip_failures")))


def ratios(sums: DataFrame) -> DataFrame:
    c = F.col
    return sums.withColumns({"bytes_per_token": divide(c("utf8_bytes"), c("tokens")), "characters_per_token": divide(c("characters"), c("tokens")), "sequence_fertility": divide(c("tokens"), c("words"))})


def roll_up(fact: DataFrame, groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ratio of sums over named groups.  groups: (group_id, dataset_id); a group's dataset without facts is an error."""
    missing = groups.join(fact.select("dataset_id").distinct(), "dataset_id", "left_anti").first()
    if missing:
        raise KeyError(f"no facts for {missing['dataset_id']!r}")
    sums = ("records", "utf8_bytes", "characters", "words", "tokens", "roundtrip_failures")
    return ratios(fact.join(F.broadcast(groups), "dataset_id").groupBy(*(by or []), "group_id").agg(*[F.sum(s).alias(s) for s in sums]))


def external(fact: DataFrame) -> DataFrame:
    """Datasets whose name doesn't end in "validation"."""
    return fact.where(~F.col("dataset_id").endswith("validation"))


def word_fertility(df: DataFrame, text: str, tokens_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """isolated_word_fertility and single_token_word_rate, weighted by frequency; tokens_of adds `tokens` to distinct words."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    w = tokens_of(words)
    return w.agg(divide(F.sum(F.col("n") * F.col("tokens")), F.sum("n")).alias("isolated_word_fertility"), divide(F.sum(F.when(F.col("tokens") == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("single_token_word_rate"))


def morphology(pairs: DataFrame, boundaries: Column | None = None) -> DataFrame:
    """Suffix-boundary recall over (form, lemma, boundaries array<int>): eligible are inflected forms that begin with their lemma."""
    f, l = F.col("form"), F.col("lemma")
    eligible = f.rlike(r"^\p{L}+$") & l.rlike(r"^\p{L}+$") & (F.length(f) > F.length(l)) & F.startswith(F.lower(f), F.lower(l))
    e = pairs.where(eligible).withColumn("aligned", F.array_contains("boundaries", F.length(l)))
    return e.agg(F.count("*").alias("eligible"), F.sum(F.col("aligned").cast("long")).alias("aligned"), divide(F.sum(F.col("aligned").cast("long")), F.count("*")).alias("recall"), divide(F.sum(F.size("boundaries") + 1), F.count("*")).alias("tokens_per_word"))


def embedding_cost(sizes: DataFrame, vocab: str, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    return sizes.select("*", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width")).withColumn("parameters", F.col(vocab).cast("long") * F.col("width"))


def load_all(loaders: dict[str, Callable]) -> tuple[dict, dict[str, str]]:
    """What could be loaded, and why the rest couldn't; an error only if nothing could."""
    got, failed = {}, {}
    for name, load in loaders.items():
        try:
            got[name] = load()
        except Exception as problem:  # noqa: BLE001  any baseline may be unavailable
            failed[name] = f"{type(problem).__name__}: {problem}"
    if not got:
        raise RuntimeError(f"nothing could be loaded: {failed}")
    return got, failed


def ranking(fact: DataFrame) -> DataFrame:
    return fact.orderBy(F.desc("bytes_per_token"), F.asc("vocab_size"))


def eligible(candidates: DataFrame, baseline: tuple[float, float], main: str, other: str, keep: float = 0.90, gain: float = 1.20) -> DataFrame:
    """No failed round trip, the main figure at least `keep` of the baseline's, the other at least `gain` times it."""
    return candidates.where((F.col("roundtrip_failures") == 0) & (F.col(main) >= keep * baseline[0]) & (F.col(other) >= gain * baseline[1]))


def pareto_front(df: DataFrame, least: list[str], most: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows that no other row of their group dominates: at least as good in all columns and better in one.

    Candidates are few in each group; distinct points are compared, so that repeated rows cost nothing.
    """
    keys, by = [*least, *most], by or []
    points = df.select(*by, *keys).distinct()
    other = points.select(*[F.col(c).alias(f"__{c}") for c in (*by, *keys)])
    no_worse = F.lit(True)
    for c in by:
        no_worse &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    better = F.lit(False)
    for c in keys:
        a, b = F.col(f"__{c}"), F.col(c)
        no_worse &= (a <= b) if c in least else (a >= b)
        better |= (a < b) if c in least else (a > b)
    front = points.join(other, no_worse & better, "left_anti")
    return df.join(front, [*by, *keys], "left_semi")


def choose(front: DataFrame, vocab: str, baseline: tuple[float, float], main: str, other: str) -> DataFrame:
    """The smallest vocabulary on the front, then the largest of the lesser of both ratios to the baseline."""
    return front.orderBy(F.asc(vocab), F.desc(F.least(F.col(main) / baseline[0], F.col(other) / baseline[1]))).limit(1)


def releasable(fact: DataFrame, tokenizer: str) -> None:
    row = fact.where(F.col("tokenizer_id") == tokenizer).agg(F.count("*").alias("n"), F.sum("roundtrip_failures").alias("f")).first()
    if not row["n"]:
        raise ValueError(f"{tokenizer} hasn't been evaluated")
    if row["f"]:
        raise ValueError(f"{tokenizer} fails {row['f']} round trips")


def with_condition(variants: DataFrame, conditions: DataFrame) -> DataFrame:
    return variants.join(conditions, ["style", "share"])


def encode_words(model) -> Callable[[DataFrame], DataFrame]:
    def run(words: DataFrame) -> DataFrame:
        shared = words.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(LongType())
        def size(w: pd.Series) -> pd.Series:
            return w.map(lambda x: len(shared.value.encode(x)))

        return words.withColumn("tokens", size("word"))

    return run
