"""Corpus pipeline: five stages, each written as Parquet and read back as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, language, line_dedup, mixing, ngram_join
from lexmill.llm._rows import neutral
from lexmill.llm._store import materialize
from lexmill.llm.queries import WEIGHTS, domain_of, table

#: Not SQL: the classifier of the first stage and the seeded mixture of the last. Tested against a brute-force version.
ORACLE_SQL = None
WORD = r"[^\x20\x09-\x0D]"
#: Documents of a Python worker's batch at most, as workers live as long as the pipeline and keep what they once took.
BATCH_ROWS = 1000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts that are null or have no letter go; lang becomes the predicted language.

    The classifier learns from a bounded number of the documents that have a language already.
    """
    model = language.fit(docs)
    renamed, text, own = neutral(docs, "text")
    found = language.identify(renamed, model, text).where(F.col("lang_pred") != language.UNDETERMINED)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else o for c, o in zip(docs.columns, own)])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to earlier ones; n_chars follows; documents that lose all their words go."""
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id."""
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: half of the tokens there are, by the weights of domain, language and source."""
    return mixing.mix(docs, domain_of(F.col("source")), 0.5, WEIGHTS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_ngrams),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, rows=BATCH_ROWS)
    return docs
