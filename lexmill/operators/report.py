"""Summaries: nearest-rank percentiles, counters, character inventory, source summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import SLICE
from .tables import cut_lineage


def percentiles(df: DataFrame, by: list[str], column: str, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Nearest rank with half-even rounding of (n - 1) * f; nulls don't count; integers come back as they are.

    Values are counted first, so a group is as many rows as it has distinct values.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    d = counted.withColumn("__upto", F.sum("__n").over(w.orderBy(column))).withColumn("__all", F.sum("__n").over(w))
    first = F.col("__upto") - F.col("__n")
    rank = lambda f: F.bround((F.col("__all") - 1) * F.lit(f), 0)
    return d.groupBy(*by).agg(F.sum("__n").alias("n"), *[F.max(F.when((first <= rank(f)) & (rank(f) < F.col("__upto")), F.col(column))).alias(f"p{round(100 * f)}") for f in at], F.max(column).alias("max"))


def counters(df: DataFrame, by: str, metrics: dict) -> DataFrame:
    """(by, metric, value) of sums of expressions: one aggregation, then an unpivot."""
    sums = df.groupBy(by).agg(*[F.sum(e).cast("long").alias(k) for k, e in metrics.items()])
    return sums.unpivot(by, list(metrics), "metric", "value")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points of all texts of a task and how often each occurs."""
    counts = np.zeros(0x110000, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            for text in batch.column(0).slice(at, SLICE).to_pylist():
                if text:
                    found = np.bincount(_points(text))
                    counts[: len(found)] += found
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["point", "n"])


def characters(df: DataFrame, text: str, order: list[str], k: int = 50) -> DataFrame:
    """The k most frequent characters; ties by where they come first in the order of rows.

    Only characters that are as frequent as another among the first are looked for in the rows again.
    """
    counted = cut_lineage(df.select(text).mapInArrow(_counts, "point int, n long").groupBy("point").agg(F.sum("n").alias("n")))
    best = [r.n for r in counted.orderBy(F.desc("n")).limit(k).collect()]
    top = counted.where(F.col("n") >= (best[-1] if best else 0))
    tied = top.join(top.groupBy("n").count().where("count > 1"), "n", "left_semi").select("point").toArrow().column(0).to_numpy()
    wanted = np.zeros(0x110000, bool)
    wanted[tied] = True
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if len(tied) else ():
            for at in range(0, batch.num_rows, SLICE):
                part, rows, points, places = batch.slice(at, SLICE), [], [], []
                for i, t in enumerate(part.column(0).to_pylist()):
                    if t:
                        hit = np.flatnonzero(shared.value[all_ := _points(t)])
                        found, first = np.unique(all_[hit], return_index=True)
                        rows.append(np.full(len(found), i))
                        points.append(found)
                        places.append(hit[first])
                if rows:
                    rows = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(points).astype(np.int32)), *[part.column(c + 1).take(rows) for c in range(len(order))], pa.array(np.concatenate(places).astype(np.int32))], names=["point", *order, "__at"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    places = df.select(text, *order).mapInArrow(firsts, f"point int, {kinds}, __at int").groupBy("point").agg(F.min(F.struct(*order, "__at")).alias("__first"))
    top = top.join(places, "point", "left").orderBy(F.desc("n"), "__first").limit(k)
    code = F.lpad(F.hex("point"), 8, "0")
    return top.select(F.decode(F.unhex(code), "UTF-32").alias("char"), F.concat(F.lit("U+"), F.lpad(F.regexp_replace(code, "^0+", ""), 4, "0")).alias("codepoint"), "n")


def word_frequencies(df: DataFrame, text: str, pattern: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def source_summary(sources: DataFrame, documents: DataFrame, source: str = "source_id") -> DataFrame:
    """Documents and near-unique documents of every source; one without documents has 0 of both."""
    joined = sources.join(documents, source, "left")
    real = F.col("doc_id").isNotNull()
    return joined.groupBy(source).agg(F.count(F.when(real, 1)).alias("exact_unique"), F.count(F.when(real & F.col("near_duplicate_of").isNull(), 1)).alias("near_unique"), F.coalesce(F.sum(F.when(F.col("near_duplicate_of").isNull(), F.col("byte_length"))), F.lit(0)).alias("near_unique_bytes"))
