"""Language identification: pluggable identifiers, the acceptance rule, and the detector of mixed documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.rows import SLICE, by_slices
from ..functions.text import strip


def sampled(text: Column, chars: int = 10_000) -> Column:
    """What an identifier sees: the first characters, lines joined by blanks."""
    return F.regexp_replace(F.substring(text, 1, chars), "[\r\n]+", " ")


def _trigrams(texts: list[str], features: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the feature of every trigram."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    codes = [p[:-2] << 42 | p[1:-1] << 21 | p[2:] for p in points]
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    known, which = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
    if not len(known):
        return row, which
    hashes = _murmur3([f"{chr(c >> 42)} {chr(c >> 21 & 0x1FFFFF)} {chr(c & 0x1FFFFF)}".encode("utf-8", "surrogatepass") for c in known.tolist()])
    return row, (hashes.astype(np.int64) % features)[which]


class ColumnIdentifier:
    """Label and score that upstream has given."""

    def __init__(self, label: str, score: str | None = None):
        self.label, self.score = label, score

    def identify(self, df: DataFrame, text: str) -> DataFrame:
        score = F.col(self.score).cast("double") if self.score else F.when(F.col(self.label).isNotNull(), 1.0)
        none = F.array().cast("array<struct<label:string,score:double>>")
        return df.withColumn("lid", F.struct(F.col(self.label).cast("string").alias("label"), score.alias("score"), none.alias("alternatives")))


def _murmur3(words: list[bytes], seed: int = 42) -> np.ndarray:
    """32-bit MurmurHash3 of each, as a signed number; words of one length at once."""
    turn = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    scramble = lambda x: turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    out, lengths = np.zeros(len(words), np.uint32), np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        run = np.frombuffer(b"".join([words[k] for k in rows.tolist()]), np.uint8).reshape(len(rows), n)
        h = np.full(len(rows), seed, np.uint32)
        for at in range(0, n - 3, 4):
            h = turn(h ^ scramble(np.ascontiguousarray(run[:, at : at + 4]).view("<u4")[:, 0]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 4:
            tail = np.zeros(len(rows), np.uint32)
            for k in range(n % 4):
                tail |= run[:, n // 4 * 4 + k].astype(np.uint32) << np.uint32(8 * k)
            h ^= scramble(tail)
        h ^= np.uint32(n)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
        out[rows] = h ^ h >> np.uint32(16)
    return out.view(np.int32)


class NaiveBayesIdentifier:
    """Character trigrams, hashed, under multinomial naive Bayes; fitted on rows with a label.

    Trigrams are three characters with blanks between them, features their MurmurHash3 (seed 42) modulo their number, counts
    are smoothed by 1, labels are numbered by frequency, then name.
    """

    def __init__(self, features: int = 1 << 14, chars: int = 10_000):
        self.features, self.chars = features, chars

    def _seen(self, text: str) -> Column:
        return F.lower(sampled(F.coalesce(F.col(text), F.lit("")), self.chars))

    def fit(self, df: DataFrame, text: str, label: str) -> NaiveBayesIdentifier:
        features = self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    row, found = _trigrams(part.column(0).to_pylist(), features)
                    names, which = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
                    for k, name in enumerate(names.tolist()):
                        # Behind the features: the number of rows.
                        held = sums.setdefault(name, np.zeros(features + 1, np.int64))
                        held[:features] += np.bincount(found[which[row] == k], minlength=features)
                        held[features] += int((which == k).sum())
            for name, held in sums.items():
                some = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(held[some])], names=["label", "feature", "n"])

        known = df.where(F.col(label).isNotNull()).select(self._seen(text).alias("t"), F.col(label).cast("string").alias("label"))
        found = known.mapInArrow(run, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
        names, feature, n = found.column(0).to_pylist(), found.column(1).to_numpy(), found.column(2).to_numpy()
        rows = {x: c for x, f, c in zip(names, feature.tolist(), n.tolist()) if f == features}
        self.labels = sorted(rows, key=lambda x: (-rows[x], x))
        at = {x: k for k, x in enumerate(self.labels)}
        counts = np.zeros((len(at), features + 1))
        counts[[at[x] for x in names], feature] = n
        docs, counts = counts[:, features], counts[:, :features]
        self.pi = np.log(docs + 1) - np.log(docs.sum() + len(at))
        self.theta = np.log(counts + 1) - np.log(counts.sum(1, keepdims=True) + features)
        return self

    def identify(self, df: DataFrame, text: str, top: int = 3) -> DataFrame:
        shared, features = df.sparkSession.sparkContext.broadcast((self.pi, self.theta)), self.features

        def likely(texts: pa.Array) -> list[list[float]]:
            pi, theta = shared.value
            row, found = _trigrams(texts.to_pylist(), features)
            raw = pi[:, None] + np.array([np.bincount(row, weights=t[found], minlength=len(texts)) for t in theta])
            p = np.exp(raw - raw.max(0))
            return (p / p.sum(0)).T.tolist()

        out = df.withColumn("__a", by_slices(likely, ArrayType(DoubleType()))(self._seen(text)))
        names = F.array(*[F.lit(x) for x in self.labels])
        ranked = F.reverse(F.array_sort(F.transform("__a", lambda p, i: F.struct(p.alias("score"), F.get(names, i).alias("label")))))
        best = F.slice(F.transform(ranked, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))), 1, top)
        return out.withColumn("__b", best).withColumn("lid", F.struct(F.col("__b")[0]["label"].alias("label"), F.col("__b")[0]["score"].alias("score"), F.col("__b").alias("alternatives"))).select(*df.columns, "lid")


def accepts(lid: Column, label: str, least: float = 0.756) -> Column:
    return F.coalesce((lid["label"] == label) & (lid["score"] >= least), F.lit(False))


def with_bypass(df: DataFrame, required: Column, label: str, upstream_score: Column) -> DataFrame:
    """Where identification isn't required, the expected label with upstream's score, and no threshold."""
    given = F.struct(F.lit(label).alias("label"), upstream_score.cast("double").alias("score"), F.array().cast("array<struct<label:string,score:double>>").alias("alternatives"))
    return df.withColumn("lid", F.when(required, F.col("lid")).otherwise(given)).withColumn("lid_accepted", ~required | accepts(F.col("lid"), label))


def spans(df: DataFrame, id: str, text: str, capital: str = "А-ЯЁӨҮҢ", least: int = 100, most: int = 30) -> DataFrame:
    """(id, k, span): parts between blank lines and sentence ends before a capital, long enough, the first ones only."""
    # The pattern, the least length and the most spans.
    parts = F.filter(F.transform(F.split(F.col(text), rf"\n\s*\n|(?<=[.!?])\s+(?=[{capital}])"), strip), lambda s: F.length(s) >= least)
    return df.select(id, F.posexplode(F.slice(parts, 1, most)).alias("k", "span"))


def mixed(labelled: DataFrame, id: str, both: tuple[str, str], least: float, most: int, order: Column) -> DataFrame:
    """Documents whose spans carry both labels with enough score: the first ones in order."""
    seen = labelled.where(F.col("score") >= least).groupBy(id).agg(F.collect_set(F.when(F.col("label").isin(*both), F.col("label"))).alias("labels"))
    return seen.where(F.array_contains("labels", both[0]) & F.array_contains("labels", both[1])).select(id).orderBy(order).limit(most)
