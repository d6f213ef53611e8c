"""Sinks: split shards, audit samples, manifests, reports."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import bottom_k
from .readers import file_digests


def write_splits(df: DataFrame, path: str, split: str = "split", text: str = "text", codec: str = "gzip", rows_per_file: int = 0) -> None:
    """path/jsonl/split=.../ with columns in alphabetic order and path/text/split=.../ with each text and a blank line."""
    options = {"maxRecordsPerFile": rows_per_file, "compression": codec}
    rest = sorted(c for c in df.columns if c != split)
    df.select(split, *rest).write.mode("overwrite").options(**options).partitionBy(split).json(f"{path}/jsonl")
    df.select(split, F.concat(text, F.lit("\n")).alias("value")).write.mode("overwrite").options(**options).partitionBy(split).text(f"{path}/text")


def shard_numbers(df: DataFrame, split: str, size: Column, order: list[Column], most: int = 64 << 20) -> DataFrame:
    """df with shard: a split's texts, each with two line feeds, in order; a shard that has `most` bytes or more is closed.

    A null size counts as 0.  The next shard starts from 0 bytes again, so that its start depends on all rows before: a
    split is one task, which streams over sorted rows and holds a counter only.
    """
    work = df.withColumn("__size", (F.coalesce(size, F.lit(0)) + 2).cast("long")).repartition(split).sortWithinPartitions(split, *order)
    kept = [f for f in df.schema.fields if f.name != "shard"]
    names = [f.name for f in kept]

    def run(batches):
        current, shard, held = object(), 0, 0
        for batch in batches:
            splits, sizes = batch.column("split").to_pylist(), batch.column("size").to_numpy(zero_copy_only=False)
            out, i = np.zeros(len(sizes), np.int32), 0
            while i < len(sizes):
                if splits[i] != current:
                    current, shard, held = splits[i], 0, 0
                j = i + 1
                while j < len(sizes) and splits[j] == current:
                    j += 1
                total = np.cumsum(sizes[i:j])
                done, at = 0, 0
                while at < j - i:
                    if held >= most:
                        shard, held = shard + 1, 0
                    last = int(np.searchsorted(total, done + most - held))
                    upto = min(last + 1, j - i)
                    out[i + at : i + upto] = shard
                    held += int(total[upto - 1]) - done
                    at, done = upto, int(total[upto - 1])
                i = j
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{k}") for k in range(len(names))], pa.array(out)], names=[*names, "shard"])

    passed = work.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)], F.col(split).alias("split"), F.col("__size").alias("size"))
    return passed.mapInArrow(run, T.StructType([*kept, T.StructField("shard", T.IntegerType())]))


def manifest(spark: SparkSession, path: str) -> list[dict]:
    rows = file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("path"), "bytes", "sha256").orderBy("path")
    return [r.asDict() for r in rows.collect()]


def audit_rejected(df: DataFrame, source: str, reason: str, raw: str, id: str, k: int = 10, chars: int = 2000) -> DataFrame:
    """The k rejected rows of each source and reason whose raw text has the least digest."""
    return bottom_k(df.where(F.col(reason).isNotNull()), [source, reason], k, F.substring(F.sha2(raw, 256), 1, 16), F.col(id)).withColumn("sample", F.substring(raw, 1, chars)).orderBy(source, reason, id)


def audit_accepted(df: DataFrame, source: str, sha: str, text: str, k: int = 20, chars: int = 2000) -> DataFrame:
    return bottom_k(df, [source], k, F.col(sha)).withColumn("sample", F.substring(text, 1, chars)).orderBy(source, sha)


def write_json(path: str, value: dict) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report's table; reports are small, and longer ones are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
