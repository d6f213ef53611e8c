"""Row-wise operators: add columns to a DataFrame, batch by batch, without a shuffle."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are worked on, and sent back, at once.
SLICE = 1000


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, but what a task freed goes back to the system when it ends.

    Python workers outlive their tasks, so that the allocators' unused pages of one stage would count in the next.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def add_columns(df: DataFrame, inputs: list[str], added: str, make: Callable[[], Callable[..., list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns computed from string columns.

    added: a DDL schema; make() is called once in each task and returns a function from Arrow arrays (the inputs) to
    the arrays of the added columns.  Columns of df that are named like an added one are replaced (their values still
    serve as inputs); `drop` isn't carried along.  All other columns pass unchanged, whatever their types.  An input that
    is a string and stays is sent once.
    """
    new = T._parse_datatype_string(added)
    names = new.fieldNames()
    taken = {n.lower() for n in (*names, *drop)}
    kept = [c for c in df.columns if c.lower() not in taken]
    sent = [c for c in inputs if c not in kept or df.schema[c].dataType != T.StringType()]
    work = df.select(*[df[f"`{c}`"] for c in kept], *[df[f"`{c}`"].cast("string").alias(f"__in{k}") for k, c in enumerate(sent)])
    schema = T.StructType([*[df.schema[c] for c in kept], *new.fields])
    at = [len(kept) + sent.index(c) if c in sent else kept.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for whole in batches:
            function = function or make()
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                columns = function(*[batch.column(k) for k in at])
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(kept))], *columns], names=[*kept, *names])

    return work.mapInArrow(lean(run), schema)


def neutral(df: DataFrame, column: str) -> tuple[DataFrame, str, list[Column]]:
    """df with column names that nothing clashes with, the new name of `column`, and what gives df's columns back."""
    names = [f"__c{k}" for k in range(len(df.columns))]
    found = next(k for k, c in enumerate(df.columns) if c.lower() == column.lower())
    return df.toDF(*names), names[found], [F.col(n).alias(c) for n, c in zip(names, df.columns)]
