"""Row-wise Python over Arrow arrays in slices, so that a worker holds the values of a few rows beside Spark's batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows that are worked on, and sent back, at once.
SLICE = 200


def give_back() -> None:
    """What a task freed goes back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_slices(function: Callable[[pa.Array], list | pa.Array], returns: DataType):
    """A user-defined function of one column from what `function` makes of a slice of its values."""
    kind = to_arrow_type(returns)

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                for at in range(0, len(batch), SLICE):
                    yield pa.array(function(batch.slice(at, SLICE)), kind)
        finally:
            give_back()

    return run


def each(function: Callable[[str], object], returns: DataType):
    """by_slices() of a function of one value; nulls stay null."""
    return by_slices(lambda values: [None if v is None else function(v) for v in values.to_pylist()], returns)
