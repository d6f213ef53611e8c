"""Shared intermediate tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What is broadcast at most, in bytes of a hash table; larger tables are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexmill-"))
    return f"file://{_own[0]}"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Inside, Python workers get batches of so many rows at most, so that texts of a batch stay small."""
    before = spark.conf.get(_BATCH, None)
    if rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        if rows:
            spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def give_back(spark: SparkSession) -> bool:
    """Native memory that the driver's JVM has freed goes back to the system; False where the JVM has no command for that.

    Compiling plans takes and frees much of it, and the allocator keeps what it once got.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # By the interface's method, as the server's own class isn't open to reflection.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        command, kinds, every = new(jvm.java.lang.Object, 1), new(jvm.java.lang.String, 1), new(jvm.java.lang.Object, 4)
        command[0], kinds[0] = new(jvm.java.lang.String, 0), "[Ljava.lang.String;"
        every[0], every[1], every[2], every[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", command, kinds
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), every)
    except Py4JError:
        return False
    return True


def materialize(df: DataFrame, *hashes: str, rows: int | None = None) -> DataFrame:
    """Write df under the shared folder and read it back.  Columns of hashes (Parquet paths) are written without a dictionary.

    rows: rows of a Python worker's batch at most, as the session says if None.

    A lost executor then costs a re-read, never a recomputation of everything before.  The files go with release(), or
    else when the session ends; the shuffle files of the query that wrote them go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    with _shuffles_go(spark), _batches_of(spark, rows):
        df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
    give_back(spark)
    files, jvm_path = _files(spark, path)
    files.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "_stage", None)
        if path:
            files, jvm_path = _files(table.sparkSession, path)
            files.delete(jvm_path, True)
            table._stage = None


def small(table: DataFrame, row_bytes: int = 32) -> DataFrame:
    """A materialized table, broadcast if its rows, of row_bytes each in a hash table, are few enough."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def without(df: DataFrame, names) -> DataFrame:
    """df without the columns whose names an operator is about to write (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
