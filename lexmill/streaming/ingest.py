"""Incremental ingest: new files are cleaned as they come; a text that was accepted before isn't accepted again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import GENERIC, Profile, clean
from ..operators.dedup import exact


def ingest(spark: SparkSession, inbox: str, schema: str, accepted: str, checkpoint: str, profile: Profile = GENERIC, id: str = "upstream_id") -> StreamingQuery:
    """Parquet files under `inbox` to Parquet under `accepted`, once for each digest of the clean text."""

    def batch(rows: DataFrame, number: int) -> None:
        new = clean(rows, profile).where("reason is null").withColumn("text_sha256", F.sha2("clean_text", 256))
        new = exact(new, "text_sha256", F.col(id))
        path = spark._jvm.org.apache.hadoop.fs.Path(accepted)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            # Rows of a batch that is run again after a failure replace those it wrote.
            before = spark.read.parquet(accepted).where(F.col("batch") != number)
            new = new.join(before.select("text_sha256"), "text_sha256", "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(accepted)

    stream = spark.readStream.schema(schema).parquet(inbox)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
