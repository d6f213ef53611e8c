"""The corpus build as stages, each a Parquet table under the artifacts folder with a manifest that chains their settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import dedup, mixture, report
from ..operators.clean import GENERIC, Profile, chunk, clean
from ..sources import readers, sinks


@dataclass
class Config:
    """sources: dicts with source_id, kind, license and the reader's options, in order of priority."""

    sources: list[dict]
    artifacts: str
    profile: Profile = GENERIC
    threshold: float = 0.75
    shingle: int = 5
    source_order: list[str] | None = None
    source_caps: dict[str, int] = field(default_factory=dict)
    accept_caps: dict[str, int] = field(default_factory=dict)
    target_bytes: int = 1 << 60
    modulus: int = 100
    validation: tuple[int, ...] = (0,)
    max_docs: int | None = None

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


class Build:
    STAGES = ("raw", "cleaned", "accepted", "decisions", "mixture")

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    def _path(self, stage: str) -> str:
        return f"{self.config.artifacts}/{stage}"

    def _done(self, stage: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(stage)}/config={self.config.digest()}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _stage(self, stage: str, make: Callable[[], DataFrame], reset: bool = False) -> DataFrame:
        """A stage's table: made once for a configuration, read afterwards."""
        path = f"{self._path(stage)}/config={self.config.digest()}"
        if reset or not self._done(stage):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def raw(self, reset: bool = False) -> DataFrame:
        def make():
            out = None
            for priority, s in enumerate(self.config.sources):
                options = {k: v for k, v in s.items() if k not in ("kind", "license")}
                rows = readers.open_source(self.spark, s["kind"], **options).withColumns({"priority": F.lit(priority), "license": F.lit(s.get("license"))})
                if self.config.max_docs is not None:
                    rows = rows.where(F.col("seq") < self.config.max_docs)
                out = rows if out is None else out.unionByName(rows)
            return out

        return self._stage("raw", make, reset)

    def cleaned(self, reset: bool = False) -> DataFrame:
        def make():
            rows = chunk(self.raw(), self.config.profile.max_chars)
            return clean(rows, self.config.profile).withColumns({"raw_sha256": F.sha2("text", 256), "text_sha256": F.sha2("clean_text", 256), "byte_length": F.octet_length("clean_text").cast("long")})

        return self._stage("cleaned", make, reset)

    def accepted(self, reset: bool = False) -> DataFrame:
        def make():
            ok = self.cleaned().where("reason is null")
            kept = dedup.exact_with_caps(ok, [s["source_id"] for s in self.config.sources], self.config.accept_caps, "source_id", "text_sha256", "byte_length", [F.col("seq"), F.col("chunk_index")])
            return kept.withColumn("doc_id", F.row_number().over(Window.orderBy("priority", "seq", "chunk_index")).cast("long"))

        return self._stage("accepted", make, reset)

    def decisions(self, reset: bool = False) -> DataFrame:
        def make():
            order = F.col("priority"), -F.col("byte_length"), F.col("text_sha256")
            return dedup.near_survivors(self.accepted(), "doc_id", "clean_text", *order, threshold=self.config.threshold, n=self.config.shingle)

        return self._stage("decisions", make, reset)

    def mixture(self, reset: bool = False) -> DataFrame:
        def make():
            c = self.config
            kept = self.accepted().join(self.decisions().where("kept").select("doc_id"), "doc_id", "left_semi")
            order = c.source_order or [s["source_id"] for s in c.sources]
            return mixture.capped_mixture(kept, order, c.source_caps, c.target_bytes, "source_id", "byte_length", [F.col("text_sha256")]).withColumn("split", hashing.split_name(F.col("text_sha256"), c.modulus, c.validation))

        return self._stage("mixture", make, reset)

    def export(self) -> None:
        cols = ["doc_id", "source_id", "upstream_id", "url", "license", "text_sha256", "metrics", "metadata", "tx", "split"]
        sinks.write_splits(self.mixture().select(*cols, F.col("clean_text").alias("text")), self._path("export"))

    def report(self) -> dict:
        cleaned, docs = self.cleaned(), self.accepted().join(self.decisions(), "doc_id")
        funnel = cleaned.groupBy("source_id", F.coalesce("reason", F.lit("accepted")).alias("reason")).count()
        sources = cleaned.select("source_id").distinct()
        return {
            "config": self.config.digest(),
            "funnel": [r.asDict() for r in funnel.orderBy("source_id", "reason").collect()],
            "sources": [r.asDict() for r in report.source_summary(sources, docs.select("source_id", "doc_id", "near_duplicate_of", "byte_length")).orderBy("source_id").collect()],
            "totals": [r.asDict() for r in mixture.totals(self.mixture(), "byte_length", "split", "source_id").orderBy("split", "source_id").collect()],
        }

    def build(self) -> dict:
        self.export()
        return self.report()
