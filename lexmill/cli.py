"""Command line: python -m lexmill.cli corpus|tokenizer ACTION."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lexmill")
    kinds = top.add_subparsers(dest="what", required=True)
    corpus = kinds.add_parser("corpus")
    corpus.add_argument("action", choices=["collect", "dedup", "export", "report", "build"])
    corpus.add_argument("--config", required=True, help="JSON: the fields of plans.corpus.Config")
    corpus.add_argument("--reset", action="store_true")
    corpus.add_argument("--source", action="append")
    corpus.add_argument("--max-docs", type=int)
    tok = kinds.add_parser("tokenizer")
    tok.add_argument("action", choices=["train", "evaluate", "inspect"])
    tok.add_argument("--input", help="Parquet with a column text")
    tok.add_argument("--style", default="cased", choices=["cased", "sequential"])
    tok.add_argument("--vocab-size", type=int, default=32768)
    tok.add_argument("--model", required=True)
    tok.add_argument("--text", default="")
    a = top.parse_args(argv)

    from .operators import bpe, evaluate
    from .operators.clean import CYRILLIC, GENERIC
    from .plans.corpus import Build, Config

    if a.what == "tokenizer" and a.action == "inspect":
        print(json.dumps(bpe.Model.from_json(Path(a.model).read_text()).inspect(a.text), ensure_ascii=False))
        return 0
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if a.what == "corpus":
        c = json.loads(Path(a.config).read_text())
        c["profile"] = {"cyrillic": CYRILLIC, "generic": GENERIC}[c.get("profile", "generic")]
        c["sources"] = [s for s in c["sources"] if not a.source or s["source_id"] in a.source]
        build = Build(spark, Config(**c, max_docs=a.max_docs))
        steps = {"collect": lambda: build.accepted(a.reset).count(), "dedup": lambda: build.decisions(a.reset).count(), "export": build.export, "report": build.report, "build": build.build}
        print(json.dumps(steps[a.action](), ensure_ascii=False, default=str))
        return 0
    df = spark.read.parquet(a.input)
    if a.action == "train":
        Path(a.model).write_text(bpe.train(df, "text", a.vocab_size, a.style).to_json())
        return 0
    model = bpe.Model.from_json(Path(a.model).read_text())
    d = df.select("text").withColumn("dataset_id", _lit(Path(a.input).name)).withColumn("__ok", bpe.round_trip(df, model, "text"))
    counted = bpe.token_lengths(d.selectExpr("xxhash64(text) as k", "text").dropDuplicates(["k"]), model, "k", "text")
    d = d.selectExpr("*", "xxhash64(text) as k").join(counted, "k")
    evaluate.facts(d, "text", "dataset_id", d["tokens"], ~d["__ok"]).show(truncate=False)
    return 0


def _lit(value: str):
    from pyspark.sql import functions as F

    return F.lit(value)


if __name__ == "__main__":
    raise SystemExit(main())
