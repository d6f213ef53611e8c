"""Hash split, capped prefix mixture, quotas and skip-fit sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import running


def capped_mixture(df: DataFrame, sources: list[str], caps: dict[str, int], target: int, source: str, size: str, order: list[Column]) -> DataFrame:
    """Source after source, rows in order as long as neither the source's cap nor the target is passed; the first that would ends the source."""
    out, used = None, 0
    for name in sources:
        if used >= target:
            break
        room = min(caps.get(name, target), target - used)
        rows = df.where(F.col(source) == name)
        rows = rows.withColumn("__u", running(rows, size, [source], order)).where(F.col("__u") <= room).drop("__u")
        used += rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else df.limit(0)


def totals(df: DataFrame, size: str, *by: str) -> DataFrame:
    """Rows and bytes by each column, by all of them and overall, in one pass."""
    return df.cube(*by).agg(F.count("*").alias("docs"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def largest_remainder(df: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """df with quota: floors of proportional shares; what is left goes, one each, by fraction and key, both descending.

    Exact in whole numbers.  The sum of sizes must be at least the budget.  (One row a source, so one task is enough.)
    """
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if budget > total:
        raise ValueError(f"budget {budget} is above what there is: {total}")
    product = F.col(size).cast("decimal(28,0)") * F.lit(budget).cast("decimal(10,0)") if budget < 10**10 else F.col(size).cast("decimal(19,0)") * F.lit(budget).cast("decimal(19,0)")
    d = df.withColumn("__m", (product % F.lit(max(total, 1))).cast("decimal(38,0)")).withColumn("__f", ((product - F.col("__m")) / F.lit(max(total, 1))).cast("long"))
    left = budget - (d.agg(F.coalesce(F.sum("__f"), F.lit(0))).first()[0])
    rank = F.row_number().over(Window.orderBy(F.desc("__m"), F.desc(key)))
    return d.withColumn("quota", F.col("__f") + F.when(rank <= left, 1).otherwise(0)).drop("__m", "__f")


def skip_fit(df: DataFrame, quotas: dict[str, int], source: str, order: str, size: str) -> DataFrame:
    """Rows in order that still fit into their source's quota; one that doesn't is passed over, later ones may fit.

    Each decision rests on all before it, so a source is one sequential scan; only (order, size) pairs take part, and rows above
    the quota are left out beforehand.
    """
    schema = f"{source} {dict(df.dtypes)[source]}, {order} {dict(df.dtypes)[order]}"

    def scan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, keep = quotas.get(key[0], 0), []
        for i, n in enumerate(rows.sort_values(order)[size].tolist()):
            keep.append(n <= left)
            left -= n if keep[i] else 0
        return rows.sort_values(order)[keep][[source, order]]

    cap = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]) if quotas else F.create_map().cast("map<string,bigint>")
    slim = df.select(source, order, size).where(F.col(size) <= F.try_element_at(cap, F.col(source)))
    return df.join(slim.groupBy(source).applyInPandas(scan, schema), [source, order])


def supplement_quota(total: int, share: float) -> tuple[int, int]:
    """(main, supplement): the supplement gets round(total * share)."""
    if not 0 <= share < 1:
        raise ValueError("share is from 0 to below 1")
    return total - round(total * share), round(total * share)
