"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, language, source).  A budget goes down the tree by the weights of each node's children.  A child
that can't use its share (its documents, times the epochs allowed, have fewer tokens) leaves the rest to its siblings
in proportion to their weights; only what all siblings can't use goes up to the parent's siblings.  A leaf's budget then takes
whole epochs and a token-prefix of one more, in an order seeded by epoch.

The prefix never sorts a leaf in one task: documents are dealt into slots by their seeded hash, slot totals (SLOTS a leaf
at most) are summed in order, and only the slot in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

SLOTS = 4096
LEVELS = ("domain", "lang", "source")
#: A tree with more leaves than this isn't a weight table.
MOST_LEAVES = 200_000


def tokens(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(budget: int, children: Mapping, capacity: Mapping, weights: Mapping) -> dict:
    """Budgets of children: by weight, what one can't use goes to the others, in whole tokens (rest by largest fraction, then name).

    Children without a weight count 1; weights of 0 get nothing unless nobody else can use it.
    """
    out = dict.fromkeys(children, 0)
    left = min(budget, sum(capacity[c] for c in children))
    open_ = {c for c in children if capacity[c] > 0}
    while left > 0 and open_:
        group = {c for c in open_ if weights.get(c, 1) > 0} or open_
        total = sum(weights.get(c, 1) or 1 for c in group)
        share = {c: left * (weights.get(c, 1) or 1) / total for c in group}
        full = {c for c in group if share[c] >= capacity[c] - out[c]}
        if full:
            for c in full:
                left -= capacity[c] - out[c]
                out[c] = capacity[c]
            open_ -= full
            continue
        floors = {c: int(share[c]) for c in group}
        rest = left - sum(floors.values())
        for c in sorted(group, key=lambda c: (-(share[c] - floors[c]), str(c))):
            extra = min(1, rest)
            rest -= extra
            out[c] += floors[c] + extra
        left = 0
    return out


def plan(available: dict[tuple, int], total: int, weights: Mapping[tuple, float] | None = None, epochs: int = 2) -> dict[tuple, int]:
    """Budget of each leaf.  available: tokens by path; weights: by path prefix, e.g. ("web",) or ("web", "en")."""
    weights = weights or {}
    capacity: dict[tuple, int] = {}
    for path, n in available.items():
        for k in range(len(path) + 1):
            capacity[path[:k]] = capacity.get(path[:k], 0) + n * epochs
    children: dict[tuple, list] = {}
    for path in sorted(capacity, key=lambda p: (len(p), tuple(map(str, p)))):
        if path:
            children.setdefault(path[:-1], []).append(path)
    budget = {(): min(total, capacity.get((), 0))}
    for path in sorted(children, key=len):
        budget |= share_out(budget[path], children[path], capacity, weights)
    return {path: budget[path] for path in available}


def mix(df: DataFrame, domain: Column, total: int | float = 0.5, weights: Mapping[tuple, float] | None = None, epochs: int = 2, seed: int = 17, text: str = "text", id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of df that the budget takes, with domain (string), n_tokens (long) and epoch (int, from 0).

    total: tokens, or a share of df's tokens if it is a float of at most 1.  A row comes once for each epoch that takes it.  In an
    epoch, rows are in the order of a hash of seed, epoch, id and text; a leaf takes the longest prefix whose tokens
    stay within what is left of its budget.  Null domains, languages and sources are leaves of their own, named null.  Rows
    without tokens cost nothing and come with the prefix they stand in.  Repeated rows are separate rows that stand side by side;
    those that tie in everything are taken or left together.  Columns domain, n_tokens and epoch are replaced, all others stay.
    """
    keys = ["__domain", "__lang", "__source"]
    rows = df.withColumns({"__domain": domain.cast("string"), "__lang": F.col(lang).cast("string"), "__source": F.col(source).cast("string"), "__tokens": tokens(F.col(text))})
    light = materialize(rows.select(*keys, "__tokens", F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("__row")))
    leaves = light.groupBy(*keys).agg(F.sum("__tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves; map sources to fewer names first")
    available = {tuple(r[:3]): r["n"] for r in leaves}
    goal = int(sum(available.values()) * total) if isinstance(total, float) and total <= 1 else int(total)
    budgets = plan(available, goal, weights, epochs)
    cuts = [(*path, e, min(available[path], budgets[path] - e * available[path])) for path in available for e in range(epochs) if budgets[path] > e * available[path]]
    schema = "d string, l string, s string, epoch int, left long"
    cut = F.broadcast(df.sparkSession.createDataFrame(cuts, schema))
    same = F.col("__domain").eqNullSafe(F.col("d")) & F.col("__lang").eqNullSafe(F.col("l")) & F.col("__source").eqNullSafe(F.col("s"))
    place = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("__row"))
    dealt = light.join(cut, same).drop("d", "l", "s").withColumn("__h", place).withColumn("__slot", F.shiftrightunsigned("__h", 52))
    leaf = [*keys, "epoch"]
    slots = dealt.groupBy(*leaf, "__slot", "left").agg(F.sum("__tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("before", upto - F.col("n"))
    edge = slots.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left"))).groupBy(*leaf).agg(F.min(F.struct("__slot", "before")).alias("e")).select(*leaf, "e.*")
    edge = F.broadcast(edge.select(F.col("__domain").alias("d"), F.col("__lang").alias("l"), F.col("__source").alias("s"), F.col("epoch").alias("ep"), F.col("__slot").alias("last"), "before"))
    dealt = dealt.join(edge, same & (F.col("epoch") == F.col("ep")), "left").drop("d", "l", "s", "ep")
    whole = dealt.where(F.col("last").isNull() | (F.col("__slot") < F.col("last")))
    within = Window.partitionBy(*leaf, "__slot").orderBy("__h")
    part = dealt.where(F.col("__slot") == F.col("last")).withColumn("upto", F.col("before") + F.sum("__tokens").over(within)).where(F.col("upto") <= F.col("left")).drop("upto")
    # One list of epochs for each row key goes back to the rows; rows of one key stand or go together.
    taken = materialize(whole.unionByName(part).groupBy(F.col("__row").alias("__key")).agg(F.sort_array(F.collect_set("epoch")).alias("__epochs")))
    joined = rows.withColumn("__row", F.xxhash64(F.col(id).cast("string"), F.col(text))).join(F.broadcast(taken) if taken.count() <= 1_000_000 else taken, F.col("__row") == F.col("__key"))
    out = joined.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("domain", "n_tokens", "epoch")], F.col("__domain").alias("domain"), F.col("__tokens").alias("n_tokens"), F.explode("__epochs").alias("epoch"))
    return out
