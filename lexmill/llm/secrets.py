"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans are found by patterns alone.  Weak parts (short assigned values, long mixed tokens, key or user names,
endpoints) mean nothing alone: a weak secret counts only if its scope, the characters around it, holds an access identifier
or an endpoint.  Parts and scopes meet in an interval join: both are dealt into buckets of the scope's length, an equi-join
by text and bucket finds neighbours, and the interval condition decides.

Places are code points.  `split` gives the gaps between a pattern's matches and `regexp_extract_all` the matches; the running
sum of both lengths gives every match's place, inside the JVM and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts.  identifier and endpoint complement a weak secret.
WEAK_ASSIGN = r"""(?i:pwd|pass|auth|credentials?|private_?key|access_?key|secret_?key|client_?secret)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
WEAK_TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"
IDENTIFIER = r"""(?i:user(?:name)?|login|client_?id|account(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
ENDPOINT = r"(?i:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp|ssh)://[A-Za-z0-9_.:@/?&=%+-]+"
KINDS = ("assign", "access", "hex", "weak_assign", "weak_token")
SPAN = "array<struct<start:bigint,end:bigint>>"


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end) in code points; those whose group is shorter than `least` go."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # Bound to a lambda variable, so that each pattern runs once for a use.
    parts = F.transform(F.array(F.struct(gaps.alias("gap"), F.transform(matches, F.length).alias("length"), inner.alias("inner"))), lambda x: F.arrays_zip(F.slice(x["gap"], F.lit(1), F.size(x["length"])).alias("gap"), x["length"].alias("length"), x["inner"].alias("inner")))[0]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + part["length"]
        fits = F.when(part["inner"] >= least, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(state["found"], fits).alias("found"))

    found = F.aggregate(parts, start, step, lambda state: state["found"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def digest(found: Column, order: tuple[str, ...]) -> Column:
    """kind:start:end of an array of (start, kind, end) by start, then in the order of kinds."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def scan(df: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """df without the text, with `spans`: array of (kind, start, end), and `base`: those of the first three kinds.

    Kinds: assign (a value of 12 characters or more given to a password, secret, token or API key), access (an access key
    identifier), hex (16 digits or more), and the linked ones weak_assign and weak_token, which are there only if an access
    or user identifier or an endpoint begins or ends within `scope` characters of them and they overlap no strong span.
    Null and empty texts have no spans; rows of the same text get the same spans; columns named like the added ones are
    replaced, all others stay.
    """
    taken = {"spans", "base", text.lower()}
    kept = [c for c in df.columns if c.lower() not in taken]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    parts = df.select(
        *[F.col(f"`{c}`") for c in kept], F.sha2(t, 256).alias("__of"),
        F.concat(_of("assign", spans(t, ASSIGN, 1, 12)), _of("access", spans(t, ACCESS)), _of("hex", spans(t, HEX))).alias("__base"),
        F.concat(_of("weak_assign", spans(t, WEAK_ASSIGN)), _of("weak_token", spans(t, WEAK_TOKEN))).alias("__weak"),
        F.concat(_of("identifier", spans(t, IDENTIFIER)), _of("endpoint", spans(t, ENDPOINT))).alias("__other"),
    )
    parts = materialize(parts)
    # One row of each text is enough; only texts with a weak part and something to complement it take part.
    once = parts.where((F.size("__weak") > 0) & (F.size("__base") + F.size("__other") > 0)).select("__of", "__base", "__weak", "__other").dropDuplicates(["__of"])
    bucket = lambda x: F.floor(x / scope)
    weak = once.select("__of", F.explode("__weak").alias("w")).withColumn("b", F.explode(F.sequence(bucket(F.greatest(F.col("w.start") - scope, F.lit(0))), bucket(F.col("w.end") + scope))))
    other = once.select("__of", F.explode(F.concat(F.filter("__base", lambda x: x["kind"] == "access"), F.col("__other"))).alias("o"))
    other = other.withColumn("b", F.explode(F.sequence(bucket(F.col("o.start")), bucket(F.col("o.end")))))
    # What a bucket's parts reach is enough to decide, so that many parts in one bucket stay one row.
    reach = other.groupBy("__of", "b").agg(F.min("o.start").alias("low"), F.max("o.end").alias("high"), F.sort_array(F.collect_set(F.struct("o.start", "o.end"))).alias("all"))
    inside = F.exists("all", lambda o: (o["start"] <= F.col("w.end") + scope) & (o["end"] >= F.col("w.start") - scope) & ~((o["start"] < F.col("w.end")) & (o["end"] > F.col("w.start"))))
    linked = weak.join(reach, ["__of", "b"]).where((F.col("low") <= F.col("w.end") + scope) & (F.col("high") >= F.col("w.start") - scope) & inside)
    linked = linked.groupBy("__of").agg(F.collect_set("w").alias("__linked")).withColumnRenamed("__of", "__linked_of")
    some = F.size("__weak") > 0
    joined = parts.where(some).join(linked, F.col("__of") == F.col("__linked_of"), "left").drop("__linked_of")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    rows = joined.unionByName(parts.where(~some).withColumn("__linked", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    free = F.filter(F.coalesce("__linked", none), lambda w: ~F.exists("__base", lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col("__base").alias("base"), F.concat("__base", free).alias("spans"))
