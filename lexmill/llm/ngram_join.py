"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix with its own transpose.

Rows are the distinct shingle sets (copies collapse into one row before anything is multiplied), columns are
shingles.  Columns are ordered by how common they are, rarest first, and only the leading columns of a row enter the
product: two rows of sizes s <= l with Jaccard >= t overlap in at least ceil(t/(1+t) * (s+l)) columns, so one of their
common columns is among the first s - ceil(2t/(1+t) * s) + 1 columns of the smaller row and among the first
l - ceil(t * l) + 1 of the larger one.  The product runs in blocks of columns (one task each); a block streams over its
columns and emits overlap counts, the counts of all blocks are added up, and pairs whose count plus what is left of
either row stays below the size-derived bound are discarded.  The rest is verified on whole sets.

Groups of near copies don't become all their pairs.  A first product links every row only with the most central row
of each column (the one that has the column earliest) and with its neighbour in size; verified links are contracted
into components.  The second product is exact but multiplies only rows of different components, as a link inside a
component can't change the result.

Commonness comes from one array of counters over hashed columns: its size is fixed (WIDTH), it is summed over all
documents, and any counters give right results, because every row uses the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._rows import lean
from ._store import materialize, release, small
from ._words import mix, shingle_sets, signed

#: Counters of the commonness array (1 MiB of 32-bit counters in each task).
WIDTH = 1 << 18
_SLICES = 64
#: Bits of the array that says which whole sets may be wanted (8 MiB); the fuller it is, the more sets are moved in vain.
MARKS = 1 << 26
#: A column of more rows is dealt to blocks of about as many.
HOT_ROWS = 1_000_000
_ROWS_OUT = 200_000
#: Rows with whole texts or sets in a Python worker's batch at most.
BATCH_ROWS = 1000
#: The same where a batch of three numbers a row goes through workers in the same query.
LEADING_ROWS = 4000
#: Shingles of the pairs verified in one round, as a share of the shingles of all rows.
ROUND_SHARE = 0.5
#: A row of more pairs gets copies of its set (more pairs where there are more than a thousand times as many in all).
LEAST_HUB = 64


def _signature(shingles: np.ndarray) -> int:
    """Order-free hash of a set; two equal ones together with equal sizes count as the same set."""
    if not len(shingles):
        return 0
    total = np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True) + np.add.reduce(mix(shingles), keepdims=True)
    return int(total.view(np.int64)[0])


#: Bits of a row's parity map. Two maps differ in at most as many bits as the sets have unshared columns.
PARITY_BITS = 1024


def _parity(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(40) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


class Bounds:
    """Integer forms of the size bounds for Jaccard >= similarity."""

    def __init__(self, similarity: float):
        t = Fraction(similarity).limit_denominator(10_000)
        if not 0 < t <= 1:
            raise ValueError("similarity is above 0 and at most 1")
        self.p, self.q = t.numerator, t.denominator

    def larger(self, n):
        """Leading columns that matter where the row is the larger one."""
        return n + (-self.p * n) // self.q + 1

    def smaller(self, n):
        return n + (-2 * self.p * n) // (self.p + self.q) + 1

    def least_size(self, n):
        return -((-self.p * n) // self.q)

    def overlap(self, a, b):
        return -((-self.p * (a + b)) // (self.p + self.q))

    def reach(self, a, b, at_a, at_b):
        """Whether rows of sizes a and b whose first common column has these places can overlap enough.

        Of a pair that can, the first common column passes, and each column before the last that passes does as well: counts of
        passing columns miss nothing that lies before the last of them.
        """
        need = self.overlap(a, b)
        return (at_a <= a + 1 - need) & (at_b <= b + 1 - need)


def _scan(shingle: int):
    """Per document its key, set size and signature; at the end of a task the counters of its columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, schema = np.zeros(WIDTH, np.int64), None
        for batch in batches:
            key = batch.column(0).type
            schema = pa.schema([("kind", pa.int8()), ("key", key), ("n", pa.int64()), ("sig", pa.int64()), ("parity", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.binary())])
            sizes, signatures, parity, parts = [], [], [], []
            for _, found in shingle_sets(batch.column(1), shingle):
                sizes.append(len(found))
                signatures.append(_signature(found))
                parity.append(_parity(found))
                parts.append((found & np.uint64(WIDTH - 1)).astype(np.int64))
                if len(parts) > 500:
                    counts += np.bincount(np.concatenate(parts), minlength=WIDTH)
                    parts = []
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=WIDTH)
            n = batch.num_rows
            maps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (PARITY_BITS // 64)), pa.array(np.concatenate(parity) if parity else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(signatures, pa.int64()), maps, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if counts.any():
            rows = [np.minimum(c, 2**31 - 1).astype("<i4").tobytes() for c in np.split(counts, _SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(_SLICES, np.int8)), pa.nulls(_SLICES, key), pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.list_(pa.int64())), pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array(rows)], schema=schema)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counter slices that a task was dealt; one row for each slice comes out."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw, "<i4").astype(np.int64)
            sums[k] = sums[k] + part if k in sums else part
    if sums:
        rows = [np.minimum(c, 2**31 - 1).astype("<i4").tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows)], names=["slice", "counts"])


def _counters(scanned: DataFrame) -> np.ndarray:
    """The commonness array: slices are summed as they lie, then by number.  _SLICES rows reach the driver."""
    slices = scanned.where("kind = 1").select("slice", "counts")
    slices = slices.mapInArrow(lean(_add_slices), "slice int, counts binary").repartition(16, "slice").mapInArrow(lean(_add_slices), "slice int, counts binary")
    counts = np.zeros((_SLICES, WIDTH // _SLICES), np.int32)
    for k, raw in slices.collect():
        counts[k] = np.frombuffer(raw, "<i4")
    return counts.ravel()


def _leading(shingle: int, bounds: Bounds, counters):
    """Leading columns of each distinct row: (column, row, size and place packed)."""
    schema = pa.schema([("h", pa.int64()), ("cid", pa.int64()), ("np", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = counters.value, set()
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), shingle):
                n = len(found)
                if not n or (sig := _signature(found)) in seen:
                    continue
                seen.add(sig)
                p = bounds.larger(n)
                order = np.lexsort((found, common[found & np.uint64(WIDTH - 1)]))[:p]
                out.append((found[order], sig, n))
                size += p
                if size >= _ROWS_OUT:
                    yield pack(out)
                    out, size = [], 0
        if out:
            yield pack(out)

    def pack(out):
        lengths = np.array([len(x[0]) for x in out])
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(np.concatenate([x[0] for x in out]))), pa.array(np.repeat(np.array([x[1] for x in out], np.int64), lengths)), pa.array((np.repeat(np.array([x[2] for x in out], np.int64), lengths) << 31) | (place + 1))],
            schema=schema,
        )

    return run


def _columns(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Runs of whole columns from rows sorted by column; every yield ends with the end of a column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(width)]
        cut = int(np.searchsorted(now[0], now[0][-1], "left")) if now[0][0] != now[0][-1] else 0
        if cut or (held and held[-1][0][-1] != now[0][0]):
            if cut:
                yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now])]
                held = [[x[cut:] for x in now]]
            else:
                yield [np.concatenate(x) for x in zip(*held)]
                held = [now]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns with at least two distinct rows; a column of one row gives no product.  Only one row is held back."""
    held, met = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        h, cid, np_ = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(3))
        if held is not None:
            h, cid, np_ = (np.concatenate((x, y)) for x, y in zip(held, (h, cid, np_)))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])
        h, cid, np_ = h[fresh], cid[fresh], np_[fresh]
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[0] = met
        keep[1:] |= same
        keep[:-1] |= same
        held, met = (h[-1:], cid[-1:], np_[-1:]), bool(keep[-1])
        if keep[:-1].any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (h, cid, np_)], names=["h", "cid", "np"])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["h", "cid", "np"])


def _dealt(shared: DataFrame, hot: DataFrame | None, pairs: bool) -> DataFrame:
    """shared with the rows of hot columns dealt to blocks; h names a block then.

    With pairs, a row goes to all pairs of its block with another, so that any two rows of the column meet.  Otherwise to
    its own block only.  Blocks whose names collide, and rows that meet twice, only raise counts: more is verified.
    """
    if hot is None:
        return shared
    named = shared.join(F.broadcast(hot), "h", "left")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    if pairs:
        named = named.select("*", other.alias("other"))
        block = F.xxhash64("h", F.least(own, "other"), F.greatest(own, "other"))
    else:
        block = F.xxhash64("h", own)
    return named.withColumn("h", F.when(F.col("blocks").isNull(), F.col("h")).otherwise(block)).select(*shared.columns)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("pa", pa.int64()), ("pb", pa.int64()), ("c", pa.int64())])
PAIRS = "a long, b long, na long, nb long, pa long, pb long, c long"


class _Pairs:
    """Overlap counts of pairs, added up inside a task before they leave it."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *columns):
        self.parts.append(columns)
        self.size += len(columns[0])

    def flush(self):
        a, b, na, nb, at, bt = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((b, a))
        a, b, na, nb, at, bt = (x[order] for x in (a, b, na, nb, at, bt))
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        counts = np.diff(np.r_[first, len(a)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], na[first], nb[first], np.maximum.reduceat(at, first), np.maximum.reduceat(bt, first), counts)], schema=_PAIRS)


def _star(bounds: Bounds):
    """Product of each row of a column with the column's most central row and with its neighbour in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for h, cid, packed in _columns(batches, 3):
            n, place = packed >> 31, packed & (2**31 - 1)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            lengths = np.diff(np.r_[first, len(h)])
            group = np.repeat(np.arange(len(first)), lengths)
            order = np.lexsort((cid, place * 1.0 / n, group))
            hub = order[first][group]
            me = np.arange(len(h))
            for other in (hub, np.maximum(me - 1, first[group])):
                take(pairs, me, other, cid, n, place)
            if pairs.size >= _ROWS_OUT:
                yield pairs.flush()
        if pairs.size:
            yield pairs.flush()

    def take(pairs, i, j, cid, n, place):
        swap = (n[j] < n[i]) | ((n[j] == n[i]) & (cid[j] < cid[i]))
        s, l = np.where(swap, j, i), np.where(swap, i, j)
        ok = (cid[s] != cid[l]) & (n[s] >= bounds.least_size(n[l])) & bounds.reach(n[s], n[l], place[s], place[l])
        s, l = s[ok], l[ok]
        pairs.add(cid[s], cid[l], n[s], n[l], place[s], place[l])

    return run


def _rest(bounds: Bounds):
    """Exact product of a column's rows, but for rows of one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for h, cid, packed, root in _columns(batches, 4):
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(h)]):
                if b - a < 2 or (root[a:b] == root[a]).all():
                    continue
                c, r, n, place = cid[a:b], root[a:b], packed[a:b] >> 31, packed[a:b] & (2**31 - 1)
                order = np.lexsort((c, n))
                c, r, n, place = c[order], r[order], n[order], place[order]
                # As the smaller row of a pair, and as the larger one of a pair with the smallest row it can have.
                short, lead = place <= bounds.smaller(n), place <= bounds.larger(n)
                # Rows of the column's largest component need no turn of their own: each of their pairs has another row.
                names, inverse, sizes = np.unique(r, return_inverse=True, return_counts=True)
                for i in np.flatnonzero(inverse != np.argmax(sizes)):
                    low, high = np.searchsorted(n, bounds.least_size(n[i])), np.searchsorted(n, (n[i] * bounds.q) // bounds.p, "right")
                    j = np.arange(low, high)
                    j = j[(r[j] != r[i]) & np.where(j > i, short[i] & lead[j], short[j] & lead[i]) & ((inverse[j] == np.argmax(sizes)) | (j > i))]
                    j = j[bounds.reach(n[i], n[j], place[i], place[j])]
                    s, l = np.minimum(i, j), np.maximum(i, j)
                    if len(j):
                        pairs.add(c[s], c[l], n[s], n[l], place[s], place[l])
                    if pairs.size >= _ROWS_OUT:
                        yield pairs.flush()
        if pairs.size:
            yield pairs.flush()

    return run


def _added(pairs: DataFrame, bounds: Bounds) -> DataFrame:
    """Counts of all blocks added up; what can't reach the bound goes."""
    total = pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.sum("c").alias("c"))
    need = F.ceil(F.lit(bounds.p) * (F.col("na") + F.col("nb")) / F.lit(bounds.p + bounds.q) - 1e-9)
    return total.where(F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need).select("a", "b", "na", "nb")


def _plausible(pairs: DataFrame, maps: DataFrame, bounds: Bounds) -> DataFrame:
    """Pairs whose parity maps differ in no more bits than the bound leaves unshared columns; 128 bytes a row, not its set."""
    x, y = (maps.select(F.col("sig").alias(side), F.col("parity").alias(f"m{side}")) for side in "ab")
    differ = F.aggregate(F.zip_with("ma", "mb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    need = F.ceil(F.lit(bounds.p) * (F.col("na") + F.col("nb")) / F.lit(bounds.p + bounds.q) - 1e-9)
    return pairs.join(x, "a").join(y, "b").where(differ <= F.col("na") + F.col("nb") - 2 * need).select("a", "b", "na", "nb")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a bit array of fixed size, with a bit set for each row."""
    marked = None
    for batch in batches:
        marked = np.zeros(MARKS, bool) if marked is None else marked
        marked[np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64) & (MARKS - 1)] = True
    if marked is not None:
        rows = [np.packbits(x).tobytes() for x in np.split(marked, _SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array(rows)], names=["slice", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw, np.uint8)
            found[k] = found[k] | part if k in found else part
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()])], names=["slice", "bits"])


def _marks(ids: DataFrame) -> np.ndarray:
    """The bit array of ids, MARKS bits however many there are; _SLICES rows reach the driver."""
    slices = ids.coalesce(16).mapInArrow(lean(_mark), "slice int, bits binary").repartition(16, "slice").mapInArrow(lean(_either), "slice int, bits binary")
    bits = np.zeros((_SLICES, MARKS // _SLICES // 8), np.uint8)
    for k, raw in slices.collect():
        bits[k] = np.frombuffer(raw, np.uint8)
    return bits.ravel()


def _fetch(shingle: int, wanted, copies: dict[int, int]):
    """Whole sets of the rows that are marked, each once a task but for those of many pairs: these once for each of their copies."""
    schema = pa.schema([("cid", pa.int64()), ("copy", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()

        def pack():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(numbers, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

        for batch in batches:
            names, numbers, sets, size = [], [], [], 0
            for _, found in shingle_sets(batch.column(0), shingle):
                if not len(found) or (sig := _signature(found)) in seen:
                    continue
                at = sig & (MARKS - 1)
                if not bits[at >> 3] >> (7 - (at & 7)) & 1:
                    continue
                seen.add(sig)
                raw = found.tobytes()
                for copy in range(copies.get(sig, 1)):
                    names.append(sig)
                    numbers.append(copy)
                    sets.append(raw)
                    if (size := size + len(raw)) > 8 << 20:
                        yield pack()
                        names, numbers, sets, size = [], [], [], 0
            if names:
                yield pack()

    return run


def _verify(bounds: Bounds):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, counts = [], []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                overlap = int(np.count_nonzero(both[1:] == both[:-1]))
                if bounds.q * overlap >= bounds.p * (len(x) + len(y) - overlap):
                    keep.append(i)
                    counts.append(overlap)
            if keep:
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b"), pa.array(counts, pa.int64()), kept.column("na"), kept.column("nb")], schema=schema)

    return run


def _links(docs: DataFrame, pairs: DataFrame, shingle: int, bounds: Bounds, total: int) -> DataFrame:
    """The pairs whose whole sets are similar enough: (a, b, overlap, na, nb).  total: shingles of all rows.

    Whole sets are by far the heaviest rows here.  They are exchanged once, by their name, which is what both joins
    need (the second one reuses the exchange); but for that only the set of a pair's first row moves, once for each pair.
    Pairs are verified in as many rounds as keep what moves in one below ROUND_SHARE of the corpus, however many pairs
    there are; a round's shuffle files go with it.  A row of many pairs (a hub) gets copies of its set, and its pairs are
    dealt to them; the rows that count as such are at most 2000, as their least number of pairs grows with all pairs.
    """
    spark = docs.sparkSession
    count, moved = pairs.agg(F.count("*"), F.sum(F.col("na") + F.col("nb"))).first()
    limit = max(LEAST_HUB, count // 1000)
    hubs = materialize(pairs.select(F.explode(F.array("a", "b")).alias("hub")).groupBy("hub").agg(F.ceil(F.count("*") / limit).cast("long").alias("copies")).where("copies > 1"))
    copies = {hub: k for hub, k in hubs.collect()}
    for side, other in (("a", "b"), ("b", "a")):
        mine = F.broadcast(hubs).select(F.col("hub").alias(side), F.col("copies").alias("k"))
        pairs = pairs.join(mine, side, "left").withColumn(f"copy_{side}", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1)))).drop("k")
    rounds = max(1, -(-(moved or 0) // max(1, int(total * ROUND_SHARE))))
    links = []
    for k in range(rounds):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
        wanted = spark.sparkContext.broadcast(_marks(part.select(F.explode(F.array("a", "b")).alias("cid"))))
        sets = docs.mapInArrow(lean(_fetch(shingle, wanted, copies)), "cid long, copy long, shingles binary").dropDuplicates(["cid", "copy"])
        x, y = (sets.select(F.col("cid").alias(side), F.col("copy").alias(f"copy_{side}"), F.col("shingles").alias(name)) for side, name in (("a", "x"), ("b", "y")))
        joined = part.join(x, ["a", "copy_a"]).join(y, ["b", "copy_b"])
        links.append(materialize(joined.select("a", "b", "na", "nb", "x", "y").mapInArrow(lean(_verify(bounds)), "a long, b long, overlap long, na long, nb long"), rows=BATCH_ROWS))
        wanted.destroy()
    release(hubs)
    return reduce(DataFrame.unionByName, links)


def similar_documents(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 5, similarity: float = 0.75) -> DataFrame:
    """Exact near-duplicate classes of the rows of df under Jaccard similarity of word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text's set has its distinct `shingle`-word
    runs; a shorter text is one run; a null, empty or blank text has the empty set and is linked with nothing.  Two
    rows link when their sets' Jaccard similarity is at least `similarity`; equal sets always link.  Result columns:
    n_shingles (long), component_id (least non-null id that links reach; null if all ids reached are null; the row's
    own id for an empty set).  Ids may repeat or be null: repeated rows get equal results.  Other columns
    of df aren't carried along: the result has id, n_shingles and component_id, one row for each row of df, whatever other
    columns are named.  Texts may be of any length.  No rows give no rows.
    """
    bounds = Bounds(similarity)
    spark = df.sparkSession
    texts = df.select(F.col(text).cast("string").alias("t"))
    scanned = materialize(df.select(F.col(id).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(lean(_scan(shingle)), f"kind byte, key {df.schema[id].dataType.simpleString()}, n long, sig long, parity array<long>, slice int, counts binary"), rows=BATCH_ROWS)
    counters = spark.sparkContext.broadcast(_counters(scanned))
    rows = scanned.where("kind = 0").select("key", "n", "sig")

    shared = materialize(texts.mapInArrow(lean(_leading(shingle, bounds, counters)), "h long, cid long, np long").repartition("h").sortWithinPartitions("h", "np", "cid").mapInArrow(lean(_shared), "h long, cid long, np long"), rows=LEADING_ROWS)
    counters.destroy()
    hot = materialize(shared.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("h", F.ceil(F.col("n") / HOT_ROWS).cast("long").alias("blocks")))
    dealt = None if hot.isEmpty() else hot
    by_column = _dealt(shared, dealt, False).repartition("h").sortWithinPartitions("h", "np", "cid")
    maps = materialize(scanned.where("kind = 0 and n > 0").select("sig", "parity").dropDuplicates(["sig"]))
    first = materialize(_plausible(_added(by_column.mapInArrow(lean(_star(bounds)), PAIRS), bounds), maps, bounds))
    total = rows.agg(F.sum("n")).first()[0] or 0
    links = _links(texts, first, shingle, bounds, total)
    roots = components(links)
    rest = shared.join(roots, F.col("cid") == F.col("node"), "left").select("h", "cid", "np", F.coalesce("root", "cid").alias("root"))
    rest = _dealt(rest, dealt, True).repartition("h").sortWithinPartitions("h")
    second = _added(rest.mapInArrow(lean(_rest(bounds)), PAIRS), bounds).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = materialize(_plausible(second, maps, bounds))
    release(shared, maps, first, hot)
    if not second.isEmpty():
        links = links.unionByName(_links(texts, second, shingle, bounds, total))
        roots = components(links)
    release(second)

    classes = rows.where("n > 0").groupBy("sig").agg(F.min("key").alias("least"))
    classes = materialize(classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("root", "sig").alias("root")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("sig", "component_id")
    linked = rows.where("n > 0").join(named, "sig").select("key", "n", "component_id")
    alone = rows.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(id), F.col("n").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 5, similarity: float = 0.75) -> DataFrame:
    """df with one row of each class of similar_documents(): the one with the least id; empty texts all stay.

    Ids are expected to be distinct; of rows that share the least id one stays.  Rows whose id is null are compared but
    always stay.
    """
    classes = similar_documents(df, text, id, shingle, similarity)
    gone = materialize(classes.where(F.col("component_id") != F.col(id)).select(F.col(id).alias("__gone")).distinct())
    return df.join(small(gone), F.col(id) == F.col("__gone"), "left_anti")
