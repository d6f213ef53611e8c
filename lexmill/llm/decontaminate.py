"""Benchmark decontamination by winnowing.

A text's fingerprints are the least K-gram hash of every SPAN consecutive K-grams (ties all kept).  Two texts that
share WINDOW = K + SPAN - 1 words share a whole span of K-grams and so its fingerprint: no shared window is missed.
Document and benchmark fingerprints are joined by value, and each hit is extended along its diagonal to the longest
equal run of words; runs of at least WINDOW words count.  Items of fewer words than a window are found by the hash of
the whole item instead.

The benchmark is dealt into blocks of a bounded number of words.  A block is broadcast and joined with the documents as
they are scanned: documents are never shuffled, a hot source or a passage that a third of them contain makes no hot
task, and a benchmark of any size costs more scans, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import add_columns, neutral
from ._store import materialize, without
from ._words import ALNUM, blocks, grams

K = 5
#: Words of benchmark text in a block that is broadcast; about 40 bytes each.
BLOCK_WORDS = 1_000_000


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash of each run of `span` hashes, ties included; none if there are fewer."""
    if len(hashes) < span:
        return np.empty(0, np.int64)
    least = hashes[: len(hashes) - span + 1]
    for k in range(1, span):
        least = np.minimum(least, hashes[k : k + len(least)])
    # A place is chosen if the largest of the minima of the runs around it is its own hash.
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    most = padded[: len(hashes)]
    for k in range(1, span):
        most = np.maximum(most, padded[k : k + len(hashes)])
    return np.flatnonzero(most == hashes)


class Items:
    """A block of benchmark items, ready to be matched: sorted fingerprints with the places they come from."""

    def __init__(self, ids: list[str], texts: list[str], window: int, k: int):
        self.ids, self.window, self.k = ids, window, k
        self.words: list[np.ndarray] = []
        for block in blocks(pa.array(texts, pa.large_string()), ALNUM):
            self.words += [block.hashes[block.bounds[i] : block.bounds[i + 1]] for i in range(block.rows)]
        found = []
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        short: dict[int, list] = {}
        for item, words in enumerate(self.words):
            if len(words) >= window:
                runs = grams(words, k)
                found += [(int(runs[p]), item, int(p)) for p in winnow(runs, window - k + 1)]
            elif len(words):
                short.setdefault(len(words), []).append((int(grams(words, len(words))[0]), item))
        found.sort()
        self.prints = np.array([x[0] for x in found], np.uint64)
        self.item = np.array([x[1] for x in found], np.int64)
        self.place = np.array([x[2] for x in found], np.int64)
        for n, pairs in short.items():
            pairs.sort()
            self.short[n] = (np.array([x[0] for x in pairs], np.uint64), np.array([x[1] for x in pairs], np.int64))

    def hits(self, words: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Equal runs (start, end) of a document's words and the items they come from, given places of fingerprints."""
        spans, items, done = [], set(), set()
        low, high = np.searchsorted(self.prints, hashes, "left"), np.searchsorted(self.prints, hashes, "right")
        for place, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
            for x in range(a, b):
                item = int(self.item[x])
                shift = place - int(self.place[x])
                if (item, shift) in done:
                    continue
                done.add((item, shift))
                theirs = self.words[item]
                start, end = max(0, shift), min(len(words), shift + len(theirs))
                equal = np.concatenate(([False], words[start:end] == theirs[start - shift : end - shift], [False]))
                edges = np.flatnonzero(equal[1:] != equal[:-1])
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if e - s >= self.window:
                        spans.append((start + s, start + e))
                        items.add(item)
        for n, (prints, owners) in self.short.items():
            runs = grams(words, n)
            low, high = np.searchsorted(prints, runs, "left"), np.searchsorted(prints, runs, "right")
            for p in np.flatnonzero(high > low).tolist():
                for item in owners[low[p] : high[p]].tolist():
                    if (self.words[item] == words[p : p + n]).all():
                        spans.append((p, p + n))
                        items.add(item)
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _matcher(shared):
    def make():
        items: Items = shared.value
        k, span = items.k, items.window - items.k + 1

        def run(column: pa.Array, spans_before: pa.Array, items_before: pa.Array) -> list[pa.Array]:
            n_words, all_spans, all_items = [], spans_before.to_pylist(), items_before.to_pylist()
            for block in blocks(column, ALNUM):
                n_words += np.diff(block.bounds).tolist()
                runs = grams(block.hashes, k)
                at = np.searchsorted(items.prints, runs) if len(items.prints) else np.zeros(len(runs), np.int64)
                known = items.prints[np.minimum(at, len(items.prints) - 1)] == runs if len(items.prints) else np.zeros(len(runs), bool)
                where = np.flatnonzero(known)
                rows = np.unique(np.searchsorted(block.bounds, where, "right") - 1).tolist() if not items.short else range(block.rows)
                for i in rows:
                    a, b = int(block.bounds[i]), int(block.bounds[i + 1])
                    words, own = block.hashes[a:b], runs[a : max(a, b - k + 1)]
                    places = winnow(own, span)
                    places = places[known[a : a + len(own)][places]]
                    spans, found = items.hits(words, places, own[places])
                    if spans:
                        row = block.first + i
                        before = [tuple(map(int, x.split("-"))) for x in (all_spans[row] or "").split(",") if x]
                        all_spans[row] = ",".join(f"{s}-{e}" for s, e in _merged(before + spans))
                        names = {items.ids[x] for x in found}
                        all_items[row] = "\x00".join(sorted(names | set((all_items[row] or "").split("\x00")) - {""} if all_items[row] else names))
            return [pa.array(n_words, pa.int64()), pa.array(all_spans, pa.string()), pa.array(all_items, pa.string())]

        return run

    return make


def _item_blocks(benchmark: DataFrame, id: str, text: str, block_words: int) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark in bounded blocks, in whatever order; one block at a time is on the driver."""
    ids, texts, size = [], [], 0
    for item, words in benchmark.select(F.col(id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        if item is None or not words:
            continue
        ids.append(item)
        texts.append(words)
        size += len(words) // 4 + 1
        if size >= block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df with n_words (long), hit_spans (array of (start, end) in words, merged, in order) and hit_items (array of ids as strings, sorted).

    Words are runs of ASCII letters, digits and anything outside ASCII, A-Z lower-cased.  A hit is a run of at least
    `window` words that a benchmark item has as well; an item of fewer words, but not none, counts as a whole.  Null and
    empty texts have no words and no hits; items with a null id or no words can't be hit; repeated rows and items get
    equal results.  Columns named like the added ones are replaced, all others stay.  An empty benchmark hits nothing.
    """
    if not 1 <= k <= window:
        raise ValueError("k is at least 1 and at most window")
    spark = df.sparkSession
    out = without(df, ["n_words", "__spans", "__items"]).withColumns({"__spans": F.lit(None).cast("string"), "__items": F.lit(None).cast("string")})
    n = 0
    for ids, texts in _item_blocks(benchmark, item_id, item_text, block_words):
        shared = spark.sparkContext.broadcast(Items(ids, texts, window, k))
        out = add_columns(out if n == 0 else materialize(out), [text, "__spans", "__items"], "n_words long, __spans string, __items string", _matcher(shared))
        n += 1
    if not n:
        shared = spark.sparkContext.broadcast(Items([], [], window, k))
        out = add_columns(out, [text, "__spans", "__items"], "n_words long, __spans string, __items string", _matcher(shared))
    spans = F.transform(F.split("__spans", ","), lambda x: F.struct(F.split(x, "-")[0].cast("long").alias("start"), F.split(x, "-")[1].cast("long").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return without(out, ["hit_spans", "hit_items"]).withColumns({
        "hit_spans": F.when(F.col("__spans").isNull(), none).otherwise(spans),
        "hit_items": F.when(F.col("__items").isNull(), F.array().cast("array<string>")).otherwise(F.split("__items", "\x00")),
    }).drop("__spans", "__items")


def digest(found: DataFrame) -> DataFrame:
    """The counts of find_contamination()'s rows."""
    return found.withColumns({
        "n_hit": F.aggregate("hit_spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]),
        "n_items": F.size("hit_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("hit_items", ","), 256),
        "contaminated": F.size("hit_spans") > 0,
    })


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of df that no benchmark item hits, with df's columns; for parameters see find_contamination()."""
    renamed, column, own = neutral(df, text)
    return find_contamination(renamed, benchmark, column, **how).where(F.size("hit_spans") == 0).select(*own)
