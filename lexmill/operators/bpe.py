"""Byte-level BPE: pre-tokenize and count in Spark, guess merges on the driver and confirm them in Spark, encode distinct pre-tokens at once.

Symbols are byte strings.  Base ids are the 256 bytes in the order of their printable stand-ins, as byte-level tokenizers
number them; a merge takes the most frequent pair, of equal ones that with the smallest ids.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType

from ..functions.rows import by_slices
from ..functions.text import strip
from .tables import cut_lineage

# The two pre-tokenizer definitions.
DIGITS = r"\p{N}{1,3}"
CJK = r"[一-龥぀-ゟ゠-ヿ]+"
CATEGORIES = (
    r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~][A-Za-z]+"
    r"|[^\r\n\p{L}\p{P}\p{S}]?[\p{L}\p{M}]+"
    r"| ?[\p{P}\p{S}]+[\r\n]*"
    r"|\s*[\r\n]+"
    r"|\s+(?!\S)"
    r"|\s+"
)
CASED = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n/]*"
    r"|\s*[\r\n]+"
    r"|\s+(?!\S)"
    r"|\s+"
)


def _isolate(pieces: list[str], pattern) -> list[str]:
    out = []
    for piece in pieces:
        at = 0
        for m in pattern.finditer(piece):
            out += [piece[at : m.start()], m[0]]
            at = m.end()
        out.append(piece[at:])
    return [x for x in out if x]


def sequential(text: str) -> list[str]:
    """Digits, then CJK runs, then categories, each inside the pieces that the last split left."""
    pieces = [text]
    for pattern in (DIGITS, CJK, CATEGORIES):
        pieces = _isolate(pieces, regex.compile(pattern))
    return pieces


_sequential = by_slices(lambda texts: [[] if t is None else sequential(t) for t in texts.to_pylist()], ArrayType(StringType()))


def pretokens(text: Column, style: str) -> Column:
    """cased: one case-aware pattern whose matches are the pre-tokens, inside the JVM; sequential: three nested splits, Arrow."""
    if style == "cased":
        return F.regexp_extract_all(text, F.lit("(?U)" + CASED), F.lit(0))
    if style == "sequential":
        return _sequential(text)
    raise ValueError(f"no pre-tokenizer is called {style!r}")


def pretoken_counts(df: DataFrame, text: str, style: str, *by: str) -> DataFrame:
    return df.select(*by, F.explode(pretokens(F.col(text), style)).alias("pretoken")).groupBy(*by, "pretoken").agg(F.count("*").alias("n"))


def lines_with_ends(df: DataFrame, text: str) -> DataFrame:
    """One row for each line that isn't blank, with its line feed if it has one: the training unit of the first design."""
    parts = F.split(F.col(text), "\n")
    return df.select(F.posexplode(parts).alias("__k", "line"), F.size(parts).alias("__n")).where(strip(F.col("line")) != "").select(F.when(F.col("__k") < F.col("__n") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("line"))


def byte_alphabet() -> dict[int, str]:
    """Each byte's printable stand-in: itself where printable, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@dataclass
class Model:
    """merges in order; vocab: token bytes by id, base bytes first."""

    merges: list[tuple[bytes, bytes]]
    style: str = "cased"
    vocab: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        if not self.vocab:
            stand = byte_alphabet()
            self.vocab = [bytes([b]) for b in sorted(stand, key=lambda b: ord(stand[b]))] + [a + b for a, b in self.merges]
        self.ids = {t: k for k, t in reversed(list(enumerate(self.vocab)))}
        self.ranks = {m: k for k, m in reversed(list(enumerate(self.merges)))}

    def encode_piece(self, piece: str) -> list[int]:
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.merges)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.merges):
                break
            a, b = self.merges[rank]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.ids[p] for p in parts]

    def pieces(self, text: str) -> list[str]:
        return sequential(text) if self.style == "sequential" else regex.findall(CASED, text)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", "replace")

    def boundaries(self, text: str) -> set[int]:
        """Character offsets where a token ends, but for the last; offsets inside a character don't count."""
        ends, at = set(), 0
        chars, k = {0: 0}, 0
        for n, c in enumerate(text, 1):
            k += len(c.encode())
            chars[k] = n
        for i in self.encode(text)[:-1]:
            at += len(self.vocab[i])
            if at in chars:
                ends.add(chars[at])
        return ends

    def variant(self, size: int) -> Model:
        """The first size - 256 merges of this model."""
        if not 256 <= size <= len(self.vocab):
            raise ValueError(f"a variant has from 256 to {len(self.vocab)} tokens")
        return Model(self.merges[: size - 256], self.style)

    def inspect(self, text: str) -> dict:
        ids = self.encode(text)
        return {"ids": ids, "tokens": [self.vocab[i].decode("utf-8", "replace") for i in ids], "decoded": self.decode(ids)}

    def to_json(self) -> str:
        s = byte_alphabet()
        name = lambda t: "".join(s[b] for b in t)
        return json.dumps({"style": self.style, "model": {"type": "BPE", "vocab": {name(t): k for k, t in enumerate(self.vocab)}, "merges": [[name(a), name(b)] for a, b in self.merges]}}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Model:
        data, back = json.loads(text), {c: b for b, c in byte_alphabet().items()}
        to = lambda t: bytes(back[c] for c in t)
        return cls([(to(a), to(b)) for a, b in data["model"]["merges"]], data["style"])


def merge_loop(counts: dict[str, int], size: int, min_frequency: int = 2, max_token_length: int = 64, style: str = "cased") -> Model:
    """Train from counts of distinct pre-tokens: an index from pairs to the words that hold them, and a lazily corrected heap."""
    base = Model([], style)
    vocab, ids = list(base.vocab), dict(base.ids)
    texts = [w for w in sorted(counts) if w]
    split = [[ids[bytes([b])] for b in w.encode()] for w in texts]
    weight = [counts[w] for w in texts]
    totals: Counter = Counter()
    # A word may be listed twice, or no longer hold the pair: meeting it then changes nothing.
    holders: dict[tuple[int, int], array] = defaultdict(lambda: array("i"))
    for k, parts in enumerate(split):
        for pair in zip(parts, parts[1:]):
            totals[pair] += weight[k]
            holders[pair].append(k)
    heap = [(-n, pair) for pair, n in totals.items()]
    heapq.heapify(heap)
    merges: list[tuple[bytes, bytes]] = []
    while heap and len(vocab) < size:
        n, pair = heapq.heappop(heap)
        if -n != totals.get(pair, 0):
            if totals.get(pair, 0) > 0:
                heapq.heappush(heap, (-totals[pair], pair))
            continue
        if -n < max(min_frequency, 1):
            break
        a, b = pair
        token = vocab[a] + vocab[b]
        if len(token) > max_token_length:
            continue
        merges.append((vocab[a], vocab[b]))
        new = ids.setdefault(token, len(vocab))
        if new == len(vocab):
            vocab.append(token)
        changed = set()
        for k in holders.pop(pair):
            parts, out, at = split[k], [], 0
            for old in zip(parts, parts[1:]):
                totals[old] -= weight[k]
                changed.add(old)
            while at < len(parts):
                if at + 1 < len(parts) and parts[at] == a and parts[at + 1] == b:
                    out.append(new)
                    at += 2
                else:
                    out.append(parts[at])
                    at += 1
            split[k] = out
            for now in zip(out, out[1:]):
                totals[now] += weight[k]
                if new in now:
                    holders[now].append(k)
                changed.add(now)
        for p in changed:
            if totals[p] > 0:
                heapq.heappush(heap, (-totals[p], p))
            else:
                totals.pop(p, None)
    return Model(merges, style, vocab)


class Block:
    """Words as one array of symbol ids with links between neighbours; merges are applied to all of them at once.

    data, offsets: the words' bytes and where each begins and ends in them; weights: their counts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None):
        lengths = np.diff(offsets)
        n = int(lengths.sum())
        self.n, self.words, self.weights = n, len(lengths), weights
        ids = np.zeros(256, np.int32)
        for k, token in enumerate(Model([]).vocab):
            ids[token[0]] = k
        # Place n stands for none; symbols below 0 are no symbols.
        self.x = np.append(ids[data[offsets[0] : offsets[-1]]], -1).astype(np.int32)
        self.word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.next, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        some = lengths > 0
        ends = (offsets[1:] - offsets[0])[some]
        self.next[ends - 1] = n
        self.before[ends - lengths[some]] = n

    @classmethod
    def of(cls, words: pa.Array, weights: np.ndarray | None = None) -> Block:
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = words.buffers()[2]
        return cls(np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets if len(offsets) else np.zeros(1, np.int64), weights)

    def _sums(self, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, at, weights)
        return names, sums

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (left << 32 | right) and their counts."""
        i = np.flatnonzero((self.x[: self.n] >= 0) & (self.next[: self.n] < self.n))
        return self._sums(self.x[i].astype(np.int64) << 32 | self.x[self.next[i]], self.weights[self.word[i]])

    def merge(self, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Replaces the pair, from left to right; the pairs whose counts change and by how much (where there are weights)."""
        x, n = self.x, self.n
        i = np.flatnonzero(x[:n] == a)
        j = self.next[i]
        ok = x[j] == b
        i, j = i[ok], j[ok]
        if a == b and len(i):
            k = np.arange(len(i))
            begins = np.r_[True, j[:-1] != i[1:]]
            ok = (k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0
            i, j = i[ok], j[ok]
        l, r = self.before[i], self.next[j]
        left, right = x[l].astype(np.int64), x[r].astype(np.int64)
        # Of two pairs in a row, what lies between them belongs to the second.
        has_right = (right >= 0) & np.r_[r[:-1] != i[1:], np.ones(min(len(i), 1), bool)]
        after = np.r_[np.zeros(min(len(i), 1), bool), r[:-1] == i[1:]]
        x[i], x[j] = new, -2
        self.next[i] = r
        self.before[r] = i
        if self.weights is None or not len(i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, has_left = self.weights[self.word[i]], left >= 0
        now = np.where(after, new, left)
        keys = [left[has_left] << 32 | a, np.full(len(i), a << 32 | b), b << 32 | right[has_right], now[has_left] << 32 | new, new << 32 | right[has_right]]
        return self._sums(np.concatenate(keys), np.concatenate([-w[has_left], -w, -w[has_right], w[has_left], w[has_right]]))


class Totals:
    """Counts of pairs under a lazily corrected heap."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []

    def copy(self) -> Totals:
        out = Totals()
        out.counts, out.heap = dict(self.counts), list(self.heap)
        return out

    def add(self, pairs, changes) -> None:
        for p, d in zip(pairs, changes):
            n = self.counts.get(p, 0) + d
            if n:
                self.counts[p] = n
                heapq.heappush(self.heap, (-n, p))
            else:
                self.counts.pop(p, None)

    def best(self, least: float, allowed) -> int | None:
        """The most frequent pair, of equal ones the smallest, that is allowed; it stays in the heap."""
        while self.heap:
            n, p = self.heap[0]
            if self.counts.get(p, 0) == -n and allowed(p):
                return p if -n >= least else None
            heapq.heappop(self.heap)
        return None


class Learner:
    """merges and vocabulary as they grow."""

    def __init__(self, style: str, size: int, max_token_length: int):
        self.vocab, self.style, self.size, self.longest = list(Model([], style).vocab), style, size, max_token_length
        self.ids = {t: k for k, t in enumerate(self.vocab)}
        self.steps: list[tuple[int, int, int]] = []

    def allowed(self, pair: int) -> bool:
        return len(self.vocab[pair >> 32]) + len(self.vocab[pair & 0xFFFFFFFF]) <= self.longest

    def take(self, pair: int) -> tuple[int, int, int]:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        token = self.vocab[a] + self.vocab[b]
        new = self.ids.setdefault(token, len(self.vocab))
        if new == len(self.vocab):
            self.vocab.append(token)
        self.steps.append((a, b, new))
        return self.steps[-1]

    def copy(self) -> Learner:
        out = Learner(self.style, self.size, self.longest)
        out.vocab, out.ids, out.steps = list(self.vocab), dict(self.ids), list(self.steps)
        return out

    def full(self) -> bool:
        return len(self.vocab) >= self.size

    def model(self) -> Model:
        return Model([(self.vocab[a], self.vocab[b]) for a, b, _ in self.steps], self.style, list(self.vocab))


#: Bytes of words that are merged at once in a task, and merges that are checked in a round at most.
BLOCK_BYTES = 4 << 20
ROUND_MERGES = 500


def _changes(steps: list[tuple[int, int, int]], first: int):
    """Over (pretoken, n): (step, pair, n), the counts of pairs after the first steps, at step -1, and how each later step changes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict[int, int]] = [{} for _ in range(len(steps) - first + 1)]
        for words, weights in blocks(batches):
            block = Block.of(words, weights)
            for a, b, new in steps[:first]:
                block.merge(a, b, new)
            for k, (pairs, n) in enumerate([block.pairs()] if first == 0 else []):
                book(sums[k], pairs, n)
            for k, (a, b, new) in enumerate(steps[first:], 1):
                book(sums[k], *block.merge(a, b, new))
        for k, found in enumerate(sums):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k + first - 1, np.int32)), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["step", "pair", "n"])

    def book(sums, pairs, n):
        for p, d in zip(pairs.tolist(), n.tolist()):
            sums[p] = sums.get(p, 0) + d

    def blocks(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(0).nbytes
            if size >= BLOCK_BYTES:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)

    def joined(held):
        whole = pa.Table.from_batches(held).combine_chunks()
        return whole.column(0).chunk(0) if whole.num_rows else pa.array([], pa.string()), whole.column(1).to_numpy()

    return run


def train(df: DataFrame, text: str, size: int, style: str = "cased", min_frequency: int = 2, max_token_length: int = 64, strict: bool = False, most_pretokens: int = 200_000) -> Model:
    """A model from the texts of df; the merges are those of merge_loop().

    The driver holds the most_pretokens most frequent pre-tokens at most.  If there are no more, it merges them itself.
    Otherwise it guesses the next merges from those it has; tasks apply the guesses to all pre-tokens and report how each
    one changes the pairs' counts, and the driver takes what the whole counts confirm.  At the first wrong guess it takes
    the right pair and guesses on from the whole counts.
    """
    counted = cut_lineage(pretoken_counts(df, text, style))
    # Buckets of counts, the highest first: as many as the driver may hold.
    buckets = counted.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*").alias("words")).orderBy(F.desc("k")).collect()
    known, held_words, lowest = sum(r.words for r in buckets), 0, None
    for r in buckets:
        held_words += r.words
        if held_words > most_pretokens:
            break
        lowest = r.k
    top = counted.where(F.floor(F.log2("n") * 8) >= lowest) if lowest is not None else counted.limit(most_pretokens)
    top = top.select("pretoken", "n").toArrow().combine_chunks()
    words = top.column(0).chunk(0) if top.num_rows else pa.array([], pa.string())
    weights = top.column(1).to_numpy()
    least, learner, totals = max(min_frequency, 1), Learner(style, size, max_token_length), None
    while True:
        guess, block = learner.copy(), Block.of(words, weights)
        for step in learner.steps:
            block.merge(*step)
        if totals is None:
            likely = Totals()
            likely.add(*(x.tolist() for x in block.pairs()))
        else:
            likely = totals.copy()
        held = dict(zip(*(x.tolist() for x in block.pairs()))) if totals is not None else {}
        while not guess.full() and len(guess.steps) - len(learner.steps) < (ROUND_MERGES if known > most_pretokens else size):
            pair = likely.best(least, guess.allowed)
            if pair is None:
                break
            scale = likely.counts[pair] / held[pair] if held.get(pair, 0) > 0 else 1.0
            pairs, changes = (x.tolist() for x in block.merge(*guess.take(pair)))
            for p, d in zip(pairs, changes):
                held[p] = held.get(p, 0) + d
            likely.add(pairs, [round(d * scale) for d in changes] if totals is not None else changes)
            likely.counts.pop(pair, None)
        if known <= most_pretokens:
            learner = guess
            break
        first = len(learner.steps)
        found = counted.mapInArrow(_changes(guess.steps, first), "step int, pair long, n long").groupBy("step", "pair").agg(F.sum("n").alias("n")).toArrow()
        by_step: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for k, p, n in zip(*(found.column(c).to_pylist() for c in range(3))):
            by_step[k][0].append(p)
            by_step[k][1].append(n)
        if totals is None:
            totals = Totals()
            totals.add(*by_step[-1])
        right = None
        for k in range(first, len(guess.steps) + 1):
            right = None if learner.full() else totals.best(least, learner.allowed)
            if right is None or k == len(guess.steps) or right != (guess.steps[k][0] << 32 | guess.steps[k][1]):
                break
            learner.take(right)
            totals.add(*by_step[k])
        if right is None:
            break
    model = learner.model()
    if strict and len(model.vocab) < size:
        raise ValueError(f"only {len(model.vocab)} tokens could be learned")
    return model


def encode_words(model: Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each word has; as encode_piece() gives them."""
    block = Block.of(words)
    for a, b in model.merges:
        block.merge(model.ids[a], model.ids[b], model.ids[a + b])
    at = np.flatnonzero(block.x[: block.n] >= 0)
    ids, sizes = block.x[at], np.bincount(block.word[at], minlength=block.words)
    # A token that two merges make can form a pair of lower rank after its turn; such words are encoded one by one.
    inner = at[block.next[at] < block.n]
    merges = np.array([model.ids[a] << 32 | model.ids[b] for a, b in model.merges], np.int64)
    late = np.unique(block.word[inner[np.isin(block.x[inner].astype(np.int64) << 32 | block.x[block.next[inner]], merges)]])
    if len(late):
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in late.tolist():
            parts[k] = np.array(model.encode_piece(words[k].as_py()), np.int32)
        ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    return ids, sizes


def encode_pretokens(df: DataFrame, model: Model, pretoken: str = "pretoken") -> DataFrame:
    """df with ids (array<int>) of each pre-token; meant for distinct ones."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def ids(pieces: pa.Array) -> pa.Array:
        found, sizes = encode_words(shared.value, pieces)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(found, pa.int32()))

    return df.withColumn("ids", by_slices(ids, ArrayType(IntegerType()))(pretoken))


def token_lengths(df: DataFrame, model: Model, id: str, text: str) -> DataFrame:
    """(id, tokens): a text's number of tokens.  A worker encodes the distinct pre-tokens of some texts at once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def tokens(texts: pa.Array) -> pa.Array:
        pieces = texts.flatten().dictionary_encode()
        _, sizes = encode_words(shared.value, pieces.dictionary)
        upto = np.r_[0, np.cumsum(sizes[pieces.indices.to_numpy()])]
        counts = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
        ends = np.cumsum(counts)
        return pa.array(upto[ends] - upto[ends - counts], pa.int64())

    return df.select(id, by_slices(tokens, LongType())(pretokens(F.col(text), model.style)).alias("tokens"))


def round_trip(df: DataFrame, model: Model, text: str) -> Column:
    """Whether decoding gives a text back; the distinct pre-tokens of some texts are encoded and decoded at once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def same(texts: pa.Array) -> list[bool]:
        m, values = shared.value, texts.to_pylist()
        pieces = [[] if t is None else m.pieces(t) for t in values]
        known = list({p for x in pieces for p in x})
        ids, sizes = encode_words(m, pa.array(known, pa.string()))
        tokens, back, at = [m.vocab[i] for i in ids.tolist()], {}, 0
        for p, n in zip(known, sizes.tolist()):
            back[p] = b"".join(tokens[at : at + n])
            at += n
        return [t is None or b"".join([back[p] for p in x]).decode("utf-8", "replace") == t for t, x in zip(values, pieces)]

    return by_slices(same, BooleanType())(text)


def byte_pairs(df: DataFrame, text: str) -> DataFrame:
    """(left, right, n): adjacent bytes inside runs of non-blank characters, as hexadecimal; the first step of training."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x20]+"), F.lit(0)))
    words = df.select(run.alias("w")).groupBy("w").agg(F.count("*").alias("n")).select(F.hex(F.encode("w", "UTF-8")).alias("h"), "n").where(F.length("h") > 2)
    at = words.select("h", "n", F.explode(F.sequence(F.lit(1), F.length("h") - 3, F.lit(2))).alias("i"))
    return at.groupBy(F.substring("h", F.col("i"), F.lit(2)).alias("left"), F.substring("h", F.col("i") + 2, F.lit(2)).alias("right")).agg(F.sum("n").alias("n"))


def experiments(shares=(0.0, 0.1, 0.2, 0.3), styles=("sequential", "cased"), sizes=(32768, 40960, 50000)) -> list[dict]:
    """The matrix of parents (share by style) and their nested sizes."""
    return [{"id": f"bilingual-{s}-supplement{round(100 * r):02d}-{v}", "parent": f"bilingual-{s}-supplement{round(100 * r):02d}", "style": s, "share": r, "vocab_size": v} for r in shares for s in styles for v in sizes]
