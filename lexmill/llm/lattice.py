"""Language-model scoring with a subword lattice.

The pieces are those of an existing vocabulary file; their unigram probabilities are fitted to the training documents
by expectation maximisation, starting from the file's order of pieces.  A text's probability is the sum over all
segmentations into pieces, found by forward recursion in log space.  A word is U+2581 and its characters, and no piece
spans two words, so the lattice of a text is the chain of its words' lattices and its log probability their sum: the
recursion runs once for each distinct word of the corpus.

Counts and word probabilities come back to the documents without moving a text: the words that occur most (HEAD_WORDS at
most) are broadcast, the others are joined by shuffle.  Both grow with the corpus, the first up to its bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize
from ._words import blocks, signed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words broadcast at most (24 bytes each).
HEAD_WORDS = 500_000
SPACE = "▁"
_FLUSH = 200_000
_VECTOR = 40
_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_CODE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that stand for text, in the file's order, most useful first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rest = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    return [model.id_to_piece(i) for i in sorted(filter(rest, range(model.vocab_size())), key=lambda i: -model.get_score(i))]


def _hash(text: str) -> int:
    h, power = 0, 1
    for c in text:
        h += (ord(c) + 1) * int(_CODE) * power
        power = power * int(_BASE)
    return h & 0xFFFFFFFFFFFFFFFF


def _log_sum(terms: list[float]) -> float:
    most = max(terms, default=-math.inf)
    return most + math.log(sum(math.exp(x - most) for x in terms)) if most > -math.inf else most


class Lattice:
    """Unigram log probabilities (natural) of pieces, of one byte of a character that no piece covers, and of the end."""

    def __init__(self, pieces: list[str], weights: np.ndarray, byte_weight: float, end_weight: float):
        total = weights.sum() + byte_weight + end_weight
        self.pieces = pieces
        self.log = np.log(weights / total)
        self.byte = float(np.log(byte_weight / total / 256))
        self.end = float(np.log(end_weight / total))
        self.longest = max(map(len, pieces), default=1)
        self.index = {p: k for k, p in enumerate(pieces)}
        hashes = np.array([_hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.single = np.array(sorted({ord(p) for p in pieces if len(p) == 1}), np.uint32)

    def _ending(self, text: str, j: int) -> list[tuple[int, int, float]]:
        """Edges that end at j: (start, piece or -1 for bytes, log probability)."""
        found = [(i, k, float(self.log[k])) for i in range(max(0, j - self.longest), j) if (k := self.index.get(text[i:j])) is not None]
        if text[j - 1] not in self.index:
            found.append((j - 1, -1, self.byte * len(text[j - 1].encode())))
        return found

    def word(self, word: str) -> float:
        """Log probability of one word: the plain recursion, for words too long to be worth a matrix."""
        text = SPACE + word
        forward = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            terms = [forward[i] + log for i, _, log in self._ending(text, j)]
            forward[j] = _log_sum(terms)
        return forward[-1]

    def _expect_long(self, text: str, weight: float, uses: np.ndarray) -> float:
        """Adds one long text's expected uses of pieces to `uses`; its expected bytes."""
        size, used_bytes = len(text), 0.0
        forward, backward = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
        for j in range(1, size + 1):
            forward[j] = _log_sum([forward[i] + log for i, _, log in self._ending(text, j)])
        if forward[-1] == -math.inf:
            return 0.0
        # All edges out of a place have been met when it is reached from the end.
        after: dict[int, list[float]] = {}
        for j in range(size, 0, -1):
            if j < size:
                backward[j] = _log_sum(after.pop(j, []))
            if backward[j] == -math.inf:
                continue
            for i, k, log in self._ending(text, j):
                after.setdefault(i, []).append(log + backward[j])
                p = weight * math.exp(min(0.0, forward[i] + log + backward[j] - forward[-1]))
                if k >= 0:
                    uses[k] += p
                else:
                    used_bytes += p * len(text[j - 1].encode())
        return used_bytes

    def _edges(self, texts: list[str]):
        """Edges of words of one length: (start, end, piece or -1 for bytes, log probability) with an entry for each word."""
        n, size = len(texts), len(texts[0])
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(n, size)
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _BASE)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _INVERSE)])
        sums = np.zeros((size + 1, n), np.uint64)
        np.cumsum((codes.T.astype(np.uint64) + np.uint64(1)) * _CODE * up[:size, None], axis=0, out=sums[1:])
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                h = (sums[j] - sums[i]) * down[i]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                if known.any():
                    piece = self.order[at]
                    yield i, j, np.where(known, piece, -2), np.where(known, self.log[piece], -np.inf)
            c = codes[:, j - 1]
            near = self.single[np.minimum(np.searchsorted(self.single, c), len(self.single) - 1)] if len(self.single) else np.zeros(n, np.uint32)
            strange = near != c
            if strange.any():
                width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                yield j - 1, j, np.where(strange, -1, -2), np.where(strange, self.byte * width, -np.inf)

    def _forward(self, texts: list[str], edges) -> np.ndarray:
        forward = np.full((len(texts[0]) + 1, len(texts)), -np.inf)
        forward[0] = 0
        with np.errstate(invalid="ignore"):
            for i, j, _, log in edges:
                forward[j] = np.logaddexp(forward[j], forward[i] + log)
        return forward

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, summed over all segmentations."""
        out = np.empty(len(words))
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, ks in by_size.items():
            if size > _VECTOR:
                out[ks] = [self.word(words[k]) for k in ks]
            else:
                texts = [SPACE + words[k] for k in ks]
                out[ks] = self._forward(texts, self._edges(texts))[-1]
        return out

    def expect(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece and of bytes in all segmentations of the words."""
        uses, used_bytes = np.zeros(len(self.pieces)), 0.0
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, ks in by_size.items():
            texts = [SPACE + words[k] for k in ks]
            weight = np.asarray(counts[ks], float)
            if size > _VECTOR:
                used_bytes += sum(self._expect_long(t, float(c), uses) for t, c in zip(texts, weight))
                continue
            edges = list(self._edges(texts))
            forward = self._forward(texts, edges)
            backward = np.full_like(forward, -np.inf)
            backward[-1] = 0
            with np.errstate(invalid="ignore"):
                for i, j, _, log in reversed(sorted(edges, key=lambda e: e[1])):
                    backward[i] = np.logaddexp(backward[i], log + backward[j])
                for i, j, piece, log in edges:
                    p = np.nan_to_num(np.exp(forward[i] + log + backward[j] - forward[-1])) * weight
                    ok = piece >= 0
                    uses += np.bincount(piece[ok], p[ok], len(uses))
                    strange = piece == -1
                    used_bytes += float((p[strange] * np.round(log[strange] / self.byte)).sum())
        return uses, used_bytes


def _tokens(text) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased: what bytes.lower() and bytes.split() do."""
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count in training documents), added up within a task as far as memory goes; other words have 0."""
    kinds = {True: Counter(), False: Counter()}

    def flush():
        words = list(kinds[True].keys() | kinds[False].keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([kinds[False][w] for w in words], pa.int64())], names=["word", "c"])
        for c in kinds.values():
            c.clear()
        return out

    for batch in batches:
        for held, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            kinds[held].update(_tokens(text))
            if len(kinds[True]) + len(kinds[False]) > _FLUSH:
                yield flush()
    if kinds[True] or kinds[False]:
        yield flush()


def _expectations(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, uses, used_bytes = shared.value, 0, 0.0
        for batch in batches:
            more, b = lattice.expect(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            uses, used_bytes = uses + more, used_bytes + b
        if not isinstance(uses, int):
            k = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, k], pa.int64()), pa.array(np.r_[used_bytes, uses[k]])], names=["piece", "uses"])

    return run


def fit(counts: DataFrame, pieces: list[str], documents: int, rounds: int = 2, prior: float = 0.1) -> Lattice:
    """Piece probabilities from (word, c) of the training documents; what reaches the driver is one row for each piece."""
    spark = counts.sparkSession
    rank = np.arange(len(pieces), dtype=float)
    weights = 1.0 / (rank + 10)
    lattice = Lattice(pieces, weights, weights.sum() * 1e-3, weights.sum() * 1e-3)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(lattice)
        found = counts.where("c > 0").mapInArrow(_expectations(shared), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses, used_bytes = np.full(len(pieces), prior), 256 * prior
        for piece, n in found:
            if piece < 0:
                used_bytes += n
            else:
                uses[piece] += n
        lattice = Lattice(pieces, uses, used_bytes, documents + prior)
        shared.unpersist()
    return lattice


def _probabilities(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            hashes = np.concatenate([b.hashes for b in blocks(words)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), batch.column(1), pa.array(shared.value.words(words.to_pylist()) / np.log(10))], names=["wh", "c", "lp"])

    return run


def _score(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, lp, known = head.value
        for batch in batches:
            n = batch.num_rows
            tokens, n_known, bases, scores = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            rare, ends = [], []
            done = 0
            for block in blocks(batch.column(0)):
                at = slice(block.first, block.first + block.rows)
                tokens[at] += np.diff(block.bounds)
                row = np.repeat(np.arange(block.rows), np.diff(block.bounds))
                where = np.minimum(np.searchsorted(hashes, block.hashes), max(len(hashes) - 1, 0))
                hit = hashes[where] == block.hashes if len(hashes) else np.zeros(len(row), bool)
                for out, values in ((n_known, known), (bases, base), (scores, lp)):
                    out[at] += np.bincount(row[hit], values[where[hit]], block.rows).astype(out.dtype)
                rare.append(block.hashes[~hit])
                ends.append(done + np.cumsum(np.bincount(row[~hit], minlength=block.rows)))
                done += len(rare[-1])
            offsets = np.concatenate([[0], *ends]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(rare)) if rare else np.empty(0, np.int64)))
            keep = range(1, batch.num_columns)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.array(tokens), pa.array(n_known), pa.array(bases), pa.array(scores), lists],
                names=[*[batch.schema.field(k).name for k in keep], "n_tokens", "n_known", "base", "lattice", "rare"],
            )

    return run


def held_out(id, parts: int = 10):
    """Whether a row is kept from training: crc32 of its id as text is a multiple of `parts`; never if the id is null."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(False))


def score(df: DataFrame, text: str = "text", id: str = "doc_id", vocabulary: str = VOCABULARY, head_words: int = HEAD_WORDS, rounds: int = 2) -> DataFrame:
    """Per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words (runs of anything but ASCII white space, A-Z lower-cased) and one end.  base_score sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over tokens; score is the lattice's log10 probability of the words and the end.
    A null, empty or blank text has the end only.  A row with a null id is a training row.  Rows of the same id and text
    get equal results.  Other columns of df aren't carried along.  No rows give no rows; without training rows every
    count is 0 and probabilities rest on the vocabulary's order.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text).cast("string").alias("t"), F.col(id).alias("id"), held_out(F.col(id)).alias("held"))
    counts = rows.select(F.col("held"), F.col("t")).mapInArrow(_count_words, "word string, c long")
    counts = materialize(counts.groupBy("word").agg(F.sum("c").alias("c")))
    training = rows.where("not held").count()
    distinct, occurrences = counts.where("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = occurrences + training, distinct + (training > 0)
    below = n + 0.1 * (v + 1)

    lattice = fit(counts, load_pieces(vocabulary), training, rounds)
    shared = spark.sparkContext.broadcast(lattice)
    table = materialize(counts.mapInArrow(_probabilities(shared), "wh long, c long, lp double"))
    # The least count that leaves at most head_words words; counts of counts are few.
    upto, least = 0, None
    for c, words in table.groupBy("c").count().orderBy(F.desc("c")).limit(100_000).toLocalIterator():
        if upto + words > head_words:
            break
        upto, least = upto + words, c
    head = table.where(F.col("c") >= least).toArrow() if least is not None else table.limit(0).toArrow()
    hashes = np.asarray(head.column("wh").to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(hashes)
    c = head.column("c").to_numpy()[order]
    head = spark.sparkContext.broadcast((hashes[order], np.log10((c + 0.1) / below), head.column("lp").to_numpy()[order], (c > 0).astype(float)))

    # Rows of one id and text share a key; they are told apart by nothing, so each takes the mean of what the key gets.
    keyed = rows.select("t", "id", "held", F.xxhash64(F.col("id").cast("string"), F.col("t")).alias("key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.drop("t").schema.fields)
    scored = materialize(keyed.mapInArrow(_score(head), f"{fields}, n_tokens long, n_known long, base double, lattice double, rare array<long>"))
    logs = F.log10((F.col("c") + 0.1) / F.lit(below))
    tail = table if least is None else table.where(F.col("c") < least)
    rest = scored.select("key", F.explode("rare").alias("wh")).join(tail, "wh").groupBy("key").agg(F.count(F.when(F.col("c") > 0, 1)).alias("k"), F.sum(logs).alias("b"), F.sum("lp").alias("l"))
    twins = scored.groupBy("key").agg(F.count("*").alias("twins"))
    out = scored.drop("rare").join(rest.join(twins, "key"), "key", "left")
    share = lambda name: F.coalesce(F.col(name) / F.col("twins"), F.lit(0.0))
    end = float(np.log10((training + 0.1) / below))
    return out.select(
        F.col("id").alias(id), F.col("held").alias("held_out"), "n_tokens",
        (F.col("n_known") + share("k").cast("long") + F.lit(int(training > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + share("b") + F.lit(end)).alias("base_score"), (F.col("lattice") + share("l") + F.lit(lattice.end / float(np.log(10)))).alias("score"),
    )
