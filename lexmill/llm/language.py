"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines inside it.

Features are square-rooted relative frequencies of hashed byte pairs and triples of the whole text (A-Z lower-cased), so
every text is a unit vector.  The classifier is fitted on a bounded number of labelled rows for each language
(`sample`); prediction is a scan with a small broadcast model.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import add_columns, lean
from ._words import raw_blocks

WIDTH = 4096
#: Labelled rows of each language that the classifier is fitted on, at most.
SAMPLE = 400
UNDETERMINED = "und"
#: Families of languages that are easily mixed up; a language that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "nb": "germanic", "nn": "germanic", "is": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "gl": "romance", "ro": "romance", "oc": "romance",
    "ru": "slavic", "uk": "slavic", "be": "slavic", "bg": "slavic", "sr": "slavic", "mk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "sl": "slavic", "hr": "slavic", "bs": "slavic",
    "tr": "turkic", "az": "turkic", "kk": "turkic", "ky": "turkic", "uz": "turkic", "tt": "turkic",
}

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = re.compile(r"[^\W\d_]")


def features(column: pa.Array):
    """(first row, matrix): a unit vector, or zeros, for each text of a block."""
    for first, rows, data, offsets in raw_blocks(column, 1 << 19, 1 << 10):
        b = _LOWER[data]
        out = np.zeros((rows, WIDTH), np.float32)
        row = np.repeat(np.arange(rows), np.diff(offsets))
        for n in (2, 3):
            if len(b) < n:
                continue
            h = np.full(len(b) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + b[k : k + len(h)]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
            whole = row[: len(h)] == row[n - 1 :]
            out += np.bincount(row[: len(h)][whole] * WIDTH + h[whole], minlength=rows * WIDTH).reshape(rows, WIDTH)
        total = out.sum(axis=1, keepdims=True)
        yield first, np.sqrt(out / np.maximum(total, 1))


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, c: float = 50.0) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent on hinge loss; the last weight is the bias."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)]).astype(np.float64)
    alpha, w, norms = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w)) / norms[i]
            new = min(max(alpha[i] + step, 0.0), share[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


def _pairwise(x: np.ndarray, labels: np.ndarray, names: list[str]) -> dict[tuple[str, str], np.ndarray]:
    out = {}
    for a, b in combinations(names, 2):
        mine = (labels == a) | (labels == b)
        out[a, b] = _svm(x[mine], np.where(labels[mine] == a, 1.0, -1.0))
    return out


def _vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the name with the most votes (ties: larger summed margins, then the earlier name) and its least margin."""
    votes, margins, least = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.full((len(x), len(names)), 10.0)
    for (a, b), w in machines.items():
        m = x @ w[:-1] + 0.3 * w[-1]
        for name, sign in ((a, m), (b, -m)):
            k = names.index(name)
            votes[:, k] += sign >= 0 if name == a else sign > 0
            margins[:, k] += np.tanh(sign)
            least[:, k] = np.minimum(least[:, k], sign)
    best = np.argmax(votes + margins / (4 * max(1, len(names))), axis=1)
    return best, least[np.arange(len(x)), best]


class Model:
    def __init__(self, x: np.ndarray, labels: list[str], families: dict[str, str]):
        labels = np.array(labels, object)
        self.languages: dict[str, list[str]] = {}
        for name in sorted(set(labels)):
            self.languages.setdefault(families.get(name, name), []).append(name)
        self.families = sorted(self.languages)
        own = np.array([families.get(name, name) for name in labels], object)
        self.between = _pairwise(x, own, self.families)
        self.within = {f: _pairwise(x[own == f], labels[own == f], names) for f, names in self.languages.items()}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        family, margin = _vote(x, self.families, self.between)
        sure = 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            mine = np.flatnonzero(family == k)
            if len(mine):
                best, margin = _vote(x[mine], self.languages[f], self.within[f])
                out[mine] = [self.languages[f][i] for i in best]
                sure[mine] *= 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
        return out.tolist(), sure


def _vectors(batches):
    for batch in batches:
        for first, x in features(batch.column(0)):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(x)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["lang", "x"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = SAMPLE, families: dict[str, str] | None = None) -> Model:
    """A model from rows with a text and a language.

    Of each language at most about 1.5 * `sample` rows are used, chosen by a hash of id and text; they are the only
    vectors that reach the driver (8 KB each).  Rows with a null text or language aren't used.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(id).cast("string"), F.length(text)).alias("h"))
    found = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not found:
        return Model(np.zeros((0, WIDTH), np.float32), [], families or FAMILIES)
    scale = 1 << 30
    bound = F.lit(0)
    for name, n in found.items():
        bound = F.when(F.col("l") == name, F.lit(min(scale, int(scale * 1.2 * sample / n) + 1))).otherwise(bound)
    chosen = rows.where(F.pmod("h", F.lit(scale)) < bound).select("t", "l").mapInArrow(lean(_vectors), "lang string, x binary").toArrow()
    chosen = chosen.sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(chosen.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return Model(x, chosen.column("lang").to_pylist(), families or FAMILIES)


def _predictor(shared):
    def make():
        model = shared.value

        def run(column: pa.Array) -> list[pa.Array]:
            names, scores = [], []
            for first, x in features(column):
                got, sure = model.predict(x)
                for k in range(len(x)):
                    text = column[first + k].as_py()
                    if text is None or not _LETTER.search(text):
                        got[k], sure[k] = UNDETERMINED, 0.0
                names += got
                scores += np.clip(sure, 0, 1).tolist()
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return run

    return make


def identify(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with lang_pred (string) and score (double from 0 to 1).

    A null text and a text without a letter are `und` with score 0; a model without languages says `und` to all.
    Columns named like the added ones are replaced, all others stay (the text only if keep_text).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return add_columns(df, [text], "lang_pred string, score double", _predictor(shared), drop=() if keep_text else (text,))


def held_out(id):
    """Rows that a query's model doesn't learn from: crc32 of the id as text is 2 modulo 4; never if the id is null."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
