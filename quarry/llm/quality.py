"""Quality by a generalised additive model: boosted lookup tables of single features and of pairs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.toxicity import held_out, train_rows

FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "digits", "upper", "blanks", "common_marks", "odd_marks",
    "exclaims", "beyond_ascii", "letter_entropy", "repeated_lines", "line_length", "sentence_length", "marked_words", "upper_words", "repeated_pairs",
)
#: Fixed byte classes.
DIGITS, UPPER, LOWER, BLANKS, COMMON = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b" \t\n\r", b".,;:'\"()-?"


def _mask(of: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(of)] = True
    return m


_CLASSES = {k: _mask(v) for k, v in (("digits", DIGITS), ("upper", UPPER), ("lower", LOWER), ("blanks", BLANKS), ("common", COMMON), ("bang", b"!"))}
_BEYOND = np.arange(256) >= 128
_ODD = ~(_BEYOND | _CLASSES["digits"] | _CLASSES["upper"] | _CLASSES["lower"] | _CLASSES["blanks"] | _CLASSES["common"] | _CLASSES["bang"])
_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def features(text: str | None) -> list[float]:
    """Shape of a whole text in plain numbers; all zero for a null or empty one."""
    data = (text or "").encode()
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n, w = float(len(data)), len(words)
    sizes = list(map(len, words))
    held = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = np.r_[h[97:123] + h[65:91], h[128:].sum()]
    p = letters[letters > 0] / max(1.0, letters.sum())
    ends = h[ord(".")] + h[ord("?")] + h[ord("!")]
    pairs = len(set(zip(words, words[1:], strict=False))) if w > 1 else 1
    share = lambda m: float(h[m].sum()) / n
    marked = sum(1 for x in words if x[-1] in _EDGE)
    return [
        math.log1p(w), sum(sizes) / w, sum(1 for s in sizes if s > 12) / w, len(held) / w, max(held.values()) / w, share(_CLASSES["digits"]), share(_CLASSES["upper"]),
        share(_CLASSES["blanks"]), share(_CLASSES["common"]), share(_ODD), share(_CLASSES["bang"]), share(_BEYOND), float(-(p * np.log(p)).sum()) if len(p) else 0.0,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), math.log1p(w / (ends + 1)), marked / w, sum(map(str.isupper, words)) / w, 1 - pairs / max(1, w - 1),
    ]


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled rows that the model is fitted on; it does not bound what is scored."""

    train_rows: int = 20_000
    bins: int = 64
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 200
    pair_rounds: int = 60
    rate: float = 0.1
    leaves: int = 4
    least: int = 20


@dataclass
class Tables:
    """The model: cut points and a table of additions for each feature, and for some pairs a coarser square table."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cut, table) in enumerate(zip(self.cuts, self.single, strict=True)):
            total += table[np.searchsorted(cut, x[:, k], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins: the best split again and again until it has `leaves` leaves."""
    cg, ch, cn = (np.r_[0.0, np.cumsum(v)] for v in (g, h, n))
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            s = np.arange(a + 1, b)
            s = s[(cn[s] - cn[a] >= least) & (cn[b] - cn[s] >= least)]
            if len(s):
                gain = value(a, s) + value(s, b) - value(a, b)
                if gain[i := int(gain.argmax())] > best[0]:
                    best = (gain[i], k, int(s[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _square(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, np.ndarray]:
    """The gain and steps of the best cut into four quarters of a pair's square table."""
    c = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h, n)]
    best, steps = 0.0, np.zeros(g.shape)
    size = g.shape
    for a in range(1, size[0]):
        for b in range(1, size[1]):
            box = [(0, a, 0, b), (0, a, b, size[1]), (a, size[0], 0, b), (a, size[0], b, size[1])]
            s = [[x[r1, k1] - x[r0, k1] - x[r1, k0] + x[r0, k0] for x in c] for r0, r1, k0, k1 in box]
            if min(v[2] for v in s) < least:
                continue
            gain = sum(v[0] ** 2 / (v[1] + 1) for v in s) - c[0][-1, -1] ** 2 / (c[1][-1, -1] + 1)
            if gain > best:
                best, steps = gain, np.zeros(size)
                for (r0, r1, k0, k1), v in zip(box, s, strict=True):
                    steps[r0:r1, k0:k1] = -v[0] / (v[1] + 1)
    return best, steps


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Tables:
    """Cyclic boosting: every round gives each feature one shallow tree; then the pairs that explain most of what is left."""
    t = Tables()
    if not len(y) or y.min() == y.max():
        t.base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return t
    t.base = math.log(y.mean() / (1 - y.mean()))
    t.cuts, t.coarse = ([_cuts(x[:, k], b) for k in range(x.shape[1])] for b in (s.bins, s.pair_bins))
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(t.cuts)]
    t.single = [np.zeros(len(c) + 1) for c in t.cuts]
    total = np.full(len(y), t.base)
    many = [np.bincount(b, minlength=len(v)) for b, v in zip(bins, t.single, strict=True)]

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(s.rounds):
        for k, b in enumerate(bins):
            g, h = left()
            step = s.rate * _tree(np.bincount(b, g, len(t.single[k])), np.bincount(b, h, len(t.single[k])), many[k], s.leaves, s.least)
            t.single[k] += step
            total += step[b]
    wide = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(t.coarse)]

    def table(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        a, b = len(t.coarse[i]) + 1, len(t.coarse[j]) + 1
        return np.bincount(wide[i] * b + wide[j], v, a * b).reshape(a, b)

    g, h = left()
    every = [(i, j) for i in range(len(wide)) for j in range(i)]
    gains = sorted(((_square(table(i, j, g), table(i, j, h), table(i, j, None), s.least)[0], i, j) for i, j in every), reverse=True)
    t.pairs = [(i, j, np.zeros((len(t.coarse[i]) + 1, len(t.coarse[j]) + 1))) for gain, i, j in gains[: s.pairs] if gain > 0]
    for _ in range(s.pair_rounds):
        for i, j, v in t.pairs:
            g, h = left()
            step = s.rate * _square(table(i, j, g), table(i, j, h), table(i, j, None), s.least)[1]
            v += step
            total += step[wide[i], wide[j]]
    return t


def featured(d: DataFrame, score: Tables | None, threshold: float) -> DataFrame:
    """Of (doc_id, flag, text): with a model (doc_id, held_out, score, predicted), without one the features and the label."""
    sent = d.sparkSession.sparkContext.broadcast(score)

    def rows(b: pa.RecordBatch) -> np.ndarray:
        return np.array([features(t.as_py()) for t in b.column(2)], float).reshape(-1, len(FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sent.value.score(rows(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows(b).tolist(), pa.list_(pa.float64()))], ["y", "x"])

    if score is None:
        return d.mapInArrow(bare, "y int, x array<double>")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text.

    At most settings.train_rows labelled rows outside the held-out fold (crc32 of the id as text) have their features gathered on
    the driver, which fits the tables; every row is then scored by looking up its bins. Nothing but the text enters a score.
    Null and empty texts have all features zero and get the score of that bin. A null id is not held out. With labels of
    one class only the score is constant; repeated rows are scored each.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    train = written(train_rows(docs, labels, "quality", held_out(F.col("k"), folds, fold), settings.train_rows, id_col, text_col), "quality-train")
    seen = featured(train.select("doc_id", "y", "text"), None, threshold).toArrow()
    x = np.array(seen.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(seen.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the order of arrival must not matter
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return featured(d, fit(x[order], y[order], settings), threshold)
