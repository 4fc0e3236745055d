"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import union_roots, written
from quarry.llm.jaccard import shingles

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that stand for words not seen in training.
BEGINNINGS = (5, 4)
#: Words a worker remembers, tokens counted before they are passed on, longest text whose tokens are listed at once.
REMEMBERED, FLUSH, AT_ONCE = 1 << 19, 200_000, 1 << 22
#: Numbers of a training text's sketch, of a band of it, and the odd factors that mix its hashes.
SKETCH, BAND = 32, 4
MIXERS = np.random.default_rng(0).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled rows that the model is fitted on; nothing bounds what is scored.

    A word is learned if at least least_documents training documents hold it and its log-odds are least_z standard errors from
    0; vocabulary keeps the most certain words (None: all; certainty already leaves few).
    """

    train_rows: int = 20_000
    least_documents: int = 5
    vocabulary: int | None = None
    prior: float = 200.0
    flat: float = 0.5
    least_z: float = 3.5
    least_odds: float = 1.0
    drift: float = 0.25
    most: float = 8.0
    significant: float = 0.05


def lowered(text: str | None) -> str:
    """Lower case of the same length, so that offsets hold."""
    low = (text or "").lower()
    if len(low) != len(text or ""):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


class Odds(dict):
    """Word -> log-odds; words without a score of their own take that of their longest known beginning, else the drift."""

    def __init__(self, scores: dict[str, float], drift: float):
        super().__init__()
        self.scores, self.drift = scores, -drift

    def __missing__(self, word: str) -> float:
        s = self.scores.get(word)
        for b in beginnings(word) if s is None else ():
            s = self.scores.get(b)
            if s is not None:
                break
        s = self.drift if s is None else s
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = s
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, score): all maximal scoring runs of tokens, by one scan (Ruzzo and Tompa).

    Only positive tokens can open or lengthen a run, so the scan visits those and takes the sums between them from a running
    total. Each candidate keeps a pointer to the nearest earlier one whose total before it is smaller.
    """
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    held: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, earlier smaller
    for i, after in zip(at.tolist(), total[at].tolist(), strict=True):
        first, end, before = i, i + 1, after - float(scores[i])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                held.append((first, end, before, after, j))
                break
            first, before = held[j][0], held[j][2]
            del held[j:]
    return [(a, e, r - b) for a, e, b, r, _ in held]


@dataclass
class Model:
    scores: dict[str, float]
    drift: float
    decay: float  # lambda of the extreme-value distribution
    scale: float  # its K
    significant: float
    slope: float = 1.0
    base: float = 0.0

    def token_scores(self, odds: Odds, low: str) -> np.ndarray:
        if len(low) <= AT_ONCE:
            return np.array(list(map(odds.__getitem__, TOKEN.findall(low))), float)
        return np.fromiter((odds[m.group()] for m in TOKEN.finditer(low)), float)

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(first token, end, score, expected number of such runs by chance) of every significant run."""
        if not len(scores) or scores.max() <= 0:
            return []
        size = math.log(self.scale * len(scores))
        out = [(a, e, s, math.exp(min(50.0, size - self.decay * s))) for a, e, s in segments(scores)]
        return [x for x in out if x[3] <= self.significant]

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        """The runs' surprise, summed: minus the log of each one's expected number."""
        return sum(-math.log(max(x[3], 1e-300)) for x in found)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * math.log1p(evidence)))))


def counted(rows: DataFrame) -> DataFrame:
    """(token, n0, n1): clean and toxic documents that hold each word or word beginning; counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([h[x] for x in names], pa.int64()) for h in held)], ["token", "n0", "n1"])
            for h in held:
                h.clear()
            return out

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = set(TOKEN.findall(lowered(text.as_py())))
                held[y].update(words | {x for w in words for x in beginnings(w)})
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield flush()
        yield flush()

    return rows.select("text", "y").mapInArrow(run, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train_rows(docs: DataFrame, labels: DataFrame, label: str, out: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows in training folds, the first by a hash of the id.

    The chosen ids and labels are bounded by `most`, so they may be broadcast; texts are never gathered in one place. Of rows
    that share an id the least text stands for all, so that there are never more than `most` rows.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = y.filter(~out & F.col("y").isin(0, 1)).orderBy(F.xxhash64(F.lit(5), "k"), "k").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit(train: DataFrame, s: Settings) -> Model:
    """Log-odds with a Dirichlet prior from four fifths of the training rows, calibration from the rest."""
    learn = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) != 0
    n = {r["y"]: r["n"] for r in train.filter(learn).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    model = Model({}, s.drift, 1.0, 1.0, s.significant, 1.0, -30.0 if n0 + n1 == 0 else math.log((n1 + 0.5) / (n0 + 0.5)) - 3)
    if not n0 or not n1:
        return model
    c = written(counted(train.filter(learn)), "toxic-counts")
    sums = c.filter(~F.col("token").endswith("*")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    m0, m1 = float(sums["n0"] or 0), float(sums["n1"] or 0)
    if not m0 or not m1:
        return model
    # the Dirichlet prior is each word's rate over both classes, all of it worth s.prior words; counts are of documents that hold
    # the word, so long texts and repeated words weigh no more. Errors are those of counts with s.flat more, as for few ones
    a = s.prior * (F.col("n0") + F.col("n1")) / (m0 + m1)
    odds = lambda x, m: F.log((F.col(x) + a) / (m + s.prior - F.col(x) - a))
    c = c.filter(F.col("n0") + F.col("n1") >= s.least_documents)
    c = c.withColumn("d", odds("n1", m1) - odds("n0", m0)).withColumn("z", F.col("d") / F.sqrt(1 / (F.col("n1") + a + s.flat) + 1 / (F.col("n0") + a + s.flat)))
    c = c.filter((F.abs("z") >= s.least_z) & ((F.col("d") >= s.least_odds) | (F.col("d") < 0)))
    c = c.orderBy(F.abs("z").desc(), "token")
    top = (c if s.vocabulary is None else c.limit(s.vocabulary)).select("token", "d", "n0").collect()
    model.scores = {r["token"]: max(-1.0, min(s.most, r["d"])) for r in top}
    # lambda: the root of the clean tokens' mean of exp(lambda * score) = 1
    up = [(x, (r["n0"] + 0.5) / m0) for r in top if (x := model.scores[r["token"]]) > 0 and not r["token"].endswith("*")]
    if up:
        lo, hi, other = 1e-3, 20.0, 1 - sum(p for _, p in up)
        for _ in range(60):
            mid = (lo + hi) / 2
            mean = sum(p * math.exp(min(600.0, mid * x)) for x, p in up) + other * math.exp(-mid * s.drift)
            lo, hi = (mid, hi) if mean < 1 else (lo, mid)
        model.decay = max(0.05, min(2.0, lo))
    rest = train.filter(~learn).select("doc_id", "text", "y")
    # K: runs per token in clean documents of the rest, at the least score that any of them has
    clean = measured(rest, model).filter(F.col("y") == 0).agg(F.sum("n").alias("m"), F.sum("runs").alias("runs"), F.min("least").alias("least")).first()
    least = clean["least"] if clean["least"] is not None else 1.0
    model.scale = min(1.0, ((clean["runs"] or 0) + 1) / ((clean["m"] or 0) + 1) * math.exp(model.decay * least))
    seen = measured(rest, model).select("evidence", "y").collect()
    x, y = np.log1p([r[0] for r in seen]), np.array([r[1] for r in seen], float)
    if 0 < y.sum() < len(y):
        w = np.array([math.log(y.mean() / (1 - y.mean())), 1.0])
        for _ in range(50):  # logistic regression on one value, with a little ridge
            p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
            g = np.array([(p - y).sum(), ((p - y) * x).sum()]) + 0.1 * (w - [0, 1])
            v = p * (1 - p)
            h = np.array([[v.sum() + 0.1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]])
            w = w - np.linalg.solve(h, g)
        model.base, model.slope = float(w[0]), float(max(0.1, w[1]))
    return model


def measured(rows: DataFrame, model: Model) -> DataFrame:
    """rows' label with what their runs amount to: tokens, least score of a run, number of runs, evidence."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        odds = Odds(m.scores, m.drift)
        for b in batches:
            out = []
            for text in b.column(0):
                x = m.token_scores(odds, lowered(text.as_py()))
                runs = segments(x) if len(x) and x.max() > 0 else []
                out.append((len(x), min((r[2] for r in runs), default=None), len(runs), m.evidence(m.passages(x))))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), b.column(1)], ["n", "least", "runs", "evidence", "y"])

    return rows.select("text", "y").mapInArrow(run, "n long, least double, runs long, evidence double, y int")


def sketch(text: str) -> np.ndarray:
    """SKETCH minimal hashes of a text's five-word shingles; two texts agree in about the share of their Jaccard similarity."""
    s = shingles(text)
    return np.array([((s * m) ^ (s * m >> np.uint64(29))).min() if len(s) else 0 for m in MIXERS], np.uint64).view(np.int64)


def distinct(train: DataFrame) -> DataFrame:
    """Of near copies with one label the row of the least id. The rows are bounded (Settings.train_rows), so their sketches, SKETCH
    numbers each, are grouped on the driver: texts that agree in a band of BAND numbers and in seven tenths of all are copies.
    What the sketches miss stays in training; nothing but the model's weights depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sketch(t.as_py()) for t in b.column(2)], pa.list_(pa.int64()))], ["doc_id", "y", "s"])

    t = train.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, s array<long>").toArrow().sort_by("doc_id").combine_chunks()
    if not t.num_rows:
        return train
    ids, y = t.column("doc_id").to_numpy(), t.column("y").to_numpy()
    s = t.column("s").combine_chunks().flatten().to_numpy().reshape(len(ids), SKETCH)
    a, b = [], []
    for k in range(0, SKETCH, BAND):
        first: dict[tuple[int, bytes], int] = {}
        for i, band in enumerate(np.ascontiguousarray(s[:, k : k + BAND])):
            j = first.setdefault((int(y[i]), band.tobytes()), i)
            if j != i and 10 * int((s[i] == s[j]).sum()) >= 7 * SKETCH:
                a.append(i)
                b.append(j)
    root = union_roots(len(ids), np.array(a, np.int64), np.array(b, np.int64))
    keep = ids[root == np.arange(len(ids))]
    return train.join(F.broadcast(train.sparkSession.createDataFrame(pa.table({"doc_id": keep}))), "doc_id", "left_semi")


def learned(docs: DataFrame, labels: DataFrame, settings: Settings, folds: int, fold: int, id_col: str, text_col: str) -> Model:
    """The model of the training rows; of near copies with one label one is learned from, or their words would pass for signs."""
    train = written(train_rows(docs, labels, "toxic", held_out(F.col("k"), folds, fold), settings.train_rows, id_col, text_col), "toxic-rows")
    return fit(written(distinct(train), "toxic-train"), settings)


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages): every row's whole text scored; passages in code points, end exclusive.

    Labels of rows in the held-out fold (crc32 of the id as text) are not read, and neither id nor any column but the text
    enters a score. Null and empty texts hold no passage and get the lowest score. A null id is not held out. Without labels of
    both classes all scores are low. An empty table gives no rows; repeated rows are scored each.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, settings, folds, fold, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        odds = Odds(m.scores, m.drift)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for b in batches:
            scores, passages = [], []
            for text in b.column(2):
                low = lowered(text.as_py())
                found = m.passages(m.token_scores(odds, low))
                scores.append(m.probability(m.evidence(found)))
                spans = []
                if found:
                    need = {i for a, e, _, _ in found for i in (a, e - 1)}
                    at = {i: t.span() for i, t in enumerate(TOKEN.finditer(low)) if i in need}
                    spans = [{"start": at[a][0], "end": at[e - 1][1], "score": s, "expected": x} for a, e, s, x in found]
                passages.append(spans)
            p = pa.array([int(x >= 0.5) for x in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), p, pa.array(passages, kind)], ["doc_id", "held_out", "score", "predicted", "passages"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:long,end:long,score:double,expected:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5, fold: int = 0, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below `least`, all columns as they were; scores as in score_toxicity, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, settings, folds, fold, id_col, text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        odds = Odds(m.scores, m.drift)
        for b in batches:
            keep = [m.probability(m.evidence(m.passages(m.token_scores(odds, lowered(t.as_py()))))) < least for t in b.column(place)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
