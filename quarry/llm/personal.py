"""Personal data: candidate spans of high recall, boosted trees over their format and context, calibrated thresholds."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarry.llm.common import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates scored together, and texts taken up together.
AT_ONCE, TEXTS = 1 << 14, 512

NUMBER = re.compile(r"[0-9]++")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]++")
#: Wider forms of an address: letters of any script, blanks around the sign, and signs spelt out.
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|punto|punkt|point) ?[\])}>] ?| (?:dot|punto|punkt|point) )"
SIGN = re.compile(r" ?@ ?| ?[\[({<] ?(?:at|arroba) ?[\])}>] ?| (?:at|arroba) (?=[\w-]+ (?:dot|punto|punkt|point) )", re.I)
WIDE_LOCAL, WIDE_DOMAIN = re.compile(r"[\w.%+-]{1,64}\Z"), re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)*", re.I)
DOT = re.compile(_DOT, re.I)
#: Words that go with a kind, in the corpus's languages.
CUES = (
    ("mail", "correo", "contact", "kontakt", "write"),
    (" ip", "host", "server", "addr", "client"),
    ("card", "karte", "carte", "tarjeta", "visa", "credit", "iban"),
    ("tel", "phone", "call", "fax", "mobil", "anruf", "llam", "appel"),
)
#: Code points before and after a span that count as its context; digits there beyond which numbers are a table's.
BEFORE, AFTER, CROWD = 40, 20, 24
#: Gradients are summed as whole numbers of such parts, so that no sum depends on the order of rows.
PARTS = 1 << 24


@dataclass(frozen=True)
class Settings:
    """examples: the labelled candidates of either label without which a kind adds nothing."""

    rounds: int = 40
    rate: float = 0.3
    bins: int = 16
    least: int = 5
    precision: float = 0.98
    examples: int = 20


# ---- spans


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(sum(divmod(2 * int(c), 10)) for c in back[1::2])) % 10 == 0


def _small(number: str) -> bool:
    """At most 255, however many zeros it begins with."""
    n = number.lstrip("0")
    return len(n) <= 3 and int(n or 0) <= 255


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, passed) of the base patterns' leftmost non-overlapping matches, and whether each passes its test.

    Every pattern is followed by one scan, whatever the text: addresses from their sign, numbers by whole groups of digits.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            end = m.end()
            yield EMAIL, s, end, True
        at = text.find("@", at + 1)
    for m in CHAIN.finditer(text):
        if m.group().count(".") >= 3:
            at = m.start()
            for four in batched(m.group().split("."), 4):
                e = at + sum(map(len, four)) + len(four) - 1
                if len(four) == 4:
                    yield IP, at, e, all(map(_small, four))
                at = e + 1
    s = e = n = 0  # digits in a row, single blanks or hyphens between them
    for m in NUMBER.finditer(text):
        if n and m.start() == e + 1 and text[e] in " -":
            n += m.end() - m.start()
        else:
            if n >= 2:
                yield CARD, s, e, 14 <= n <= 19 and luhn(re.sub("[ -]", "", text[s:e]))
            s, n = m.start(), m.end() - m.start()
        e = m.end()
    if n >= 2:
        yield CARD, s, e, 14 <= n <= 19 and luhn(re.sub("[ -]", "", text[s:e]))
    for m in PLUS.finditer(text):
        e = m.start() + len(m.group().rstrip(" ().-"))
        if e - m.start() >= 4:
            yield PHONE, m.start(), e, 10 <= sum(map(str.isdigit, m.group())) <= 15


def wider(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of overlapping candidates: spelt out or spaced addresses, and every row of few groups of digits that could
    be a number of some kind. Their number is linear in the text, and nothing but the last groups is held."""
    for m in SIGN.finditer(text):
        a = WIDE_LOCAL.search(text[max(0, m.start() - 64) : m.start()])
        b = a and WIDE_DOMAIN.match(text, m.end())
        if b:
            yield EMAIL, m.start() - len(a.group()), b.end()
    last: deque[tuple[int, int, str]] = deque(maxlen=8)  # start, end, what stands between this and the group before
    for m in NUMBER.finditer(text):
        gap = text[last[-1][1] : m.start()] if last and m.start() - last[-1][1] <= 3 else None
        if gap is None or gap.strip(" ().-/"):
            last.clear()
            gap = ""
        last.append((m.start(), m.end(), gap))
        e, n, gaps = m.end(), 0, []
        for k in range(len(last) - 1, -1, -1):
            s, stop, gap = last[k]
            n += stop - s
            if n > 19:
                break
            groups = len(gaps) + 1
            if groups == 4 and gaps == ["."] * 3:
                yield IP, s, e
            if 12 <= n and all(g in (" ", "-", ".") for g in gaps) and all(last[j][1] - last[j][0] >= 3 for j in range(k, len(last))):
                yield CARD, s, e
            if 7 <= n <= 15:
                front = s - (text[s - 1 : s] == "(")
                plus = front - (text[front - 1 : front] == "+")
                if plus < front or groups >= 3:
                    yield PHONE, plus, e
            gaps.append(gap)


def may_be_added(text: str, kind: int, s: int, e: int) -> bool:
    """False for candidates that teach the trees but are never added, as no example shows which of them are wrong: card numbers in a
    crowd of other digits, one in ten of which passes the check digit, and numbers without a + that no word before calls a telephone's."""
    before = text[max(0, s - BEFORE) : s]
    if kind == CARD:
        return sum(map(str.isdigit, before + text[e : e + BEFORE])) <= CROWD
    return kind != PHONE or text[s] == "+" or any(c in before.lower() for c in CUES[PHONE])


def _plain_address(span: str) -> tuple[str, list[str]]:
    sign = SIGN.search(span)
    return (span[: sign.start()], DOT.split(span[sign.end() :])) if sign else (span, [])


def plausible(kind: int, span: str) -> bool:
    """The kind's own test, of a candidate in any form."""
    if kind == EMAIL:
        _, domain = _plain_address(span)
        return len(domain) >= 2 and all(domain) and domain[-1].isalpha() and len(domain[-1]) >= 2
    groups = NUMBER.findall(span)
    n = sum(map(len, groups))
    if kind == IP:
        return len(groups) == 4 and all(map(_small, groups))
    if kind == CARD:
        return 14 <= n <= 19 and luhn("".join(groups))
    return 7 <= n <= 15


FEATURES = (
    "digits", "letters", "length", "groups", "least_group", "greatest_group", "last_group", "distinct", "luhn", "small_groups", "zeros", "blanks", "hyphens", "dots", "brackets",
    "first_digit", "before", "after", "cue", "other_cue", "digits_around", "local", "labels", "last_label", "plain_label", "tested",
)


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\"'=:/\\_" else 4


def features(text: str, kind: int, s: int, e: int) -> list[float]:
    """Format and context of a candidate, in the order of FEATURES. A leading + is left out, so that numbers without one can be like others."""
    span, before, after = text[s:e], text[max(0, s - BEFORE) : s], text[e : e + AFTER]
    groups = NUMBER.findall(span)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    context = before.lower()
    local, domain = _plain_address(span) if kind == EMAIL else ("", [])
    return [
        len(digits), sum(map(str.isalpha, span)), e - s, len(groups), min(sizes), max(sizes), sizes[-1], len(set(digits)), len(digits) <= 19 and luhn(digits or "0"), all(map(_small, groups)),
        sum(len(g) > 1 and g[0] == "0" for g in groups), span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("["), int(digits[:1] or -1),
        _side(before[-1:].replace("+", " ").replace("(", " ")), _side(after[:1]), any(c in context for c in CUES[kind]), any(c in context for k, x in enumerate(CUES) if k != kind for c in x),
        (sum(map(str.isdigit, before)) + sum(map(str.isdigit, after))) / (BEFORE + AFTER), len(local), len(domain), len(domain[-1]) if domain else 0, bool(domain) and domain[-1].isalpha(), plausible(kind, span),
    ]


class Base:
    """The base spans of one text, and what overlaps them."""

    def __init__(self, text: str):
        found = list(matches(text))
        self.spans = [(k, s, e) for k, s, e, ok in found if ok]
        self.every = {(k, s, e): ok for k, s, e, ok in found}
        self.by = [sorted((s, e) for k, s, e in self.spans if k == kind) for kind in range(len(KINDS))]

    def touches(self, kind: int, s: int, e: int) -> bool:
        x = self.by[kind]
        i = bisect_left(x, (e, -1)) - 1  # spans of one kind do not overlap
        return i >= 0 and x[i][1] > s

    def label(self, text: str, kind: int, s: int, e: int) -> int | None:
        """1 for base spans, 0 for what fails its own test or touches a base span of another kind, else unknown."""
        known = self.every.get((kind, s, e))
        if known:
            return 1
        if known is False or not plausible(kind, text[s:e]) or any(self.touches(k, s, e) for k in range(len(KINDS)) if k != kind):
            return 0
        return None

    def proposed(self, text: str) -> Iterator[tuple[int, int, int]]:
        """All candidates, base matches included, each once."""
        yield from self.every
        seen: deque = deque(maxlen=64)  # the same span comes again only at once
        for c in wider(text):
            if c not in self.every and c not in seen:
                seen.append(c)
                yield c


def may_hold(text: str) -> bool:
    return bool(NUMBER.search(text) or SIGN.search(text))


# ---- trees


@dataclass
class Trees:
    """Trees of three levels, laid out as heaps: features and cuts of inner nodes, values of leaves."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 7), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 7)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = math.inf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(3):
                at = 2 * at + 1 + (x[row, f[at]] >= c[at])
            out += v[at - 7]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shift + self.slope * self.margin(x), -30, 30)))


#: A node that is not split: no bin is beyond it.
NOWHERE = 255


@dataclass
class Binned:
    """One tree over bins: a row goes right where its bin is beyond the node's place."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(7, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.full(7, NOWHERE))
    value: np.ndarray = field(default_factory=lambda: np.zeros(8))

    def node(self, bins: np.ndarray, level: int) -> np.ndarray:
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(level):
            at = 2 * at + 1 + (bins[row, self.feature[at]] > self.place[at])
        return at

    def split(self, node: int, sums: np.ndarray, s: Settings) -> None:
        """The best split of a node by its sums (gradients, curvatures, rows) for each feature and bin; the last level's give the leaves."""
        (ga, hb, m), (a, b, n) = sums[:, 0].sum(1), sums.cumsum(2)[:, :, :-1]
        left = (ga, hb)
        if m >= 2 * s.least:
            gain = a**2 / (b + 1) + (ga - a) ** 2 / (hb - b + 1) - ga**2 / (hb + 1)
            gain[(n < s.least) | (m - n < s.least)] = 0
            k = int(gain.argmax())
            if gain.flat[k] > 1e-6:
                self.feature[node], self.place[node] = divmod(k, gain.shape[1])
                left = a.flat[k], b.flat[k]
        if node >= 3:
            for leaf, (g, h) in enumerate((left, (ga - left[0], hb - left[1])), 2 * node - 6):
                self.value[leaf] = -s.rate * g / (h + 1)


def margins(trees: list[Binned], base: float, bins: np.ndarray) -> np.ndarray:
    out = np.full(len(bins), base)
    for t in trees:
        out += t.value[t.node(bins, 3) - 7]
    return out


def histogram(trees: list[Binned], base: float, level: int, bins: np.ndarray, y: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Sums in PARTS by node of the last tree's level, (gradient, curvature, rows), feature and bin, of rows that stand for n each."""
    wide, nodes, many = s.bins + 1, 1 << level, bins.shape[1]
    p = 1 / (1 + np.exp(-margins(trees[:-1], base, bins)))
    at = trees[-1].node(bins, level) - (nodes - 1)
    slot = (bins + (at[:, None] * many + np.arange(many)) * wide).ravel()
    sums = [np.bincount(slot, np.repeat(np.round(w * n * PARTS), many), nodes * many * wide) for w in (p - y, p * (1 - p), np.ones(len(y)))]
    return np.stack(sums).astype(np.int64).reshape(3, nodes, many, wide).transpose(1, 0, 2, 3)


def grown(bases: dict[int, float], sums: Callable[[dict[int, list[Binned]], int], dict[int, np.ndarray]], s: Settings) -> dict[int, list[Binned]]:
    """Newton boosting of the logistic loss, of all kinds side by side; sums(trees, level) is the histogram() of all rows by kind."""
    trees: dict[int, list[Binned]] = {k: [] for k in bases}
    for _ in range(s.rounds):
        for own in trees.values():
            own.append(Binned())
        for level in range(3):
            for k, nodes in sums(trees, level).items():
                for i, one in enumerate(nodes):
                    trees[k][-1].split((1 << level) - 1 + i, one / PARTS, s)
    return trees


def log_odds(right: float, rows: float) -> float:
    return math.log(right / (rows - right))


def in_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


def unbinned(trees: list[Binned], cuts: list[np.ndarray], base: float) -> Trees:
    cut = lambda f, k: math.inf if k == NOWHERE else cuts[f][k]
    return Trees(np.stack([t.feature for t in trees]), np.array([[cut(f, k) for f, k in zip(t.feature, t.place, strict=True)] for t in trees], float), np.stack([t.value for t in trees]), base)


def boosted(x: np.ndarray, y: np.ndarray, s: Settings) -> Trees:
    """Trees from rows at hand."""
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, s.bins + 1)[1:-1], method="higher")) for v in x.T]
    cuts = [c[c > v.min()] for c, v in zip(cuts, x.T, strict=True)]
    bins, base = in_bins(x, cuts), log_odds(y.sum(), len(y))
    trees = grown({0: base}, lambda trees, level: {0: histogram(trees[0], base, level, bins, y, np.ones(len(y)), s)}, s)
    return unbinned(trees[0], cuts, base)


def newton(w: np.ndarray, sums: Iterable[float]) -> np.ndarray:
    """A step of Platt's scaling from the sums of p - y, (p - y) m, v, v m and v m m over all rows, v being p (1 - p)."""
    g, gm, v, vm, vmm = sums
    return w - np.linalg.solve([[v + 0.1, vm], [vm, vmm + 0.1]], np.array([g, gm]) + 0.1 * (w - [0, 1]))


def calibrated(t: Trees, x: np.ndarray, y: np.ndarray, s: Settings) -> Trees:
    """Platt's scaling on rows that the trees have not seen, and the threshold: half-way between the least probability down to which
    those rows have the precision that is asked for and the next one, 0.5 at least."""
    m, w = t.margin(x), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * m, -30, 30)))
        v = p * (1 - p)
        w = newton(w, ((p - y).sum(), ((p - y) * m).sum(), v.sum(), (v * m).sum(), (v * m * m).sum()))
    t.shift, t.slope = float(w[0]), float(max(0.05, w[1]))
    p = t.probability(x)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= s.precision) & (np.r_[p[order][1:], -1] < p[order]))  # whole ties only
    if len(good):
        below = np.r_[p[order], 0.0][good[-1] + 1]
        t.threshold = max(0.5, float(p[order[good[-1]]] + below) / 2)
    return t


# ---- Spark


def labelled(d: DataFrame) -> DataFrame:
    """(kind, y, rest, x, n): the labelled candidates of all texts, equal ones as one row; those with rest, by a hash one in four, calibrate."""
    schema = "kind int, y int, rest boolean, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[tuple]:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                if may_hold(text):
                    base, name = Base(text), str(i.as_py())
                    for c in base.proposed(text):
                        if (y := base.label(text, *c)) is not None:
                            yield c[0], y, zlib.crc32(f"{name}:{c}".encode()) % 4 == 0, [float(v) for v in features(text, *c)]

        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float64()))
        for b in batches:
            for some in batched(rows(b), AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], ["kind", "y", "rest", "x"])

    return d.mapInArrow(run, schema).groupBy("kind", "y", "rest", "x").agg(F.count(F.lit(1)).alias("n"))


def cut_points(rows: DataFrame, s: Settings) -> dict[int, list[np.ndarray]]:
    """The cuts of each kind and feature: the values at each of s.bins equal shares of all its rows but the least value."""
    v = rows.select("kind", "n", F.posexplode("x").alias("feature", "v")).groupBy("kind", "feature", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("kind", "feature")
    upto, last = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(w) - 1
    v = v.select("kind", "feature", "v", F.min("v").over(w).alias("least"), (upto - F.col("n")).alias("first"), upto.alias("upto"), last.alias("last"))
    hit = lambda i: F.ceil(i * F.col("last") / s.bins).between(F.col("first"), F.col("upto") - 1)
    got = v.filter((F.col("v") > F.col("least")) & F.exists(F.sequence(F.lit(1), F.lit(s.bins - 1)), hit)).select("kind", "feature", "v").collect()
    out = {k: [[] for _ in FEATURES] for k in range(len(KINDS))}
    for r in got:
        out[r.kind][r.feature].append(r.v)
    return {k: [np.array(sorted(c)) for c in f] for k, f in out.items()}


def _of_kinds(b: pa.RecordBatch, kinds: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, bins, y, n) of the rows of each kind."""
    kind, y, n = (b.column(c).to_numpy() for c in ("kind", "y", "n"))
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, len(FEATURES))
    for k in kinds:
        at = np.flatnonzero(kind == k)
        if len(at):
            yield k, bins[at], y[at], n[at]


def fit(rows: DataFrame, s: Settings) -> list[Trees]:
    """Trees for each kind from all rows of labelled(). Every histogram and sum is taken by a job over all of them; the driver gets
    sums by node, feature and bin alone, so that what it holds does not grow with the corpus.

    A kind with fewer than s.examples candidates of either label has a threshold that nothing reaches: base spans alone.
    """
    rows = written(rows, "labelled-spans")
    many = {(r.kind, r.rest, r.y): r.n for r in rows.groupBy("kind", "rest", "y").agg(F.sum("n").alias("n")).collect()}
    of = lambda k, rest: (many.get((k, rest, 0), 0), many.get((k, rest, 1), 0))
    kinds = [k for k in range(len(KINDS)) if min(of(k, False)) >= s.examples and min(of(k, True)) > 0]
    out = [Trees() for _ in KINDS]
    if not kinds:
        return out
    rows = rows.filter(F.col("kind").isin(kinds))
    cuts = cut_points(rows.filter(~F.col("rest")), s)
    bases = {k: log_odds(of(k, False)[1], sum(of(k, False))) for k in kinds}

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column("kind").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            bins = np.zeros(x.shape, np.uint8)
            for k in kinds:
                bins[kind == k] = in_bins(x[kind == k], cuts[k])
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("y"), b.column("rest"), pa.array([r.tobytes() for r in bins], pa.binary()), b.column("n")], ["kind", "y", "rest", "bins", "n"])

    binned = rows.select("kind", "y", "rest", "x", "n").mapInArrow(bin_, "kind int, y int, rest boolean, bins binary, n long")
    binned = written(binned.groupBy("kind", "y", "rest", "bins").agg(F.sum("n").alias("n")), "binned-spans")
    seen = binned.filter(~F.col("rest")).select("kind", "y", "bins", "n")

    def sums(trees: dict[int, list[Binned]], level: int) -> dict[int, np.ndarray]:
        shape = (1 << level, 3, len(FEATURES), s.bins + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {k: np.zeros(math.prod(shape), np.int64) for k in kinds}
            for b in batches:
                for k, bins, y, n in _of_kinds(b, kinds):
                    held[k] += histogram(trees[k], bases[k], level, bins, y, n, s).ravel()
            for k, h in held.items():
                at = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(h[at])], ["kind", "slot", "v"])

        got = seen.mapInArrow(run, "kind int, slot int, v long").groupBy("kind", "slot").agg(F.sum("v").alias("v")).toArrow()
        kind, slot, v = (got.column(c).to_numpy() for c in ("kind", "slot", "v"))
        out = {k: np.zeros(math.prod(shape), np.int64) for k in kinds}
        for k, h in out.items():
            h[slot[kind == k]] = v[kind == k]
        return {k: h.reshape(shape) for k, h in out.items()}

    trees = grown(bases, sums, s)

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, bins, y, n in _of_kinds(b, kinds):
                cols = (np.full(len(y), k, np.int32), margins(trees[k], bases[k], bins), n, n * y)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "m", "n", "good"])

    unseen = binned.filter("rest").select("kind", "y", "bins", "n").mapInArrow(margin, "kind int, m double, n long, good long")
    for k, (shift, slope, threshold) in _thresholds(unseen, kinds, s).items():
        out[k] = unbinned(trees[k], cuts[k], bases[k])
        out[k].shift, out[k].slope, out[k].threshold = shift, slope, threshold
    return out


def _thresholds(rows: DataFrame, kinds: list[int], s: Settings) -> dict[int, tuple[float, float, float]]:
    """calibrated() for rows (kind, m, n, good) of a table: shift, slope and threshold of each kind. Rows are ordered within 1024ths of
    a probability, and begin at what the 1024ths above have in sum."""
    rows = written(rows.groupBy("kind", "m").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "margins")
    w = {k: np.array([0.0, 1.0]) for k in kinds}
    m, n = F.col("m"), F.col("n")

    def chance() -> Column:
        of = lambda i: F.element_at(F.create_map(*(F.lit(v) for k in kinds for v in (k, float(w[k][i])))), F.col("kind"))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), of(0) + of(1) * m))))

    for _ in range(50):
        x = rows.withColumn("p", chance())
        p = F.col("p")
        g, v = p * n - F.col("good"), p * (1 - p) * n
        got = x.groupBy("kind").agg(*(F.sum(F.round(e * PARTS).cast("long")).alias(f"s{i}") for i, e in enumerate((g, g * m, v, v * m, v * m * m)))).collect()
        before = dict(w)
        for r in got:
            w[r.kind] = newton(w[r.kind], [e / PARTS for e in r[1:]])
        if max(np.abs(w[k] - before[k]).max() for k in kinds) < 1e-6:
            break
    w = {k: np.array([v[0], max(0.05, v[1])]) for k, v in w.items()}
    x = rows.groupBy("kind", chance().alias("p")).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("part", F.floor(F.col("p") * 1024))
    above = Window.partitionBy("kind").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy("kind", "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    parts = parts.select("kind", "part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "good")))
    within = Window.partitionBy("kind", "part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(F.broadcast(parts), ["kind", "part"]).withColumn("right", (F.sum("good").over(within) + F.col("good_above")) / (F.sum("n").over(within) + F.col("n_above")))
    least = {r.kind: r.p for r in x.filter(F.col("right") >= s.precision).groupBy("kind").agg(F.min("p").alias("p")).collect()}
    next_ = x.join(F.broadcast(x.filter(F.col("right") >= s.precision).groupBy("kind").agg(F.min("p").alias("least"))), "kind").filter(F.col("p") < F.col("least"))
    below = {r.kind: r.p for r in next_.groupBy("kind").agg(F.max("p").alias("p")).collect()}
    return {k: (float(w[k][0]), float(w[k][1]), max(0.5, (least[k] + below.get(k, 0.0)) / 2) if k in least else math.inf) for k in kinds}


def chosen(base: Base, added: Iterable[tuple[float, int, int, int]]) -> list[dict]:
    """Base spans and, of the candidates (probability, kind, start, end) that touch none of them, the best that do not overlap:
    by probability in hundredths, then length, then place."""
    out = [{"start": s, "end": e, "kind": KINDS[k], "score": 1.0, "base": True} for k, s, e in base.spans]
    taken: list[tuple[int, int]] = []
    for p, k, s, e in sorted(added, key=lambda c: (-round(c[0], 2), c[2] - c[3], c[2], c[1])):
        i = bisect_left(taken, (s, e))
        if (i and taken[i - 1][1] > s) or (i < len(taken) and taken[i][0] < e):
            continue
        taken.insert(i, (s, e))
        out.append({"start": s, "end": e, "kind": KINDS[k], "score": float(p), "base": False})
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


def _reported(texts: list[str], model: list[Trees]) -> list[list[dict]]:
    """The spans of several texts, all their candidates scored together, AT_ONCE at a time."""
    bases = [Base(t) if may_hold(t) else None for t in texts]
    added: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]

    def open_ones() -> Iterator[tuple[int, int, int, int]]:
        for i, (t, b) in enumerate(zip(texts, bases, strict=True)):
            for c in b.proposed(t) if b else ():
                if model[c[0]].threshold < math.inf and c not in b.every and not any(b.touches(k, c[1], c[2]) for k in range(len(KINDS))) and may_be_added(t, *c):
                    yield i, *c

    for some in batched(open_ones(), AT_ONCE):
        x = np.array([features(texts[i], *c) for i, *c in some], float)
        kinds = np.array([c[1] for c in some])
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            p = model[kind].probability(x[at])
            for k, v in zip(at[p >= model[kind].threshold].tolist(), p[p >= model[kind].threshold].tolist(), strict=True):
                added[some[k][0]].append((v, *some[k][1:]))
    return [chosen(b, a) if b else [] for b, a in zip(bases, added, strict=True)]


SPANS = "array<struct<start: bigint, end: bigint, kind: string, score: double, base: boolean>>"


def find_private(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): the personal data of every row's whole text, as (start, end, kind, score, base) by start, then kind.

    Base spans are what the patterns match and their tests let pass; they have score 1 and are always there. The patterns miss what
    stands too close to something else, or is written in another way; so generators propose overlapping candidates, trees boosted
    for each kind score them by format and context, and those over the kind's threshold that touch no base span are added. The trees
    learn from the corpus: base spans are right, candidates that fail their kind's test or touch another kind's base span are wrong,
    others are unknown and are only scored. All labelled candidates of all texts teach them, by jobs that give the driver sums; one
    in four is held out, and the threshold is the least one at which those have settings.precision. With too few examples, or an empty table, a kind has base spans alone.

    Null texts count as empty; equal rows give equal results; ids of any type, nulls too, are handed through. Offsets are code points,
    end exclusive. Scoring is narrow.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sent = d.sparkSession.sparkContext.broadcast(fit(labelled(d), settings))
    schema = StructType([*d.schema.fields, *StructType.fromDDL(f"spans {SPANS}")])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_reported(part.column(1).to_pylist(), sent.value), kind)], schema.names)

    return d.mapInArrow(run, schema)


def _said(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def private_digests(found: DataFrame) -> DataFrame:
    """One row for each of find_private(): counts and digest of base spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_said(base).cast("binary"), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """(doc_id, text) of find_private() with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    end = lambda a: F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0).cast("long"))
    none = F.filter("spans", lambda x: F.lit(False))
    longer = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.get(a, F.size(a) - 1).withField("end", F.greatest(end(a), x["end"]))))
    merged = F.reduce("spans", none, lambda a, x: F.when((F.size(a) > 0) & (x["start"] < end(a)), longer(a, x)).otherwise(F.concat(a, F.array(x))))
    m = found.withColumn("spans", merged)
    upto = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("spans"), i - 1)["end"])
    piece = lambda x, i: F.concat(F.substring("text", (upto(i) + 1).cast("int"), (x["start"] - upto(i)).cast("int")), F.lit("["), x["kind"], F.lit("]"))
    clean = F.concat(F.array_join(F.transform("spans", piece), ""), F.substring("text", (end(F.col("spans")) + 1).cast("int"), F.length("text")))
    return m.select("doc_id", clean.alias("text"))
