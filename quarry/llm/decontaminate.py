"""Benchmark decontamination by pigeonhole edit matching: exact hits of pieces, then Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items that one automaton holds; a larger benchmark is searched in several blocks of items.
BLOCK = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces; whatever the errors, one of them is left untouched."""
    n = errors + 1
    cut = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def places(item: str) -> dict[str, int]:
    """For every letter the bits of its places in the item."""
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    return at


def nearest(item: str, at: dict[str, int], text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end): the least edit distance of item to any substring of text, and where the first such ends (Myers).

    anchored: the substring starts where the text does, so each letter passed costs one at the item's empty beginning.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        grow = down | ~(d | up) & full
        fall = up & d
        if grow & top:
            score += 1
        elif fall & top:
            score -= 1
        grow, fall = (grow << 1 | anchored) & full, fall << 1 & full
        up = fall | ~(d | grow) & full
        down = grow & d
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        self.bits: dict[int, dict[str, int]] = {}
        of: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                of.setdefault(piece, []).append((k, offset))
        self.tree = ahocorasick.Automaton()
        for piece, where in of.items():
            self.tree.add_word(piece, (len(piece), where))
        self.tree.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) for each item within its budget, at its best place in a normalised text."""
        if not len(self.tree):
            return []
        tried: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for last, (size, where) in self.tree.iter(text):
            for k, offset in where:
                _, t, e = self.items[k]
                at = last + 1 - size - offset
                if best.get(k, (1,))[0] == 0 or at in tried.setdefault(k, set()):
                    continue
                tried[k].add(at)
                m = len(t)
                if at >= 0 and text.startswith(t, at):
                    best[k] = (0, at, at + m)
                    continue
                if e == 0:
                    continue
                if k not in self.bits:
                    self.bits[k] = places(t)
                lo = max(0, at - e)
                d, end = nearest(t, self.bits[k], text[lo : max(0, at + m + e)])
                if d <= e and (k not in best or d < best[k][0]):
                    back = nearest(t[::-1], places(t[::-1]), text[max(0, lo + end - m - e) : lo + end][::-1], anchored=True)
                    best[k] = (d, lo + end - back[1], lo + end)
        return [(self.items[k][0], *x) for k, x in sorted(best.items())]


_MATCHERS: dict[tuple[int, float], Matcher] = {}


def matcher(items: list[tuple[int, str]], rate: float) -> Matcher:
    """The Matcher of these items; a worker process keeps the last one for its next task."""
    key = (xxhash.xxh3_64_intdigest(repr(items)), rate)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate)
    return _MATCHERS[key]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK characters, one at a time on the driver; one empty block if there are none."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item")).filter(F.length(F.trim("item")) > 0).distinct()
    total = items.agg(F.sum(F.length("item").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == k).orderBy("item_id", "item").collect()
        yield [(r[0], t) for r in rows if (t := normal(r[1]))]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): benchmark items found in whole documents within floor(rate * length) edits.

    Both sides are normalised (lower case, white space as single blanks); offsets are code points of the normalised text: the
    first end of a match of the least distance, and the latest start that goes with it. The
    benchmark is the stated query set: its size is summed first, and it goes to the executors in blocks of at most about BLOCK
    characters, each block against all documents. Items that are null or blank match nothing; a null text holds nothing; an
    item listed twice is reported once for each id. Documents with null or repeated ids are searched like any other.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(items: list[tuple[int, str]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = matcher(sent.value, rate)
            for b in batches:
                out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in m.find(normal(t.as_py()))]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        return d.mapInArrow(run, "doc_id long, item_id long, distance int, start long, end long")

    return reduce(DataFrame.unionByName, map(search, _blocks(benchmark, item_col, item_text)))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item (as in find_leaks), all columns as they were; no shuffle."""
    place = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = matcher(sent.value, rate)
            for b in batches:
                yield b.filter(pa.array([not m.find(normal(t.as_py())) for t in b.column(place)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
