"""Chunkers. Each text is cut in one narrow pass; fixed windows stay in the JVM."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import bpe
from quarry.operators.tokens import Scan, over_texts, scan
from quarry.schema import ConfigurationError

FIXED, SENTENCE, PARAGRAPH, SEMANTIC, ADAPTIVE, TOKEN = "fixed", "sentence", "paragraph", "semantic", "adaptive", "token"
_SENTENCE_END, _PARAGRAPH_END = re.compile(r"[.!?]+\s+"), re.compile(r"\n\s*\n")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in code points, of semantic and adaptive chunks in tokens: the engine's own, or those of `tokenizer`, a file of ranks of
    a byte-level BPE vocabulary at a path that all machines have. drop_short_tail: leave out a last section shorter than min_size, as the older behaviour did."""

    strategy: str = ADAPTIVE
    max_size: int = 2000
    overlap: int = 200
    min_size: int = 100
    max_chunks: int | None = None
    drop_short_tail: bool = False
    tokenizer: str | None = None

    def __post_init__(self):
        if self.max_size < 1:
            raise ConfigurationError("max_size must be positive")
        if self.overlap >= self.max_size:
            raise ConfigurationError("overlap must be less than max_size")


def fixed(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of `size` that start every size - overlap code points."""
    return [(p, min(p + size, length)) for p in range(0, length, size - overlap)]


def by_boundaries(length: int, ends: list[int], c: ChunkConfig) -> list[tuple[int, int]]:
    """Spans that close at boundaries: at the first one, and then once min_size is reached; sections over max_size are windowed."""
    out: list[tuple[int, int]] = []
    start = 0
    for end in sorted({*ends, length}):
        size = end - start
        if size <= 0:
            continue
        if size > c.max_size:
            out += [(start + a, start + b) for a, b in fixed(size, c.max_size, c.overlap)]
        elif size >= c.min_size or not out or (end == length and not c.drop_short_tail):
            out.append((start, end))
        else:
            continue
        start = end
    return out


def semantic(text: str, limit: int, count: Callable[[str], int] | None = None, sizer: Callable[[str], bpe.Sizer] | None = None) -> list[tuple[int, int]]:
    """Contiguous pieces within the limit: the coarsest separators that do, neighbours packed while they fit.

    A piece's size is its number of tokens (any that it touches), found by bisection in one scan of the text; or count(piece); or
    what sizer(text) gives for its ends.
    """
    levels = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"(?<=[,;:])\s+"), re.compile(r"\s+"))

    if sizer is not None:
        size = sizer(text)
    elif count is None:
        s = scan([text])
        starts, ends = s.start.tolist(), s.end.tolist()
        size = lambda a, b: bisect_left(starts, b) - bisect_right(ends, a)
    else:
        size = lambda a, b: count(text[a:b])

    def parts(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if size(a, b) <= limit or b - a <= 1:
            return [(a, b)]
        if level == len(levels):
            m = (a + b) // 2
            return parts(a, m, level) + parts(m, b, level)
        cuts = [a, *(e for m in levels[level].finditer(text, a, b) if a < (e := m.end()) < b), b]
        if len(cuts) == 2:
            return parts(a, b, level + 1)
        packed: list[tuple[int, int]] = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            if packed and size(packed[-1][0], y) <= limit:
                packed[-1] = (packed[-1][0], y)
            else:
                packed.append((x, y))
        return [z for x, y in packed for z in ([(x, y)] if size(x, y) <= limit else parts(x, y, level + 1))]

    return parts(0, len(text), 0)


def capped(spans: list[tuple[int, int]], most: int | None) -> list[tuple[int, int]]:
    """At most `most` spans, the last one covering all the rest."""
    if not most or len(spans) <= most:
        return spans
    return spans[: most - 1] + [(spans[most - 1][0], spans[-1][1])]


def token_spans(start: list[int], end: list[int], newline: list[bool], last: list[bool], size: int) -> list[tuple[int, int]]:
    """Token ranges of greedy chunks over one text's tokens (as of a Scan): whole sentences packed while they fit in `size` code
    points; a longer sentence is broken, best at its last line break, and what is left of it is a chunk of its own; a token
    longer than size stands alone."""
    n = len(start)
    ends = [i + 1 for i in range(n) if last[i]]
    out: list[tuple[int, int]] = []
    at, k, rest = 0, 0, False  # ends[k]: the end of the sentence that holds token `at`; a restart inside a sentence keeps its end
    while at < n:
        while ends[k] <= at:
            k += 1
        stop = ends[k]
        if end[at] - start[at] > size:
            out.append((at, at + 1))
            rest = at + 1 < stop
            at += 1
            continue
        if end[stop - 1] - start[at] > size:
            line = None
            for t in range(at, stop):
                if newline[t]:
                    line = t
                if end[t] - start[at] > size:
                    stop = line if line is not None and line > at else t
                    break
            rest = True
        elif rest:
            rest = False
        else:
            while k + 1 < len(ends) and end[ends[k + 1] - 1] - start[at] <= size:
                k += 1
            stop = ends[k]
        out.append((at, stop))
        at = stop
    return out


def token_chunks(s: Scan, texts: int, size: int) -> list[list[tuple[int, int]]]:
    """For each of the scanned texts its greedy chunks in code points."""
    cut = np.searchsorted(s.text, np.arange(texts + 1)).tolist()
    cols = [x.tolist() for x in (s.start, s.end, s.newline, s.last)]
    out = []
    for lo, hi in zip(cut, cut[1:], strict=False):
        start, end, newline, last = (c[lo:hi] for c in cols)
        out.append([(start[a], end[b - 1]) for a, b in token_spans(start, end, newline, last, size)])
    return out


def spans(text: str, c: ChunkConfig, count: Callable[[str], int] | None = None) -> list[tuple[int, int]]:
    """Chunk spans of one text in code points; a text within max_size is one chunk whatever the strategy."""
    if not text:
        return []
    if c.strategy == TOKEN:
        return token_chunks(scan([text]), 1, c.max_size)[0]
    if len(text) <= c.max_size and not (c.tokenizer and c.strategy in (SEMANTIC, ADAPTIVE)):  # a code point may be several tokens
        return [(0, len(text))]
    if c.strategy == FIXED:
        return capped(fixed(len(text), c.max_size, c.overlap), c.max_chunks)
    if c.strategy in (SENTENCE, PARAGRAPH):
        pattern = _SENTENCE_END if c.strategy == SENTENCE else _PARAGRAPH_END
        return capped(by_boundaries(len(text), [m.end() for m in pattern.finditer(text)], c), c.max_chunks)
    if c.strategy in (SEMANTIC, ADAPTIVE):
        return capped(semantic(text, c.max_size, count, partial(bpe.sizer, path=c.tokenizer) if c.tokenizer and count is None else None), c.max_chunks)
    raise ConfigurationError(f"Unknown chunking strategy: {c.strategy}")


def chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig(), count: Callable[[str], int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, text, char_offset, char_length, has_overlap, overlap_start, overlap_end); text without a row has no chunk.

    Fixed windows are Column expressions; the other strategies scan each text once. count sizes semantic chunks (default: the
    core's own tokens; a model's tokenizer may be passed). Nothing is shuffled.
    """
    if config.strategy == FIXED and not config.max_chunks:
        return fixed_chunks(docs, config, id_col, text_col)

    def make(texts: list[str]):
        every = token_chunks(scan(texts), len(texts), config.max_size) if config.strategy == TOKEN else [spans(t, config, count) for t in texts]
        of, rows = [], []
        for k, (t, s) in enumerate(zip(texts, every, strict=True)):
            for i, (a, b) in enumerate(s):
                left = max(0, s[i - 1][1] - a) if i else 0
                right = max(0, b - s[i + 1][0]) if i + 1 < len(s) else 0
                of.append(k)
                rows.append((i, t[a:b], a, b - a, left > 0 or right > 0, left, right))
        return np.array(of, np.int64), list(zip(*rows, strict=True)) or [[]] * 7

    schema = [("chunk_id", pa.int32()), ("text", pa.string()), ("char_offset", pa.int64()), ("char_length", pa.int64()), ("has_overlap", pa.bool_()), ("overlap_start", pa.int32()), ("overlap_end", pa.int32())]
    return over_texts(docs, id_col, text_col, make, schema, "chunk_id int, text string, char_offset bigint, char_length bigint, has_overlap boolean, overlap_start int, overlap_end int")


def fixed_chunks(docs: DataFrame, c: ChunkConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    n = F.length(t)
    starts = F.when(n <= c.max_size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(c.max_size - c.overlap)))
    x = docs.filter(n > 0).select(id_col, t.alias("_t"), n.alias("_n"), F.posexplode(starts).alias("chunk_id", "_p"))
    end = F.least(F.col("_p") + c.max_size, F.col("_n"))
    windowed = (F.col("_n") > c.max_size) & (F.lit(c.overlap) > 0)
    left = F.when(windowed & (F.col("chunk_id") > 0), F.least(F.lit(c.overlap), F.col("_n") - F.col("_p"))).otherwise(0)
    right = F.when(windowed & (end < F.col("_n")), F.lit(c.overlap)).otherwise(0)
    return x.select(
        id_col, "chunk_id", F.substring("_t", F.col("_p") + 1, end - F.col("_p")).alias("text"), F.col("_p").cast("long").alias("char_offset"), (end - F.col("_p")).cast("long").alias("char_length"),
        ((left > 0) | (right > 0)).alias("has_overlap"), left.cast("int").alias("overlap_start"), right.cast("int").alias("overlap_end"),
    )


def core_text(text: Column, overlap_start: Column, overlap_end: Column) -> Column:
    """A chunk's text without what it shares with its neighbours."""
    return F.substring(text, (overlap_start + 1).cast("int"), F.greatest(F.lit(0), F.length(text) - overlap_start - overlap_end).cast("int"))
