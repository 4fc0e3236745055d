"""Tokens and sentences. A scan over the code points of a batch of texts at once; narrow, so no token is ever shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import ACRONYM, NUMBER, PUNCTUATION, WORD, InvalidInputError

#: White space, sentence ends, and abbreviations that end none. A token is a run of letters, of digits (both A-Z,
#: a-z, 0-9), of anything else but white space, or several runs of letters and digits that single slashes join.
SPACE = "\t-\r \x85\xa0  -     　"
ENDS = ".?!"
ABBREVIATIONS = frozenset(
    ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.", "Ave.", "Blvd.", "Rd.", "Ltd.", "Inc.", "Corp.", "vs.", "etc.", "et al.", "i.e.", "e.g.", "cf.", "a.m.", "p.m.", "U.S.", "U.K.", "Ph.D."]
)
KINDS = (WORD, NUMBER, PUNCTUATION, ACRONYM)
#: Code points that are scanned at once, at about 60 bytes each; a longer text is scanned alone.
AT_ONCE = 1 << 18
_SPACE, _LETTER, _DIGIT, _OTHER, _JOINED = range(5)
_CLASS = np.full(0x3001, _OTHER, np.int8)
_CLASS[[c for c in range(len(_CLASS)) if re.match(f"[{SPACE}]", chr(c))]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT


class Token(NamedTuple):
    text: str
    start: int
    end: int
    kind: str
    newline: bool


@dataclass
class Scan:
    """The tokens of several texts, one after the other: text number, place in it, place in KINDS; newline: the gap before (not
    of a text's first token) holds a line break; last: a sentence ends with the token."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    newline: np.ndarray
    last: np.ndarray


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def scan(texts: list[str]) -> Scan:
    """A digit anywhere makes a number, even of an abbreviation with slashes."""
    line = " ".join([*texts, ""])
    c = _codes(line)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = np.where(c < len(_CLASS), _CLASS[np.minimum(c, len(_CLASS) - 1)], _OTHER)
    alnum = (kind == _LETTER) | (kind == _DIGIT)
    slash = np.flatnonzero(c == 47)
    slash = slash[(slash > 0) & (slash < len(c) - 1)]
    slash = slash[alnum[slash - 1] & alnum[slash + 1]]
    number = kind == _DIGIT
    if len(slash):  # whole runs of letters, digits and joining slashes are one token if there is such a slash
        run = alnum.copy()
        run[slash] = True
        edge = np.flatnonzero(np.diff(np.r_[False, run, False].astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        some = np.unique(np.searchsorted(a, slash, side="right") - 1)
        for lo, hi in zip(a[some].tolist(), b[some].tolist(), strict=True):
            kind[lo:hi] = _JOINED
    at = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    end = np.r_[at[1:], len(c)]
    token = kind[at] != _SPACE
    start, end, k = at[token], end[token], kind[at[token]]
    text = np.searchsorted(first, start, side="right") - 1
    digits = np.r_[0, np.cumsum(number)]
    kinds = np.select([(k == _DIGIT) | (digits[end] > digits[start]), k == _LETTER, k == _JOINED], [1, 0, 3], 2).astype(np.int8)
    head = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
    tail = np.r_[head[1:], True] if len(text) else head
    breaks = np.r_[0, np.cumsum((c == 10) | (c == 13))]
    newline = ~head
    newline[1:] &= breaks[start[1:]] > breaks[end[:-1]]
    feeds = np.r_[0, np.cumsum(c == 10)]
    lasts = tail.copy()
    ends = (kinds == 2) & np.isin(c[end - 1], _codes(ENDS))
    lasts |= ends
    for i in np.flatnonzero(ends & ~head & ~tail).tolist():
        if end[i] - start[i - 1] < 12 and line[start[i - 1] : end[i - 1]] + line[start[i] : end[i]] in ABBREVIATIONS:
            lasts[i] = False
    for i in np.flatnonzero(~lasts[:-1] & ~ends[:-1] & (feeds[start[1:]] > feeds[end[:-1]])).tolist():
        lasts[i] = line[start[i + 1]].isupper()
    return Scan(text, start - first[text], end - first[text], kinds, newline, lasts)


def tokenize(text: str | None) -> list[Token]:
    """Tokens in order."""
    t = text or ""
    s = scan([t])
    return [Token(t[a:b], a, b, KINDS[k], n) for a, b, k, n in zip(s.start.tolist(), s.end.tolist(), s.kind.tolist(), s.newline.tolist(), strict=True)]


def tokens_text(text: str, tokens: list[Token], start: int, end: int) -> str:
    if start >= end:
        raise InvalidInputError(f"Start index {start} must be < end index {end}")
    if end > len(tokens):
        raise InvalidInputError(f"Token interval [{start}, {end}) is out of bounds for {len(tokens)} tokens")
    return text[tokens[start].start : tokens[end - 1].end]


def sentences(text: str, start: int = 0) -> list[tuple[int, int]]:
    """Token ranges of sentences from token `start` on, which may lie inside one.

    A sentence ends after . ? ! unless that completes an abbreviation, where the next line starts with an upper-case letter, and
    with the last token.
    """
    last = np.flatnonzero(scan([text]).last) + 1
    if start > (last[-1] if len(last) else 0):
        raise InvalidInputError(f"Start token {start} is out of bounds for {last[-1] if len(last) else 0} tokens")
    ends = last[last > start].tolist()
    return list(zip([start, *ends[:-1]], ends, strict=True)) if ends else []


def pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(row of the first, texts) in slices of about AT_ONCE code points; a null is an empty text."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        if held and size + len(t) > AT_ONCE:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def over_texts(docs: DataFrame, id_col: str, text_col: str, make, schema: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """Output rows from make(texts) -> (number of its text for each row, columns), with the document's id before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in pieces(b.column(1)):
                of, cols = make(texts)
                cols = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of + first)), *cols], [id_col, *(n for n, _ in schema)])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {ddl}")


def _within(text: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal numbers."""
    head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    return np.arange(len(text)) - np.repeat(head, np.diff(np.r_[head, len(text)]))


def _cut(texts: list[str], of: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([texts[i][a:b] for i, a, b in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string())


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, token_index, token_type, token_text, start_pos, end_pos, first_token_after_newline); with_text=False: no token_text."""

    def make(texts: list[str]):
        s = scan(texts)
        cols = [_within(s.text), pa.array(KINDS).take(pa.array(s.kind)), s.start, s.end, s.newline]
        return s.text, [*cols[:2], *([_cut(texts, s.text, s.start, s.end)] if with_text else []), *cols[2:]]

    schema = [("token_index", pa.int32()), ("token_type", pa.string()), *([("token_text", pa.string())] if with_text else []), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("first_token_after_newline", pa.bool_())]
    return over_texts(docs, id_col, text_col, make, schema, f"token_index int, token_type string, {'token_text string, ' if with_text else ''}start_pos bigint, end_pos bigint, first_token_after_newline boolean")


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_index, token_start, token_end, start_pos, end_pos, text)."""

    def make(texts: list[str]):
        s = scan(texts)
        b = np.flatnonzero(s.last)
        a = np.r_[0, b[:-1] + 1] if len(b) else b
        of, i = s.text[a], _within(s.text)
        return of, [_within(of), i[a], i[b] + 1, s.start[a], s.end[b], _cut(texts, of, s.start[a], s.end[b])]

    schema = [("sentence_index", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("text", pa.string())]
    return over_texts(docs, id_col, text_col, make, schema, "sentence_index int, token_start int, token_end int, start_pos bigint, end_pos bigint, text string")


def listed(column: pa.Array) -> pa.Array:
    """For each text the list of its tokens (token_text, token_type, start_pos, end_pos); many short texts are one scan."""
    names, lists = ["token_text", "token_type", "start_pos", "end_pos"], []
    for _, texts in pieces(column):
        s = scan(texts)
        cols = [_cut(texts, s.text, s.start, s.end), pa.array(KINDS).take(pa.array(s.kind)), pa.array(s.start, pa.int64()), pa.array(s.end, pa.int64())]
        first = np.searchsorted(s.text, np.arange(len(texts) + 1)).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(cols, names)))
    none = pa.array([], pa.list_(pa.struct([("token_text", pa.string()), ("token_type", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])))
    return pa.concat_arrays(lists) if lists else none
