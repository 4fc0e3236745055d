"""Sizes of any part of a text in BPE tokens, without counting it anew."""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import regex
import tiktoken

#: Fixed value: how byte-level vocabularies cut texts into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces whose counts a worker remembers.
REMEMBERED = 1 << 18

Sizer = Callable[[int, int], int]


@lru_cache(2)
def _vocabulary(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("sizes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), {}


@lru_cache(2)
def _pattern() -> regex.Pattern:
    return regex.compile(PIECES)


def count(text: str, path: str) -> int:
    """Tokens of a whole text by a vocabulary of ranks; special strings are ordinary text."""
    return len(_vocabulary(path)[0].encode_ordinary(text))


def sizer(text: str, path: str) -> Sizer:
    """size(a, b): the tokens of text[a:b], as count() gives them, for any a and b.

    The text is cut into pieces once, and their counts are summed up along it. A part has the same pieces as the whole text but for its
    first ones, until a piece ends where one of the text does, and its last two, as blanks at an end are cut otherwise. Only
    those are looked at, so a bisection costs no recount.
    """
    encoding, known = _vocabulary(path)
    pattern = _pattern()

    def of(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            n = len(encoding.encode_ordinary(piece))
            if len(known) < REMEMBERED and len(piece) < 64:
                known[piece] = n
        return n

    cuts = [m.span() for m in pattern.finditer(text)]
    ends = [e for _, e in cuts]
    upto = [0, *accumulate(of(text[s:e]) for s, e in cuts)]

    def size(a: int, b: int) -> int:
        # the pieces before `stop` end at least two pieces before b does, and so do not see the end
        stop = max(0, bisect_right(ends, b) - 2)
        out, at = 0, a
        while at < b:
            k = bisect_left(ends, at)
            if k < stop and at == (ends[k - 1] if k else 0) or k < stop and ends[k] == at:
                k += ends[k] == at
                if k < stop:
                    out += upto[stop] - upto[k]
                    at = ends[stop - 1]
                    continue
            m = pattern.match(text, at, b)
            out += of(m.group())
            at = m.end()
        return out

    return size
