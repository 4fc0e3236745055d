"""Token counts of a byte-level BPE vocabulary without making token identifiers."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Fixed values of the vocabulary's pre-tokenizer: white space, below U+0250 and beyond.
SPACE, SPACE_BEYOND = "\\t-\\r \\x85\\xa0", "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces whose counts a worker remembers, and the longest text whose pieces are held at once.
REMEMBERED, AT_ONCE = 1 << 20, 1 << 20


def _ranges(kind: str, stop: int) -> str:
    """The code points below stop of a Unicode category as the inside of a character class."""
    every = "".join(map(chr, [*range(min(stop, 0xD800)), *range(0xE000, stop)]))
    out = []
    for m in regex.finditer(rf"\p{{{kind}}}+", every):
        s = m.group()
        start = 0
        for i in range(1, len(s) + 1):
            if i == len(s) or ord(s[i]) != ord(s[i - 1]) + 1:
                out.append(re.escape(s[start]) + ("-" + re.escape(s[i - 1]) if i - start > 1 else ""))
                start = i
    return "".join(out)


@lru_cache(2)
def pieces(latin: bool) -> re.Pattern:
    """The pre-tokenizer's pattern, with the small classes that suffice for a text without characters from U+0250 on."""
    stop, space = (0x250, SPACE) if latin else (0x110000, SPACE + SPACE_BEYOND)
    letter, number = _ranges("L", stop), _ranges("N", stop)
    return re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Piece of text -> number of its tokens; a bounded memory of answers that computes missing ones."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        number = model["vocab"]
        #: (left symbol, right symbol) as one number -> (rank, symbol of both)
        self.join = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.join[number[left] << 20 | number[right]] = (rank, number[left + right])
        self.first = [number[x] for x in _byte_letters()]
        special = [re.escape(x["content"]) for x in told["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None

    def merged(self, data: bytes) -> int:
        """Initial symbols minus merges: symbols are a doubly linked list, candidate pairs a heap by rank, then place."""
        n = len(data)
        if n < 2:
            return n
        join = self.join
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := join.get(symbol[i] << 20 | symbol[i + 1]):
                heap.append((hit[0], i, symbol[i], symbol[i + 1], hit[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, both = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbol[i], symbol[j] = both, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := join.get(both << 20 | symbol[k]):
                    heapq.heappush(heap, (hit[0], i, both, symbol[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := join.get(symbol[h] << 20 | both)):
                heapq.heappush(heap, (hit[0], h, symbol[h], both, hit[1]))
        return n - merges

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode())
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            found = pieces(not BEYOND_LATIN.search(part))
            if len(part) <= AT_ONCE:
                total += sum(map(self.__getitem__, found.findall(part)))
            else:
                total += sum(self[m.group()] for m in found.finditer(part))
        return total


@lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text; a narrow transformation, no shuffle.

    vocabulary: a path that every executor can read (a public tokenizer's file, installed beside Python). A null text counts
    as empty: 0 bytes, 0 tokens. Rows with a null or repeated id are counted like any other. Strings of added special tokens
    in a text count 1 each, as that library does by default. Other columns are not read.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            ids, texts = b.columns
            n = pa.array([c.count(x.as_py()) for x in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
