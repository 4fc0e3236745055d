"""Periodic runs of words: a harmonic grid of (period, place) pairs whose common extensions are found by prefix hashes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The prime of the prefix hashes; pairs of the grid looked at together; bytes of texts whose words are held together.
PRIME, AT_ONCE, BYTES = (1 << 31) - 1, 1 << 20, 4 << 20

#: Changes a document's words before they are searched: (id, words) -> words.
Edit = Callable[[object, list[bytes]], list[bytes]]


class Prefixes:
    """Prefix hashes of a sequence of numbers, modulo PRIME in two bases. Equal stretches have equal hashes, always."""

    def __init__(self, ids: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        self.power, self.sums = [], []
        for base in r.integers(1 << 20, PRIME - 1, 2):
            p = np.ones(1, np.int64)
            while len(p) < len(ids):  # doubling: the second half is the first times base ** half
                p = np.r_[p, p * (int(p[-1]) * int(base) % PRIME) % PRIME]
            p = p[: len(ids)]
            self.power.append(p)
            self.sums.append(np.r_[0, np.cumsum((ids + 1) * p % PRIME) % PRIME])

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n numbers from i and from j (i < j) have one hash."""
        out = np.ones(len(i), bool)
        for p, s in zip(self.power, self.sums, strict=True):
            out &= (s[i + n] - s[i]) % PRIME * p[j - i] % PRIME == (s[j + n] - s[j]) % PRIME
        return out

    def extend(self, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For all pairs at once: how far the stretches from i and j on agree, and those that end before i and j (most at most)."""
        n, ahead, back = len(self.power[0]), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bit in reversed(range(most.bit_length())):
            more = ahead + (1 << bit)
            at = np.flatnonzero(j + more <= n)
            at = at[self.equal(i[at], j[at], more[at])]
            ahead[at] = more[at]
            more = back + (1 << bit)
            at = np.flatnonzero(i - more >= 0)
            at = at[self.equal(i[at] - more[at], j[at] - more[at], more[at])]
            back[at] = more[at]
        return ahead, back


def _found(ids: np.ndarray, h: Prefixes, longest: int, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of stretches with the period, of max(least, times * period) numbers or more."""
    n = len(ids)
    period = np.arange(1, longest // times + 1)
    step = np.maximum(least, times * period) - period
    many = np.maximum(0, (n - period - 1) // step + 1)
    upto = np.r_[0, np.cumsum(many)]
    out, lo = [np.zeros((0, 3), np.int64)], 0
    while lo < len(period):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + AT_ONCE, "right")) - 1)
        which = np.repeat(np.arange(lo, hi), many[lo:hi])
        i, p = (np.arange(upto[lo], upto[hi]) - upto[which]) * step[which], period[which]
        same = np.flatnonzero(ids[i] == ids[i + p])
        i, p = i[same], p[same]
        ahead, back = h.extend(i, i + p, longest)
        rows = np.stack([i - back, i + p + ahead, p], 1)
        out.append(np.unique(rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, times * p)], axis=0))
        lo = hi
    return np.concatenate(out)


def runs_of(ids: np.ndarray, longest: int, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, end, period), by start, then period: every maximal run of ids with its smallest period and at least
    max(least, times * period) numbers, exactly.

    Sequences are laid end to end with a number of its own after each, so that no run crosses; longest is the longest one's length.
    A stretch of such a run where ids[i] = ids[i + p] is at least max(least, times * p) - p long and so holds a multiple of that:
    the harmonic grid, n / 2 * log(n) pairs at most. Found runs are compared number by number, and a found period of a
    run must be a multiple of its smallest (it is, as times >= 2); should a hash ever have lied, other bases are taken.
    """
    if longest < least:
        return np.zeros((0, 3), np.int64)
    for seed in range(64):
        rows = _found(ids, Prefixes(ids, seed), longest, least, times)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]
        smallest = rows[new][np.cumsum(new) - 1, 2]
        best = rows[new]
        if (rows[:, 2] % smallest == 0).all() and all(np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in best):
            return best[np.lexsort((best[:, 2], best[:, 0]))]
    raise ArithmeticError("prefix hashes of 64 pairs of bases collided")


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run (start, end, period) contains after its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]), strict=True) if not g]


def _several(lists: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """Runs of each list of words, by one search over all of them."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    long = [k for k, w in enumerate(lists) if len(w) >= least]
    out = [np.zeros((0, 3), np.int64)] * len(lists)
    if not long:
        return out
    ids = [np.fromiter(map(number.__getitem__, lists[k]), np.int64, len(lists[k])) for k in long]
    ends = np.cumsum([len(x) + 1 for x in ids])
    laid = np.concatenate([v for k, x in enumerate(ids) for v in (x, [len(number) + k])])
    rows = runs_of(laid, max(map(len, ids)), least, times)
    cut = np.r_[0, np.searchsorted(rows[:, 0], ends)]  # rows are by start
    for at, k in enumerate(long):
        out[k] = rows[cut[at] : cut[at + 1]] - [[ends[at] - len(ids[at]) - 1] * 2 + [0]]
    return out


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, edit: Edit | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the maximal periodic runs of every row's whole text and the text without their repeats.

    Words are what stands between spaces and \\t to \\r, numbered from 0. runs has (start, length, period) by start, then period, of
    every run of at least max(least, times * period) words, times being 2 or more; collapsed has the words that no run contains
    after its first period, joined by one space. Null and empty texts have no words and an empty text; repeated rows give repeated
    results; ids of any type, nulls too, are handed through. Narrow: no row is shuffled, and texts are taken up together only
    up to BYTES, a longer text alone.
    """
    if times < 2 or least < 2:
        raise ValueError("runs of less than two periods or words are not defined here")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = "array<struct<start: bigint, length: bigint, period: bigint>>"
    schema = StructType([d.schema["doc_id"], *StructType.fromDDL(f"n_words long, runs {spans}, collapsed string")])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BYTES, "right")))
                part = b.slice(lo, hi - lo)
                lo = hi
                words = [t.split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                if edit:
                    words = [edit(i, w) for i, w in zip(part.column(0).to_pylist(), words, strict=True)]
                found = _several(words, least, times)
                flat = np.concatenate(found)
                item = pa.StructArray.from_arrays([pa.array(x) for x in (flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2])], [f.name for f in kind.value_type])
                runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), item)
                kept = pa.array([b" ".join(collapsed(w, x)) for w, x in zip(words, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), runs, kept], schema.names)

    return d.mapInArrow(run, schema)


def most_repeated(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """One row for each of find_runs(): number of runs, the most repeated one, digests of all runs and of the collapsed text."""
    said = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    best = found.withColumn("best", most_repeated(F.col("runs")))
    milli = F.expr("best.length * 1000 div best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        milli.alias("exponent_milli"), sha(said).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
