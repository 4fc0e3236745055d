"""Vector code compression: codebooks for the parts of vectors, learned by filtering Lloyd rounds over kd-trees."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarry.llm.common import written

#: Vectors whose trees are built together, vectors in a leaf, distances held at once.
BLOCK, LEAF, AT_ONCE = 1 << 14, 16, 1 << 21
#: Numbers that all codebooks may hold together, as they are gathered on the driver and sent to every worker.
MOST_NUMBERS = 1 << 24
#: A label with more than this share of all rows is hot; there can be no more than 1 / HOT such labels.
HOT = 1e-4


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256

    def __post_init__(self):
        if not 1 <= self.entries <= 256 or self.parts < 1 or self.rounds < 0:
            raise ValueError("codes have two hexadecimal digits for each part")


def widths(length: int, parts: int) -> list[int]:
    """How many components each part of a vector of this length has: equal, or the first ones one more."""
    return [length // parts + (k < length % parts) for k in range(parts)]


def parted(x: np.ndarray, parts: int) -> np.ndarray:
    """(vectors, length) as (parts, vectors, width), short parts filled with zeros, which change no distance."""
    w = widths(x.shape[1], parts)
    out = np.zeros((parts, len(x), max(w)), np.int64)
    at = 0
    for k, n in enumerate(w):
        out[k, :, :n] = x[:, at : at + n]
        at += n
    return out


def integers(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the column's usable vectors: their places and floor(scale * component).

    Vectors that are null or hold null or non-finite components are not usable. Components beyond what squared distances of
    64 bits can hold (hundreds of thousands at usual lengths) are cut to it.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    good = (size >= 0) & (np.bincount(row, ~np.isfinite(flat), len(size)) == 0)
    for n in np.unique(size[good]):
        at = np.flatnonzero(good & (size == n))
        most = math.isqrt((1 << 59) // max(1, int(n)))
        with np.errstate(over="ignore"):
            x = np.floor(flat[(good & (size == n))[row]] * scale)
        yield at, np.clip(x, -most, most).astype(np.int64).reshape(len(at), int(n))


class Trees:
    """A kd-tree for each part of a block of vectors: x is (parts, vectors, width).

    Trees are balanced, so node k of a level stands for the same stretch of each part's order. Every node has its bounding
    box and the sum and count of its vectors.
    """

    def __init__(self, x: np.ndarray):
        parts, n, width = x.shape
        depth = max(0, math.ceil(math.log2(n / LEAF)))
        self.bounds = [n * np.arange((1 << k) + 1) // (1 << k) for k in range(depth + 1)]
        self.order = np.tile(np.arange(n), (parts, 1))
        self.low, self.high, self.sums = [], [], []
        for k, b in enumerate(self.bounds):
            self.x = np.take_along_axis(x, self.order[:, :, None], 1)
            self.low.append(np.minimum.reduceat(self.x, b[:-1], axis=1))
            self.high.append(np.maximum.reduceat(self.x, b[:-1], axis=1))
            self.sums.append(np.add.reduceat(self.x, b[:-1], axis=1))
            if k < depth and width:  # each node's vectors by its widest side; the next level's bounds cut them in the middle
                side = np.repeat((self.high[-1] - self.low[-1]).argmax(axis=2), np.diff(b), axis=1)
                value = np.take_along_axis(self.x, side[:, :, None], 2)[:, :, 0]
                node = np.repeat(np.arange(len(b) - 1), np.diff(b))
                place = np.argsort((node << 32) + (value - value.min()), axis=1)
                self.order = np.take_along_axis(self.order, place, 1)

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, sums, counts) for codebooks (parts, entries, width): each part's nearest entry, of equal ones the first.

        From the roots down, a node keeps those entries that may be the nearest of some vector in its box. The entry nearest to the
        box's middle rules out each one that is further from the box's corner most in its favour (at equal distance: that comes
        later in the book). A node with one entry left is assigned whole; leaves compare their vectors with the entries left.
        """
        parts, entries, width = books.shape
        norm = (books**2).sum(axis=2)
        codes = np.zeros(self.order.shape, np.int64)
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        part, node = np.arange(parts), np.zeros(parts, np.int64)
        may = np.ones((parts, entries), bool)
        every = np.arange(entries)
        for k, b in enumerate(self.bounds):
            low, high = self.low[k][part, node], self.high[k][part, node]
            far = np.zeros(may.shape, np.int64)
            for d in range(width):
                far += ((low + high)[:, d, None] - 2 * books[part, :, d]) ** 2
            best = np.where(may, far, np.iinfo(np.int64).max).argmin(axis=1)
            gap = norm[part] - norm[part, best][:, None]
            for d in range(width):
                way = books[part, :, d] - books[part, best, d][:, None]
                gap -= 2 * way * np.where(way > 0, high[:, d, None], low[:, d, None])
            may &= ~((gap > 0) | ((gap == 0) & (every > best[:, None])))
            whole = may.sum(axis=1) == 1
            p, n, c = part[whole], node[whole], best[whole]
            np.add.at(sums, (p, c), self.sums[k][p, n])
            np.add.at(counts, (p, c), b[n + 1] - b[n])
            for q, m, e in zip(p.tolist(), n.tolist(), c.tolist(), strict=True):
                codes[q, b[m] : b[m + 1]] = e
            part, node, may = part[~whole], node[~whole], may[~whole]
            if k + 1 < len(self.bounds):
                part, node, may = np.repeat(part, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(may, 2, axis=0)
        self._leaves(part, node, may, books, codes, sums, counts)
        out = np.empty_like(codes)
        np.put_along_axis(out, self.order, codes, 1)
        return out, sums, counts

    def _leaves(self, part: np.ndarray, node: np.ndarray, may: np.ndarray, books: np.ndarray, codes: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Compares the vectors of undecided leaves with their entries left, leaves with like many entries together."""
        b, n = self.bounds[-1], codes.shape[1]
        left = may.sum(axis=1)
        by = np.argsort(left, kind="stable")
        size = int(np.diff(b).max())
        lo = 0
        while lo < len(by):
            hi = min(len(by), lo + max(1, AT_ONCE // (size * int(left[by[lo : lo + AT_ONCE // size]].max()))))
            rows = by[lo:hi]
            m = int(left[rows].max())
            entry = np.argsort(~may[rows], axis=1, kind="stable")[:, :m]  # those left, in their order
            at = b[node[rows]][:, None] + np.arange(size)
            inside = at < b[node[rows] + 1][:, None]
            at = np.minimum(at, n - 1)
            p = part[rows][:, None]
            far = np.zeros((len(rows), size, m), np.int64)
            for d in range(books.shape[2]):
                far += (self.x[p, at, d][:, :, None] - books[p, entry, d][:, None, :]) ** 2
            far[np.broadcast_to(~np.take_along_axis(may[rows], entry, 1)[:, None, :], far.shape)] = np.iinfo(np.int64).max
            code = np.take_along_axis(entry, far.argmin(axis=2), 1)
            p = np.broadcast_to(p, at.shape)[inside]
            codes[p, at[inside]] = code[inside]
            np.add.at(sums, (p, code[inside]), self.x[p, at[inside]])
            np.add.at(counts, (p, code[inside]), 1)
            lo = hi


#: Codebooks (parts, entries, width) by the length of the vectors.
Books = dict[int, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together or cut to blocks of about BLOCK rows."""
    held, n = [], 0
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            held.append(b.slice(lo, BLOCK))
            n += held[-1].num_rows
            if n >= BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def first_books(d: DataFrame, s: Settings) -> Books:
    """For each length the parts of the vectors with the smallest ids; null ids come last, vectors of one id by their components."""
    kind = StructType([d.schema["vec_id"], *StructType.fromDDL("length int, x array<long>")])

    def smallest(held: list[tuple]) -> list[tuple]:
        held.sort(key=lambda r: (r[1], r[0] is None, r[0] if r[0] is not None else 0, r[2]))
        out, n, length = [], 0, None
        for r in held:
            n, length = (n + 1 if r[1] == length else 1), r[1]
            if n <= s.entries:
                out.append(r)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for t in _blocks(batches):
            names = t.column("vec_id").combine_chunks()
            for at, x in integers(t.column("embedding"), s.scale):
                ids = names.take(pa.array(at))
                order = pc.sort_indices(ids)  # nulls last
                n = min(s.entries, len(at))
                while n < len(at) and ids[order[n].as_py()].as_py() == ids[order[n - 1].as_py()].as_py():
                    n += 1
                keep = order[:n].to_numpy()
                held += zip(ids.take(pa.array(keep)).to_pylist(), [x.shape[1]] * len(keep), x[keep].tolist(), strict=True)
            held = smallest(held)
        cols = list(zip(*held, strict=True)) or [[], [], []]
        kinds = (to_arrow_type(kind["vec_id"].dataType), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], kind.names)

    rows = d.select("vec_id", "embedding").mapInArrow(run, kind).withColumn("salt", F.pmod(F.xxhash64("vec_id", "x"), F.lit(1024)))
    for keys in (["length", "salt"], ["length"]):  # in two steps, so that no task orders the rows of all partitions
        w = Window.partitionBy(*keys).orderBy(F.col("vec_id").asc_nulls_last(), "x")
        rows = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= s.entries)
    rows = written(rows.select("length", "k", "x"), "first-entries")
    if (rows.agg(F.sum("length")).first()[0] or 0) > MOST_NUMBERS:
        raise ValueError("codebooks for so many lengths of vectors do not fit the driver")
    by: dict[int, list] = {}
    for r in rows.orderBy("length", "k").collect():
        by.setdefault(r["length"], []).append(r["x"])
    return {n: parted(np.array(x, np.int64).reshape(len(x), n), s.parts) for n, x in by.items()}


def moved(d: DataFrame, books: Books, s: Settings) -> Books:
    """One Lloyd round: every partition adds up the parts nearest to each entry, and entries become floor(sum / count)."""
    sent = d.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for t in _blocks(batches):
            for _, x in integers(t.column("embedding"), s.scale):
                book = sent.value[x.shape[1]]
                _, sums, counts = Trees(parted(x, s.parts)).assign(book)
                have = total.setdefault(x.shape[1], [np.zeros_like(sums), np.zeros_like(counts)])
                have[0] += sums
                have[1] += counts
        for n, (sums, counts) in total.items():
            p, e = np.nonzero(counts)
            at = np.tile(np.arange(sums.shape[2]), len(p))
            w = sums.shape[2]
            cols = (np.full(len(at), n), np.repeat(p, w), np.repeat(e, w), at, sums[p, e].ravel(), np.repeat(counts[p, e], w))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["length", "part", "entry", "at", "total", "many"])

    rows = d.select("embedding").mapInArrow(run, "length long, part long, entry long, at long, total long, many long")
    new = {n: b.copy() for n, b in books.items()}
    for r in rows.groupBy("length", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("many").alias("many")).collect():
        new[r["length"]][r["part"], r["entry"], r["at"]] = r["total"] // r["many"]
    return new


def books_text(book: np.ndarray, length: int) -> str:
    """All components of a codebook by part, entry and place."""
    return ",".join(str(v) for p, w in zip(book, widths(length, len(book)), strict=True) for e in p for v in e[:w].tolist())


def learn_books(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> Books:
    """Codebooks after s.rounds Lloyd rounds over all usable vectors."""
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    books = first_books(d, s)
    for _ in range(s.rounds if books else 0):
        books = moved(d, books, s)
    return books


def encode(vectors: DataFrame, books: Books, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of each usable vector by given codebooks; narrow."""
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    kind = StructType([d.schema["vec_id"], d.schema["label"], *StructType.fromDDL("code string, error long, codebooks_sha256 string")])
    named = {n: hashlib.sha256(books_text(b, n).encode()).hexdigest() for n, b in books.items()}
    sent = d.sparkSession.sparkContext.broadcast((books, named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, named = sent.value
        for t in _blocks(batches):
            for at, x in integers(t.column("embedding"), s.scale):
                if x.shape[1] not in books:
                    raise ValueError(f"no codebook for vectors of {x.shape[1]} components")
                book, x3 = books[x.shape[1]], parted(x, s.parts)
                codes, _, _ = Trees(x3).assign(book)
                error = ((x3 - np.take_along_axis(book, codes[:, :, None], 1)) ** 2).sum(axis=(0, 2))
                text = codes.T.astype(np.uint8).tobytes().hex()
                step = 2 * s.parts
                take = pa.array(at)
                cols = [*(t.column(c).combine_chunks().take(take) for c in ("vec_id", "label")), pa.array([text[k : k + step] for k in range(0, len(text), step)]), pa.array(error), pa.array([named[x.shape[1]]] * len(at))]
                yield pa.RecordBatch.from_arrays(cols, kind.names)

    return d.mapInArrow(run, kind)


def with_label_errors(scored: DataFrame) -> DataFrame:
    """scored, a written table, with label_error: error summed over equal labels, nulls together.

    Sums are made before anything is shuffled. Labels with over HOT of all rows are broadcast, being 1 / HOT at most; the rows
    of the others are joined by label, of which none has many.
    """
    sums = written(scored.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    n = sums.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("labels")).first()
    hot = sums.filter(F.col("_n") > HOT * (n["rows"] or 0)).select(F.col("label").alias("_l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_l"))
    out = scored.join(F.broadcast(hot), same).drop("_l")
    if hot.count() < n["labels"]:
        rest = sums.filter(F.col("_n") <= HOT * n["rows"]).select(F.col("label").alias("_l"), "label_error")
        out = out.unionByName(scored.join(F.broadcast(hot), same, "left_anti").join(rest, same).drop("_l"))
    return out


def compress_vectors(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): product codes of all usable vectors and what they lose.

    Rows whose vector is null or holds null or non-finite components are dropped. Components become floor(scale * x), vectors are cut
    into s.parts parts (equal ones, or the first one longer), each part's codebook starts with that part of the s.entries
    smallest ids, and s.rounds rounds move the entries. Each round reads the vectors anew and shuffles only the entries' sums,
    one set for each partition; codebooks are all that reaches the driver. Vectors of different lengths have codebooks of their
    own. With fewer vectors than entries there are fewer entries; vectors without components have code zero and no error. Ids and
    labels of any type and nulls are handed through, null ids being the largest; repeated rows count each.
    """
    books = learn_books(vectors, s, id_col, vector_col)
    return with_label_errors(written(encode(vectors, books, s, id_col, vector_col, label_col), "vector-codes"))


def decode(encoded: DataFrame, books: Books, length: int, s: Settings = Settings(), code_col: str = "code") -> DataFrame:
    """encoded with `vector`: what the codes stand for, in the vectors' own scale (a component's cell by its lower end)."""
    w = widths(length, s.parts)
    table = [[[v / s.scale for v in e[:n].tolist()] for e in p] for p, n in zip(books[length], w, strict=True)]
    book = F.from_json(F.lit(json.dumps(table)), "array<array<array<double>>>")
    entry = lambda k: F.conv(F.substring(F.col(code_col), 2 * k + 1, 2), 16, 10).cast("int")
    return encoded.withColumn("vector", F.flatten(F.array(*(F.get(F.get(book, F.lit(k)), entry(k)) for k in range(s.parts)))))
