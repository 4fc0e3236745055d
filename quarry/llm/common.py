"""What the operators of this subpackage share: written tables, names that are free, and whole groups out of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.materialise import materialised as written

__all__ = ["fresh", "text_key", "tiled", "union_roots", "whole_groups", "written"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, lengthened where df has such columns (Spark's names know no case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_key(text: Column) -> Column:
    """A hash that stands for a whole text."""
    return F.xxhash64(text, F.length(text))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about `rows` rows at least, from batches sorted by the integer columns `keys`.

    No group is ever cut, so callers bound the size of one group before they sort.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(t.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if len(at):
            cut = int(at[-1]) + 1
            yield t.slice(0, cut)
            t = t.slice(cut)
        held = t.to_batches()
        n = t.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def union_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest position that the pairs (a, b) connect it with."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def tiled(rows: DataFrame, keys: list[str], identity: str, most: int) -> DataFrame:
    """Splits each group of more than `most` rows into segments, and deals every two segments to a tile of their own.

    Adds seg, tile_i, tile_j. Any two rows of a group meet in some tile (two of one segment in the tile of that segment with
    itself), and no tile holds more than about 2 * most rows however large the group. A group of g rows is copied g / most times.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    parts = sizes.select(*keys, F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_s"))
    seg = F.pmod(F.xxhash64(F.lit(11), F.col(identity)), F.col("_s")).cast("int")
    x = rows.join(parts, keys, "left").withColumn("_s", F.coalesce("_s", F.lit(1))).withColumn("seg", seg)
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return x.withColumn("tile_i", F.least("seg", "_o")).withColumn("tile_j", F.greatest("seg", "_o")).drop("_o", "_s")
