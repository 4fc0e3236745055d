"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tiled, union_roots, whole_groups, written
from quarry.llm.graph import components

#: Shingles hashed at once, children of an index node, rows of a tile, and pairs looked at in one step.
AT_ONCE, FAN, TILE, PAIRS = 1 << 16, 16, 4096, 1 << 20


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included; bit set where over half of the hashes have it."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    if not found:
        return 0
    joined = np.frombuffer(line := b" ".join(found), np.uint8)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    digest, n = xxhash.xxh64_digest, len(found) - words + 1
    gap = np.flatnonzero(joined == 32)
    starts, ends = np.r_[0, gap + 1], np.r_[gap, len(joined)]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        to = min(n, at + AT_ONCE)
        spans = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)
        ones += set_bits(b"".join([digest(line[s:e], seed) for s, e in spans]))
    return majority(ones, n)


def set_bits(hashes: bytes) -> np.ndarray:
    """How many of the big-endian 64-bit hashes have each bit, the highest bit first."""
    return np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64))], ["doc_id", "fp"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """A tree over fingerprints sorted by (group, Gray rank): every node keeps the bits that all below it share.

    An upper node holds the shared bits as (mask, pattern); a lower node adds only bits that its parent lacks. A search walks
    from a group's root with the differences found so far and leaves a whole subtree once they exceed the radius.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), group))
        self.fp, g = fp[self.order], group[self.order]
        self.levels = []  # from the leaves' parents up: (mask, pattern, first child, end of children)
        every, some, owner = self.fp, self.fp, g
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            first = np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            cut = np.flatnonzero((np.arange(len(owner)) - first) % FAN == 0)
            every, some = np.bitwise_and.reduceat(every, cut), np.bitwise_or.reduceat(some, cut)
            mask = ~(every ^ some)
            self.levels.append((mask, every & mask, cut, np.r_[cut[1:], len(owner)]))
            owner = owner[cut]
            if len(np.unique(owner)) == len(owner):
                break
        self.root_of = np.searchsorted(owner, g)

    def uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """For every node the root that all rows below it have, or -1."""
        out, x = [], root
        for _, _, cut, _ in self.levels:
            lo, hi = np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)
            x = np.where((lo == hi) & (lo >= 0), lo, -1)
            out.append(x)
        return out

    def search(self, rows: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, other row of its group) within the radius; what is all connected with the row already is left out."""
        alike = self.uniform(root)
        q, node, gone = rows, self.root_of[rows], np.zeros(len(rows), np.int64)
        above = np.zeros(len(rows), np.uint64)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern, first, end = self.levels[level]
            gone = gone + np.bitwise_count((self.fp[q] ^ pattern[node]) & (mask[node] & ~above))
            keep = (gone <= radius) & (alike[level][node] != root[q])
            q, node, gone = q[keep], node[keep], gone[keep]
            above = mask[node]
            many = end[node] - first[node]
            at = np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            q, node, gone, above = np.repeat(q, many), at, np.repeat(gone, many), np.repeat(above, many)
        near = (gone + np.bitwise_count((self.fp[q] ^ self.fp[node]) & ~above) <= radius) & (root[node] != root[q])
        return q[near], node[near]


def connect(group: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For each row the position of one row of its connected part within its group (links: distance <= radius)."""
    index = GrayIndex(group, fp)
    n = len(fp)
    root = np.arange(n)
    size = np.bincount(index.root_of)[index.root_of]
    work = np.flatnonzero(size > 1)
    step = np.cumsum(size[work] + 64) // PAIRS
    for k in range(int(step[-1]) + 1 if len(work) else 0):
        a, b = index.search(work[step == k], root, radius)
        root = union_roots(n, np.r_[np.arange(n), a], np.r_[root, b])
    out = np.empty(n, np.int64)
    out[index.order] = index.order[root]
    return out


def blocks_for(nodes: int, radius: int) -> int:
    """How many blocks the bits are cut into: the fewest for which a table's buckets hold about 1000 of `nodes` at most."""
    b = radius + 1
    while nodes >> (64 * (b - radius) // b) > 1000 and b < 4 * (radius + 1):
        b += 1
    return b


def linked(nodes: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(a, b): a spanning forest of the links (at most `radius` differing bits) between the distinct fingerprints `fp` of nodes.

    Two fingerprints within the radius agree on all but `radius` of any blocks of bits, so one table for each choice of
    `blocks` - radius blocks (None: as many as the number of nodes asks for) has them in one bucket. A bucket of more than TILE
    nodes is dealt to tiles (common.tiled), so no task holds it whole; each tile searches its own index. The links found do
    not depend on the number of blocks.
    """
    blocks = blocks or blocks_for(nodes.count(), radius)
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    edges = [(64 * k // blocks, 64 * (k + 1) // blocks) for k in range(blocks)]
    masks = [sum(((1 << hi - lo) - 1) << 64 - hi for lo, hi in chosen) for chosen in combinations(edges, blocks - radius)]
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))
    names = ["t", "v", "tile_i", "tile_j"]
    rows = tiled(nodes.select("fp", F.posexplode(keys).alias("t", "v")), names[:2], "fp", TILE)
    rows = rows.select(F.xxhash64(*names).alias("key"), *names, "fp").repartition("key").sortWithinPartitions("key", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", *names], 1 << 15):
            fp = t.column("fp").to_numpy().view(np.uint64)
            change = reduce(np.logical_or, (np.r_[False, x[1:] != x[:-1]] for x in (t.column(c).to_numpy() for c in ("key", *names))))
            root = connect(np.cumsum(change), fp, radius)
            at = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[root[at]].view(np.int64))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints differ in at most `radius` bits are linked.

    Equal fingerprints are one node from the start, aggregated before the shuffle. linked() gives a spanning forest, never all
    pairs, through Gray-order indexes; graph.components joins its parts.

    Nulls: a null text has no words (fingerprint zero, linked like any other); a row without id gets the component of its
    fingerprint, null if no row with an id is in it. Rows with one id and several texts keep one row each and do not join their
    texts' groups. An empty table gives no rows.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    fps = written(fingerprints(docs, words, id_col, text_col), "fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    groups = components(linked(nodes, radius, blocks))
    joined = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(nodes["fp"], nodes["node"], F.coalesce("component", nodes["fp"]).alias("c"))
    least = joined.groupBy("c").agg(F.min("node").alias("component_id"))
    found = joined.join(least, "c").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
