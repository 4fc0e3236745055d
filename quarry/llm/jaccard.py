"""Near-duplicates of a Jaccard similarity: SimHash fingerprints through the Gray-order index, each link verified by the whole
shingle sets, and a prefix filter for the links between fingerprints that are further apart."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import fresh, text_key, tiled, whole_groups, written
from quarry.llm.graph import components
from quarry.llm.simhash import linked, majority, set_bits
from quarry.plans.materialise import settled

log = logging.getLogger("quarry")
#: Rows of a tile, rows compared at once, words of a parity bitmap, documents and shingles that the order is learned from.
TILE, STEP, WORDS, SAMPLE, COMMON = 1024, 128, 6, 8192, 1 << 17
#: Pairs whose large bitmaps are compared at once.
AT_ONCE = 1 << 20
#: Up to so many texts are asked for by a broadcast of their keys, more by a shuffle.
ASKED = 1 << 21


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles; a text of at most `words` words is one shingle."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1][: max(1, len(found) - words + 1)]
    spans = zip(starts.tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(line[s:e], seed) for s, e in spans], np.uint64))


def parity(s: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` classes hold an odd number of shingles; two sets differ in at least as many shingles as bits."""
    odd = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def wide(s: np.ndarray) -> bytes:
    """A parity bitmap of at least as many bits as shingles, a power of two."""
    return parity(s, max(64, 1 << int(len(s) - 1).bit_length())).tobytes()


def close(a: bytes, b: bytes, n: int, m: int, least: float) -> bool:
    """Whether sets of n and m shingles with these wide() bitmaps can be `least` alike; never false where they are."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) > len(y):  # the parity of half as many classes
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (n + m) * ((1 - least) / (1 + least)) + 1e-9


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The first shingles in an order of all shingles (`common` last, by rank): sets at least `least` alike share one of them.
    With it, how many of them are not common; those stand first."""
    if not len(s):
        return s, 0
    at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
    last = np.where(common[at] == s, rank[at], 0) if len(common) else np.zeros(len(s), np.int64)
    first = s[np.lexsort((s, last))][: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]
    return first, min(len(first), int((last == 0).sum()))


def alike(n: np.ndarray, bits: np.ndarray, lo: int, hi: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows lo..hi against all rows: whether sizes and bitmaps let the Jaccard similarity be `least` (never false where it is),
    and in how many bits they differ."""
    apart = np.abs(n[lo:hi, None] - n[None, :])
    odd = np.zeros(apart.shape, np.int64)
    for w in range(WORDS):
        odd += np.bitwise_count(bits[lo:hi, None, w] ^ bits[None, :, w])
    return np.maximum(apart, odd) <= (n[lo:hi, None] + n[None, :]) * ((1 - least) / (1 + least)) + 1e-9, odd


def first_here(n: np.ndarray, at: np.ndarray, lo: int, hi: int, least: float) -> np.ndarray:
    """Rows lo..hi against all rows, all of sets with one shingle, which stands at place `at` of their order: whether they can be
    `least` alike if it is the first that they share. Then nothing before it is shared; so where sets are alike, it is true
    in the bucket of that first shingle at least."""
    left = n - at
    return np.minimum(left[lo:hi, None], left[None, :]) >= (n[lo:hi, None] + n[None, :]) * (least / (1 + least)) - 1e-9


def possible_pairs(maps: np.ndarray, size: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """close() of the pairs (i, j) of sets of n shingles with the bitmaps maps of `size` bytes."""
    ok = np.zeros(len(i), bool)
    smaller = np.minimum(size[i], size[j])
    for length in np.unique(smaller).tolist():
        of = np.flatnonzero(smaller == length)
        row, at = np.unique(np.r_[i[of], j[of]], return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, length // 8), axis=0) for x in maps[row].tolist()])
        step = max(1, (1 << 23) // length)
        for k in range(0, len(of), step):
            part = of[k : k + step]
            odd = np.bitwise_count(folded[at[k : k + len(part)]] ^ folded[at[len(of) + k : len(of) + k + len(part)]]).sum(axis=1, dtype=np.int64)
            ok[part] = odd <= (n[i[part]] + n[j[part]]) * ((1 - least) / (1 + least)) + 1e-9
    return ok


_BUCKET = ["key", "s", "tile_i", "tile_j"]


def _candidates(t: pa.Table, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, first row, ok, odd) for the tiles of t and STEP rows of a tile at a time: which earlier rows of the tile, of other
    components, may be alike, and in how many bits they differ."""
    change = np.zeros(t.num_rows - 1, bool)
    for c in _BUCKET:
        x = t.column(c).to_numpy()
        change |= x[1:] != x[:-1]
    cut = np.r_[0, np.flatnonzero(change) + 1, t.num_rows]
    many = np.flatnonzero(np.diff(cut) > 1)
    comp, n, at = (t.column(x).to_numpy() for x in ("comp", "n", "at"))
    bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
    for a, b in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
        for lo in range(0, b - a, STEP):
            hi = min(b - a, lo + STEP)
            ok, odd = alike(n[a:b], bits[a:b], lo, hi, least)
            ok &= first_here(n[a:b], at[a:b], lo, hi, least)
            ok &= (comp[a + lo : a + hi, None] != comp[None, a:b]) & (np.arange(b - a)[None, :] < np.arange(lo, hi)[:, None])
            yield a, a + lo, ok, odd


def _apart(x: DataFrame) -> DataFrame:
    """Of (s, node, at, comp, often) the rows whose shingle s nodes of several components have.

    The shingles that are not common, nearly all, are dealt by s once: none of them has many rows. For the common ones, COMMON at
    most, components are compared by an aggregate that is made before its shuffle, and broadcast.
    """
    w = Window.partitionBy("s")
    rare = x.filter(~F.col("often")).withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).filter("lo <> hi").drop("lo", "hi")
    often = x.filter("often")
    several = often.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("s")
    return rare.unionByName(often.join(F.broadcast(several), "s", "left_semi").select(*x.columns))


def _met(rows: DataFrame, least: float) -> DataFrame:
    """The rows of tiles that may be alike to another one of their tile, as far as small bitmaps tell; few of long texts are left,
    so these can bring bitmaps as large as their sets."""
    names = [*_BUCKET, "node", "comp", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, _BUCKET, 1 << 14):
            keep = np.zeros(t.num_rows, bool)
            for a, lo, ok, _ in _candidates(t, least):
                keep[lo : lo + len(ok)] |= ok.any(axis=1)
                keep[a : a + ok.shape[1]] |= ok.any(axis=0)
            yield from t.select(names).filter(pa.array(keep)).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.select(names).schema)


def _pairs(rows: DataFrame, least: float, every: bool) -> DataFrame:
    """(a, b), a < b: nodes of one tile and different components that may be alike by both bitmaps; all, or for each b the a of
    fewest different bits."""

    def chosen(maps: np.ndarray, size: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) the large bitmaps allow: all, or the first one of each i by the small bitmaps' order."""
        if every:
            return np.flatnonzero(possible_pairs(maps, size, n, i, j, least))
        by = np.lexsort((j, odd, i))
        at = np.flatnonzero(np.r_[True, i[by][1:] != i[by][:-1]])
        end, out = np.r_[at[1:], len(by)], []
        while len(at):
            fine = possible_pairs(maps, size, n, i[by[at]], j[by[at]], least)
            out.append(by[at[fine]])
            more = ~fine & (at + 1 < end)
            at, end = at[more] + 1, end[more]
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, _BUCKET, 1 << 14):
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            maps = np.array([*t.column("wide").to_pylist(), None], object)[:-1]
            size, held, many, out = np.array([len(x) for x in maps]), [], 0, []
            for a, lo, ok, odd in chain(_candidates(t, least), [(0, 0, None, None)]):
                if ok is not None:
                    i, j = np.nonzero(ok)
                    held.append((lo + i, a + j, odd[i, j]))
                    many += len(i)
                if many > AT_ONCE or ok is None and many:
                    i, j, d = (np.concatenate(v) for v in zip(*held, strict=True))
                    at = chosen(maps, size, n, i, j, d)
                    out.append((node[j[at]], node[i[at]], d[at]))
                    held, many = [], 0
            if out:
                x, y, d = (np.concatenate(v) for v in zip(*out, strict=True))
                _, at = np.unique(np.stack([x, y]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (x, y, d)], ["a", "b", "d"])

    pairs = rows.mapInArrow(run, "a long, b long, d long")
    return pairs.select("a", "b").distinct() if every else pairs.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b")


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, component_id, c), a row for each of docs: texts whose word shingles have a Jaccard similarity of `least` are linked.

    The links are exact. Equal sets are one node. The Gray-order index (simhash.linked) over the sets' SimHash fingerprints gives
    candidates within `radius` bits; they are verified by their whole sets. Fingerprints of similar sets may lie further apart
    (about 10 bits at 0.8), so the rest is found exactly: sets that are alike share a shingle of their prefixes in any order of
    all shingles; the order puts those last that are common in a sample of SAMPLE texts, which only makes buckets small and
    decides nothing. Nodes that share one, that no link connects yet, and whose sizes, places of the shingle in the order and
    parity bitmaps (a small one of all, then one as large as the set of those left) allow the similarity are verified: first one pair for each node of a bucket, then all that are still apart, so a large group of near copies
    gives no square of pairs. Buckets of more than TILE nodes are dealt to tiles (common.tiled). Whole sets are made of the
    texts of candidates only.

    A null text has no words, like an empty one; texts without words are one node. component_id is the least id of the group,
    null if no row of it has one; c names the group whatever ids it has. text_key is the text's hash. An empty table gives no rows.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    return settled(docs.sparkSession, lambda: _groups(docs, words, least, radius, id_col, text_col), "groups")


def _groups(docs: DataFrame, words: int, least: float, radius: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("text_key", text_key(F.col("text")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py(), words).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))], ["node", "set"])

    part = max(1, d.count() // SAMPLE)
    seen = d.filter(F.pmod("text_key", F.lit(part)) == 0).select("text_key", "text").dropDuplicates(["text_key"]).mapInArrow(listed, "node long, set array<long>")
    top = seen.select(F.explode("set").alias("s")).groupBy("s").count().filter("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).collect()
    order = sorted((int(r["s"]) % (1 << 64), r["count"]) for r in top)
    sent = spark.sparkContext.broadcast((np.array([x for x, _ in order], np.uint64), np.array([c for _, c in order], np.int64)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = sent.value
        for b in batches:
            sets = [shingles(x.as_py(), words) for x in b.column(1)]
            node = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
            fp = [majority(set_bits(s.astype(">u8").tobytes()), len(s)) if len(s) else 0 for s in sets]
            first = [prefix(s, common, rank, least) for s in sets]
            cols = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [n for _, n in first]))]
            cols += [pa.array(x, pa.list_(pa.int64())) for x in ([parity(s, 64 * WORDS).view(np.int64) for s in sets], [x.view(np.int64) for x, _ in first])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols, pa.array(map(wide, sets), pa.binary())], ["doc_id", "text_key", "node", "fp", "n", "rare", "bits", "first", "wide"])

    indexed = written(d.select("doc_id", "text", "text_key").mapInArrow(index, "doc_id long, text_key long, node long, fp long, n long, rare long, bits array<long>, first array<long>, wide binary"), "sets")
    nodes = written(indexed.groupBy("node").agg(F.min("text_key").alias("text_key"), *(F.first(c).alias(c) for c in ("fp", "n", "rare", "bits", "first", "wide"))), "nodes")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [close(*x, least) for x in zip(*(b.column(c).to_pylist() for c in ("wide_a", "wide_b", "n_a", "n_b")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are alike by their whole sets, which are made of the texts that the pairs need; pairs that bitmaps as
        large as the sets rule out go before."""
        a, b = (nodes.select(F.col("node").alias(c), F.col("wide").alias(f"wide_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
        pairs = written(pairs.join(a, "a").join(b, "b").mapInArrow(possible, "a long, b long"), "possible")
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        asked = written(nodes.select("node", "text_key").join(asked, "node", "left_semi"), "asked")
        few = asked.count() <= ASKED
        texts = d.join(F.broadcast(asked) if few else asked, "text_key").groupBy("node").agg(F.first("text").alias("text"))
        sets = written(texts.mapInArrow(listed, "node long, set array<long>"), "whole")
        one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        exact = both >= least * (F.size("set_a") + F.size("set_b") - both) - 1e-9
        return written(pairs.join(one, "a").join(two, "b").filter(exact).select("a", "b"), "links")

    # one node stands for each fingerprint; the others of it are its candidates, and it is theirs
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    near = linked(heads.select("fp"), radius).distinct().join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    links = verified(written(near.unionByName(nodes.join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))), "near"))
    log.info("near-duplicates: %d links through fingerprints", links.count())
    rows = None
    for every in (False, True):
        # the first time from the nodes, before their shingles are counted one by one
        x = (nodes if rows is None else rows).join(components(links).select("node", F.col("component").alias("c")), "node", "left").withColumn("comp", F.coalesce("c", "node"))
        if rows is None:
            x = x.select("node", "comp", "rare", F.posexplode("first").alias("at", "s")).select("s", "node", "at", "comp", (F.col("at") >= F.col("rare")).alias("often"))
        x = written(_apart(x), "apart")
        rows = x.select("s", "node", "at", "often")
        tiles = tiled(x.drop("often"), ["s"], "node", TILE).withColumn("key", F.xxhash64("s", "tile_i", "tile_j")).select(*_BUCKET, "node", "comp", "at")
        tiles = tiles.join(nodes.select("node", "n", "bits"), "node").repartition("key").sortWithinPartitions(*_BUCKET, "node")
        tiles = written(_met(tiles, least), "met").join(nodes.select("node", "bits", "wide"), "node").repartition("key").sortWithinPartitions(*_BUCKET, "node")
        more = verified(written(_pairs(tiles, least, every), "pairs"))
        log.info("near-duplicates: %d more links through shared shingles", more.count())
        links = links.unionByName(more)
    named = indexed.select("doc_id", "text_key", "node").join(components(links), "node", "left").withColumn("c", F.coalesce("component", "node"))
    return named.join(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "text_key", "component_id", "c")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the smallest id, then text; all columns as they were.

    Rows decide, not ids: rows that share an id but not a group stay each. A null id is larger than any; a group of rows without
    ids keeps one of them. Of rows that are equal in id and text one stays.
    """
    own, other, key, n = fresh(docs, "_id", "_key", "_text_key", "_n")
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = similar_groups(docs, words, least, radius, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keep = found.groupBy("c").agg(F.min(rank).alias("m")).select(F.col("m.doc_id").alias(own), F.col("m.text_key").alias(other))
    rows = docs.withColumn(key, text_key(text)).join(keep, (F.col(key) == F.col(other)) & id_.eqNullSafe(F.col(own)), "left_semi")
    first = F.row_number().over(Window.partitionBy(key, id_).orderBy(key))
    return rows.withColumn(n, first).filter(F.col(n) == 1).select(*docs.columns)
