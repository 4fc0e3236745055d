"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tiled, union_roots, whole_groups, written
from quarry.llm.graph import components

log = logging.getLogger("quarry")
#: Vectors of a tile, rows of a tile that are multiplied at once, most vectors that one rotation is fitted on.
TILE, STRIP, FITTED = 2048, 256, 1024
#: Bits of a table's substring, tried in two rounds: short ones only where long ones cannot reach the recall with MOST tables.
WIDE, NARROW, MOST = (16, 14, 12, 10, 8), (6, 4, 2, 1, 0), 40
#: What a copy of a vector in a table costs, in comparisons.
COPY = 300


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no finite scale overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(v: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """A rotation of v's columns whose signs lose least of v: turns of rounding and a Procrustes fit from a random start."""
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


@dataclass
class Codes:
    """Binary codes by signs behind learned rotations of the principal axes, about a centre; as many rotations as bits need."""

    fitted: np.ndarray
    centre: np.ndarray
    seed: int = 0
    turns: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        moved = self.fitted - self.centre
        self.axes = np.linalg.eigh(moved.T @ moved)[1][:, ::-1]  # the widest first
        self.moved = moved @ self.axes

    def projection(self, bits: int) -> np.ndarray:
        """(dimension x bits)"""
        while sum(t.shape[1] for t in self.turns) < bits:
            self.turns.append(self.axes @ learn_rotation(self.moved, self.rng))
        return np.concatenate([np.zeros((len(self.axes), 0)), *self.turns], axis=1)[:, :bits]


@dataclass
class Index:
    """tables substrings of sub bits each; recall is what pairs at the threshold and the sample's own links measured. Whole codes
    of more than `far` different bits are no candidates."""

    centre: np.ndarray
    projection: np.ndarray
    sub: int
    tables: int
    recall: float
    far: int = 0

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """Whole codes of unit vectors as rows of 64-bit words."""
        bits = (x - self.centre) @ self.projection >= 0
        return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The substrings of unit vectors' codes: a row for each vector, a column for each table."""
        return self.packed((x - self.centre) @ self.projection >= 0)

    def packed(self, bits: np.ndarray) -> np.ndarray:
        return (bits.reshape(len(bits), self.tables, self.sub) * (1 << np.arange(self.sub))).sum(axis=2)


def _at_threshold(x: np.ndarray, label: np.ndarray, least: float, rng: np.random.Generator, most: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of pairs that an index must bring together: cosine `least` in a random direction, in a direction in which the
    sample differs, and the sample's own links."""
    some = x[rng.integers(len(x), size=most)]

    def beside(way: np.ndarray) -> np.ndarray:
        way = way - (way * some).sum(axis=1, keepdims=True) * some
        n = np.linalg.norm(way, axis=1, keepdims=True)
        way = np.where(n > 1e-9, way / np.maximum(n, 1e-300), 0.0)
        y = least * some + math.sqrt(max(0.0, 1 - least * least)) * way
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    pick = lambda: x[rng.integers(len(x), size=most)]
    out = [(some, beside(rng.normal(size=some.shape))), (some, beside(pick() - pick()))]
    own: list[np.ndarray] = []
    for lo in range(0, len(x), STRIP):
        i, j = np.nonzero((x[lo : lo + STRIP] @ x.T >= least) & (label[lo : lo + STRIP, None] == label[None, :]))
        i += lo
        here = np.flatnonzero(i < j)
        here = here[rng.integers(max(1, len(here)), size=min(most, len(here)))]
        own.append(np.stack([i[here], j[here]]))
    pairs = np.concatenate(own, axis=1) if own else np.zeros((2, 0), np.int64)
    pairs = pairs[:, rng.permutation(pairs.shape[1])[:most]]
    return [*out, (x[pairs[0]], x[pairs[1]])] if pairs.shape[1] else out


def plan_index(x: np.ndarray, label: np.ndarray, most: int, least: float, recall: float = 0.997, seed: int = 0) -> Index:
    """The cheapest index over the sample x of unit vectors that reaches the recall in every family of pairs.

    Substring lengths are tried with codes about the mean and about the origin (the cosine is about the origin: vectors around
    one direction differ little there). Each takes as many tables as the measured recall asks for. The cost is of copies and
    of the comparisons in buckets, at the sample's own collision rate, for a label of `most` vectors.
    """
    rng = np.random.default_rng(seed)
    fitted = x[: min(FITTED, max(1, len(x) // 2))]
    other = slice(len(fitted) if len(x) > 1 else 0, None)  # codes suit the vectors that they were fitted to best, so others measure them
    pairs = _at_threshold(x[other], label[other], least, rng)
    makers = [Codes(fitted, c, seed) for c in (fitted.mean(axis=0), np.zeros(x.shape[1]))]
    best: tuple[float, Index] | None = None
    for subs in (WIDE, NARROW):
        for m in makers:
            p = m.projection(MOST * max(subs))
            sign = lambda v, m=m, p=p: (v - m.centre) @ p >= 0
            apart, own = [sign(a) != sign(b) for a, b in pairs], sign(x)
            for sub in subs:
                tables = MOST if sub else 1
                # of each family the share of pairs that have met in the first 1, 2, ... tables
                met = np.array([1 - np.logical_and.accumulate(d[:, : sub * tables].reshape(len(d), tables, sub).any(axis=2), axis=1).mean(axis=0) for d in apart]).min(axis=0)
                enough = np.flatnonzero(met >= recall)
                if not len(enough):
                    continue
                need = int(enough[0]) + 1
                # bits in which pairs differ, and a tenth of all more, so that hardly a pair is lost to the distance of whole codes
                bits = [d[:, : sub * need].sum(axis=1) for d in apart]
                far = int(max((b.max() for b in bits if len(b)), default=0)) + math.ceil(0.1 * sub * need)
                index = Index(m.centre, p[:, : sub * need], sub, need, float(met[need - 1]), far)
                code = index.packed(own[:, : sub * need])
                meet = [float((np.unique(code[:, t], return_counts=True)[1] ** 2).sum() - len(x)) for t in range(need)]
                cost = need * COPY + most * sum(meet) / max(1, len(x) * (len(x) - 1))
                if best is None or cost < best[0]:
                    best = (cost, index)
        if best is not None:
            break
    return best[1]


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def near_vectors(
    vectors: DataFrame, least: float = 0.93, recall: float = 0.997, sample: int = 8192,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one non-null label with cosine >= least are linked.

    Equal vectors of a label become one node first (counted before the shuffle). For each length of vectors an index is learned
    from at most about `sample` nodes (all lengths together; at least 64 of each): rotations by iterative quantisation, and as
    many tables of code substrings as bring `recall` of the pairs at the threshold together (plan_index); the figure is logged.
    Every node is indexed. Nodes of one label and length that share a substring are candidates if their whole codes differ in few bits
    (more than any pair measured does); tables hold codes alone. Vectors come to those that have a candidate, are compared
    in double precision, and a pair counts in the first table where it meets. Buckets of more than TILE nodes are dealt to tiles
    (common.tiled); a tile is compared in strips and gives counts and a spanning forest, never all pairs.

    Vectors that are null, zero, or hold null or non-finite components, and vectors of a null label, link with nothing and are
    their own component. Vectors of different lengths do not link. Scale does not matter, up to the largest and smallest
    doubles. Repeated rows (id, label and vector) count as one; an id with several vectors has a row for each, with the links of
    all. A null id is no node. An empty table gives no rows.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"  # floats travel as they are
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).distinct()
    sane = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))) & F.exists("v", lambda a: a != 0)
    key = F.when(F.coalesce(sane, F.lit(False)), F.struct("label", F.xxhash64("v").alias("h"), F.hash("v").alias("g")))
    v = v.withColumn("key", key)
    nodes = v.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("w"), F.first("v").alias("v"))
    nodes = written(nodes.select("key", "node", "w", F.col("key.label").alias("label"), "v", F.size("v").alias("d")), "vectors")
    # one row for each length: its nodes, those of its largest label, and the share of them to learn from
    sizes = nodes.groupBy("d", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    counts = {r["d"]: (r["n"], r["most"]) for r in sizes.collect()}
    each = max(64, sample // max(1, len(counts)))
    share = F.lit(each) / F.create_map(*(F.lit(x) for d, (n, _) in counts.items() for x in (d, float(n))))[F.col("d")] if counts else F.lit(0.0)
    drawn = nodes.filter(F.pmod(F.xxhash64(F.lit(3), "node", "key"), F.lit(1 << 20)) < share * (1 << 20)).select("d", "label", "node", "v").toArrow()
    plans: dict[int, Index] = {}
    for d, (_, most) in counts.items():
        t = drawn.filter(pa.compute.equal(drawn.column("d"), d)).sort_by([("node", "ascending"), ("label", "ascending")]).combine_chunks()
        if not t.num_rows:  # few nodes, none of them drawn
            t = nodes.filter(F.col("d") == d).select("d", "label", "node", "v").limit(1).toArrow().combine_chunks()
        x = unit(_rows(t.column("v").combine_chunks()))
        order = np.random.default_rng(1).permutation(len(x))
        plans[d] = plan_index(x[order], t.column("label").to_numpy()[order], most, least, recall)
        log.info("vectors of length %d: %d tables of %d bits, recall %.4f on %d sampled", d, plans[d].tables, plans[d].sub, plans[d].recall, len(x))
    sent = spark.sparkContext.broadcast(plans)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        for b in batches:
            dims = b.column(4).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = unit(_rows(part.column(3)))
                code, sig = plans[d].codes(x).astype(np.int32), plans[d].signatures(x)
                cols = [*(part.column(c) for c in (0, 1, 2, 4)), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(list(code), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["node", "label", "h", "d", "sig", "code"])

    coded = nodes.select("node", "label", "key.h", "v", "d").mapInArrow(index, "node long, label long, h long, d int, sig binary, code array<int>")
    names = ["label", "d", "t", "s", "tile_i", "tile_j"]
    rows = tiled(coded.select("node", "label", "h", "d", "sig", F.posexplode("code").alias("t", "s")), names[:4], "node", TILE)
    names = ["bucket", *names]
    rows = rows.withColumn("bucket", F.xxhash64(*names[1:])).repartition("bucket").sortWithinPartitions(*names)

    def tiles(t: pa.Table) -> Iterator[tuple[int, int]]:
        """Where the tiles of two rows and more begin and end."""
        change = np.zeros(t.num_rows - 1, bool)
        for c in names:
            x = t.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        cut = np.r_[0, np.flatnonzero(change) + 1, t.num_rows]
        keep = np.flatnonzero(np.diff(cut) > 1)
        yield from zip(cut[keep].tolist(), cut[keep + 1].tolist(), strict=True)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of tiles whose whole code is near another one of their tile."""
        plans = sent.value
        for t in whole_groups(batches, names, 4 * TILE):
            keep = np.zeros(t.num_rows, bool)
            d, i, j, seg = (t.column(c).to_numpy() for c in ("d", "tile_i", "tile_j", "seg"))
            for a, b in tiles(t):
                sig = t.column("sig").slice(a, b - a).to_pylist()
                sig = np.array([np.frombuffer(x, np.uint64) for x in sig]).reshape(b - a, len(sig[0]) // 8)
                for lo in range(0, b - a, STRIP):
                    part = sig[lo : lo + STRIP]
                    apart = np.zeros((len(part), b - a), np.int64)
                    for w in range(sig.shape[1]):
                        apart += np.bitwise_count(part[:, w, None] ^ sig[None, :, w])
                    near = apart <= plans[int(d[a])].far
                    near[np.arange(len(part)), np.arange(lo, lo + len(part))] = False
                    if i[a] != j[a]:
                        near &= seg[a + lo : a + lo + len(part), None] != seg[None, a:b]
                    keep[a + lo : a + lo + len(part)] |= near.any(axis=1)
            yield from t.select([*names, "seg", "node", "h"]).filter(pa.array(keep)).combine_chunks().to_batches()

    near = rows.select(*names, "seg", "node", "h", "sig").mapInArrow(close, rows.select(*names, "seg", "node", "h").schema)
    near = near.join(nodes.select("node", "label", F.col("key.h").alias("h"), "v", "w"), ["node", "label", "h"]).repartition("bucket").sortWithinPartitions(*names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        for t in whole_groups(batches, names, 4 * TILE):
            cols = [t.column(x).to_numpy() for x in names]
            out = []
            for a, b in tiles(t):
                part = t.slice(a, b - a)
                x = unit(_rows(part.column("v").combine_chunks()))
                code = plans[int(cols[2][a])].codes(x)[:, : int(cols[3][a])]
                if (code == code[0]).all(axis=0).any():
                    continue  # all these pairs have met in an earlier table
                node, seg, w = (part.column(c).to_numpy() for c in ("node", "seg", "w"))
                many, root = np.zeros(b - a, np.int64), np.arange(b - a)
                for lo in range(0, b - a, STRIP):
                    near = x[lo : lo + STRIP] @ x.T
                    link = near >= least - 1e-12
                    if cols[5][a] != cols[6][a]:
                        link &= seg[lo : lo + STRIP, None] != seg[None, :]  # two of one segment meet in that segment's own tile
                    i, j = np.nonzero(link)
                    edge = np.flatnonzero(near[i, j] < least + 1e-12)  # as good as equal: one order of sums for both directions
                    i += lo
                    ok = i != j
                    ok[edge] &= (x[i[edge]] * x[j[edge]]).sum(axis=1) >= least
                    i, j = i[ok], j[ok]
                    first = (code[i] != code[j]).all(axis=1)
                    many += np.bincount(i[first], w[j[first]], b - a).astype(np.int64)
                    root = union_roots(b - a, np.r_[np.arange(b - a), i], np.r_[root, j])
                at = np.flatnonzero((many > 0) | (root != np.arange(b - a)))
                out.append((node[at], node[root[at]], many[at]))
            if out:
                a, b, m = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m)], ["a", "b", "n"])

    met = written(near.select(*names, "seg", "node", "w", "v").mapInArrow(compare, "a long, b long, n long"), "links")
    links = met.groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(met.select("a", "b"))
    found = nodes.join(links, nodes["node"] == links["a"], "left").join(groups, nodes["node"] == groups["node"], "left")
    found = found.select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", nodes["node"]).alias("component_id"))
    key_cols = lambda d: [F.col(f"key.{x}").alias(x) for x in ("label", "h", "g")]  # noqa: E731, ARG005
    a, b = v.select("vec_id", F.col("key").isNotNull().alias("sane"), *key_cols(v)), found.select(*key_cols(found), "n_links", "component_id")
    out = a.filter("sane").join(b, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    alone = a.filter(~F.col("sane")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
