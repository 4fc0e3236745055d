"""Repeated passages by suffix arrays: sparse anchors bring equal strings together, linear grouping sorts what follows them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_groups, written

#: Bytes of an anchor, bytes of a symbol of the suffix arrays, windows hashed at once, contexts of a sorted block.
ANCHOR, SYMBOL, AT_ONCE, BLOCK = 32, 16, 1 << 22, 8192
#: A group of more contexts is dealt out by longer keys: bins of this many neighbouring windows, then single windows.
HOT, BIN = 4096, 16
#: A context of more occurrences is told to every task that reads anchors, if there are at most KEYS such contexts.
OFTEN, KEYS = 1024, 1 << 20
_BASE, _MIX, _PLACE, _UNSET = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93), 24, -2


def suffix_array(s: list[int]) -> list[int]:
    """Sorted suffixes of a sequence that ends in its own unique smallest symbol, by linear grouping.

    Suffixes start in groups of equal first symbols. Groups are processed in descending order: the nearest earlier suffix of
    a lower group (the previous smaller one) has the processed group's Lyndon word as its continuation, so within its own group
    it moves up, the further the more often it is pointed at. A processed group is final: equal longest Lyndon prefixes.
    Then suffixes are emitted in ascending order: each one places those of which it is the next smaller suffix at the front
    of what is free in their groups. No symbols are renamed and nothing recurses.
    """
    n = len(s)
    # by counting: where each symbol's group starts, then every suffix at its symbol's next free place
    start = [0] * (max(s) + 2)
    for c in s:
        start[c + 1] += 1
    for c in range(1, len(start)):
        start[c] += start[c - 1]
    stop = {start[c]: start[c + 1] for c in range(len(start) - 1) if start[c] < start[c + 1]}  # a group's start -> its end
    group = [start[c] for c in s]
    order, at = [0] * n, [0] * n
    for i, c in enumerate(s):
        at[i] = start[c]
        order[start[c]] = i
        start[c] += 1
    size, before = [1] * n, [_UNSET] * n
    end = n
    while end:
        low = group[order[end - 1]]
        members = order[low:end]
        word = size[members[0]]
        times: dict[int, int] = {}
        for i in members:
            chain = [[i, i - 1]]
            while before[i] == _UNSET:
                j = chain[-1][1]
                while j >= 0 and group[j] >= low and before[j] != _UNSET:
                    j = before[j]
                if j >= 0 and group[j] >= low:  # an earlier member of this group, whose own pointer comes first
                    chain[-1][1] = j
                    chain.append([j, j - 1])
                else:
                    before[chain.pop()[0]] = j
            if (j := before[i]) >= 0:
                times[j] = times.get(j, 0) + 1
        end = low
        levels: dict[int, list[int]] = {}
        for j, m in times.items():
            levels.setdefault(m, []).append(j)
        for m in sorted(levels, reverse=True):
            tails: dict[int, int] = {}  # of groups being split: one behind what stays in place
            for j in levels[m]:
                size[j] += m * word
                g = group[j]
                t = tails.get(g, stop[g]) - 1
                k, other = at[j], order[t]
                order[k], order[t] = other, j
                at[other], at[j] = k, t
                tails[g] = t
            for g, t in tails.items():
                if t != g:
                    stop[t] = stop[g]
                    stop[g] = t
                    for k in range(t, stop[t]):
                        group[order[k]] = t
    waiting: list[list[int] | None] = [None] * (n + 1)
    for j in range(n):
        k = j + size[j]
        if waiting[k] is None:
            waiting[k] = [j]
        else:
            waiting[k].append(j)
    free = list(range(n))
    out = [0] * n
    out[0] = n - 1
    for i in range(n):
        for j in waiting[out[i]] or ():
            g = group[j]
            out[free[g]] = j
            free[g] += 1
    return out


def anchors(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first, last) of the anchors of all strings of `length` bytes in data.

    The anchor of such a string is the place within it of the ANCHOR bytes of least hash, the rightmost of equals: equal
    strings have theirs at the same offset. first and last bound the strings' starts that have the anchor.
    """
    buffer = np.frombuffer(data, np.uint8)
    for lo in range(0, max(0, len(data) - length + 1), AT_ONCE):
        part = buffer[lo : lo + AT_ONCE + length - 1]
        h, power, width = (part.astype(np.uint64) + np.uint64(1)) * _MIX, _BASE, 1
        h ^= h >> np.uint64(32)
        while width < ANCHOR:
            h = h[:-width] * np.uint64(power) + h[width:]
            power, width = power * power % (1 << 64), 2 * width
        h = (h ^ (h >> np.uint64(29))) * _MIX
        h ^= h >> np.uint64(32)
        v = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | (np.uint64((1 << _PLACE) - 1) - np.arange(len(h), dtype=np.uint64))
        least, width, most = v, 1, length - ANCHOR + 1
        while 2 * width <= most:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < most:
            least = np.minimum(least[: len(v) - most + 1], least[most - width :])
        cut = np.flatnonzero(least[1:] != least[:-1])
        first, last = np.r_[0, cut + 1], np.r_[cut, len(least) - 1]
        place = ((1 << _PLACE) - 1 - (least[first] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)).astype(np.int64)
        yield h[place], place + lo, first + lo, last + lo


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """(rid, gid, cid, place, first, last, more): each anchor with a hash of its context (its strings' bytes and its place there).

    A context that a text has several times is one row, of its first occurrence; more has where the strings of the others begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            more: list[np.ndarray | None] = []
            for rid, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_py()
                found = []
                for h, place, first, last in anchors(data, length):
                    spans = zip(first.tolist(), last.tolist(), place.tolist(), strict=True)
                    cid = np.array([xxhash.xxh3_64_intdigest(data[a : e + length], p - a) for a, e, p in spans], np.uint64)
                    found.append((h.view(np.int64), cid.view(np.int64), place, first, last))
                if not found:
                    continue
                gid, cid, place, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
                by = np.lexsort((first, cid, gid))
                new = np.flatnonzero(np.r_[True, (gid[by][1:] != gid[by][:-1]) | (cid[by][1:] != cid[by][:-1])])
                one = by[new]
                for c, x in zip(cols, (np.full(len(one), rid, np.int64), gid[one], cid[one], place[one], first[one], last[one]), strict=True):
                    c.append(x)
                more += [first[by[i + 1 : j]] if j > i + 1 else None for i, j in zip(new.tolist(), [*new[1:].tolist(), len(by)], strict=True)]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), pa.array(more, pa.list_(pa.int64()))], ["rid", "gid", "cid", "place", "first", "last", "more"])

    return docs.select("rid", "data").mapInArrow(run, "rid long, gid long, cid long, place long, first long, last long, more array<long>")


_CONTEXT = "gid long, cid long, many int, alone boolean, rid long, place long, near int, far int, data binary"


def contexts(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """_CONTEXT rows of asked (gid, cid, many, alone, rid, place, first, last): far and near are the distances of the first and
    last string's start before the anchor, data the bytes of all these strings. many counts the group's contexts."""
    per = asked.groupBy("rid").agg(F.collect_list(F.struct("gid", "cid", "many", "alone", "place", "first", "last")).alias("asked"))
    rows = docs.select("rid", "data").join(per, "rid")
    rows = rows.select("rid", "data", F.explode("asked").alias("x")).select("rid", "data", "x.*")
    cut = F.substring("data", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + length).cast("int"))
    return rows.select("gid", "cid", "many", "alone", "rid", "place", (F.col("place") - F.col("last")).cast("int").alias("near"), (F.col("place") - F.col("first")).cast("int").alias("far"), cut.alias("data"))


def _order(parts: list[bytes]) -> np.ndarray:
    """The places of parts in their sorted order, by a suffix array over symbols of SYMBOL bytes."""
    found: dict[bytes, int] = {}
    line: list[bytes] = []
    starts = []
    for p in parts:
        starts.append(len(line))
        line.extend(p[k : k + SYMBOL] for k in range(0, len(p), SYMBOL))
        line.append(b"")
    for r, x in enumerate(sorted(set(line)), 1):
        found[x] = r
    sa = suffix_array([*map(found.__getitem__, line), 0])
    rank = np.empty(len(sa), np.int64)
    rank[sa] = np.arange(len(sa))
    return np.argsort(np.argsort(rank[starts])) if parts else np.empty(0, np.int64)


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of neighbouring rows."""
    if len(rows) < 2:
        return np.empty(0, np.int64)
    apart = rows[1:] != rows[:-1]
    first = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def repeated(gid: np.ndarray, near: np.ndarray, far: np.ndarray, data: list[bytes], length: int) -> np.ndarray:
    """For each context a row of flags by distance before the anchor: is that string also in another context of its group?

    Two strings at one distance d are equal if their d bytes before the anchor and their length - d bytes from it are. Both are
    read off sorted orders: neighbours in the suffix arrays' orders that share less open a new class.
    """
    n, wide = len(data), int(far.max()) + 1
    before = [x[:f][::-1] for x, f in zip(data, far.tolist(), strict=True)]
    after = [x[f:] for x, f in zip(data, far.tolist(), strict=True)]
    sides = []
    for parts in (before, after):
        by = np.lexsort((_order(parts), gid))
        sizes = np.array([len(p) for p in parts])
        square = np.zeros((n, max(1, int(sizes.max()))), np.uint8)
        for k, p in enumerate(parts):
            square[k, : len(p)] = np.frombuffer(p, np.uint8)
        shared = _common(square[by], sizes[by])
        shared[gid[by][1:] != gid[by][:-1]] = -1
        sides.append((by, shared))
    flags = np.zeros((n, wide), bool)
    kind = np.empty((2, n), np.int64)
    for d in range(int(near.min()), wide):
        for k, ((by, shared), need) in enumerate(zip(sides, (d, length - d), strict=True)):
            kind[k, by] = np.cumsum(np.r_[0, shared < need])
        here = np.flatnonzero((near <= d) & (d <= far))
        both = kind[0, here] * n + kind[1, here]
        by = np.argsort(both)
        same = both[by][1:] == both[by][:-1]
        flags[here[by], d] = np.r_[False, same] | np.r_[same, False]
    return flags


_RANGE = "rid long, lo long, hi long"


def sorted_out(rows: DataFrame, length: int) -> DataFrame:
    """(rid, lo, hi): starts of repeated strings of the lone contexts among _CONTEXT rows whose groups are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["gid"], BLOCK):
            gid, near, far = (t.column(c).to_numpy() for c in ("gid", "near", "far"))
            flags = repeated(gid, near, far, t.column("data").to_pylist(), length)
            flags &= t.column("alone").to_numpy()[:, None]
            step = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (i, a), (_, e) = np.nonzero(step == 1), np.nonzero(step == -1)
            rid, place = t.column("rid").to_numpy()[i], t.column("place").to_numpy()[i]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(place - e + 1), pa.array(place - a)], ["rid", "lo", "hi"])

    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, _RANGE)


def dealt(rows: DataFrame, width: int, length: int) -> DataFrame:
    """_CONTEXT rows cut into bins of `width` neighbouring distances, grouped by all bytes that a bin's strings share.

    The shared bytes are length - width + 1 long, so what falls into one group again is that much alike; at width 1 it is equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            out = []
            for gid, rid, place, alone, near, far, data in zip(*(cols[c] for c in ("gid", "rid", "place", "alone", "near", "far", "data")), strict=True):
                for k in range(near // width, far // width + 1):
                    lo, hi = max(near, k * width), min(far, k * width + width - 1)
                    start = far - k * width  # of the shared bytes; start <= 0 never happens, as far >= k * width
                    key = xxhash.xxh3_64_intdigest(data[start : start + length - width + 1], gid & 0xFFFFFFFF) ^ k
                    part = data[far - hi : far - lo + length]
                    cid = xxhash.xxh3_64_intdigest(part, hi)
                    out.append((key, cid, 0, alone, rid, place, lo, hi, part if width > 1 else b""))
            cols = list(zip(*out, strict=True)) or [[]] * 9
            signed = [np.array(c, np.uint64).view(np.int64) for c in cols[:2]]
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, signed), *(pa.array(c, k) for c, k in zip(cols[2:], kinds, strict=True))], ["gid", "cid", "many", "alone", "rid", "place", "near", "far", "data"])

    return rows.mapInArrow(run, _CONTEXT)


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.select("rid", (F.col("place") - F.col("far")).alias("lo"), (F.col("place") - F.col("near")).alias("hi"))


def _every(rows: DataFrame) -> DataFrame:
    """Ranges of all occurrences of anchored() rows."""
    starts = F.concat(F.array("first"), F.coalesce("more", F.array().cast("array<bigint>")))
    x = rows.select("rid", (F.col("last") - F.col("first")).alias("width"), F.explode(starts).alias("lo"))
    return x.select("rid", "lo", (F.col("lo") + F.col("width")).alias("hi"))


def repeats(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(rid, lo, hi): ranges of starts of strings of `length` bytes that start anywhere else too. docs: (rid, data)."""
    a = written(anchored(docs, length), "anchors")
    times = F.lit(1) + F.when(F.col("more").isNull(), 0).otherwise(F.size("more"))
    each = a.groupBy("gid", "cid").agg(F.sum(times).alias("n"), F.min(F.struct("rid", "place", "first", "last")).alias("one"))
    each = written(each, "contexts")
    # a context that occurs twice is repeated as a whole; those of very many occurrences are found without a shuffle, in which
    # each would be one task's
    often = each.filter(F.col("n") > OFTEN).select("gid", "cid")
    told = 0 < often.count() <= KEYS
    whole = each.filter((F.col("n") > 1) & (F.col("n") <= OFTEN) if told else F.col("n") > 1).select("gid", "cid")
    rest = a.join(F.broadcast(often), ["gid", "cid"], "left_anti") if told else a
    found = [_every(rest.join(whole, ["gid", "cid"], "left_semi"))]
    if told:
        found.append(_every(a.join(F.broadcast(often), ["gid", "cid"], "left_semi")))
    groups = each.groupBy("gid").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least")).filter("many > 1 and least = 1")
    asked = each.join(groups, "gid").select("gid", "cid", F.col("many").cast("int").alias("many"), (F.col("n") == 1).alias("alone"), "one.*")
    rows = written(contexts(asked, docs, length).dropDuplicates(["gid", "cid"]), "asked")
    found.append(sorted_out(rows.filter(F.col("many") <= hot), length))
    large = rows.filter(F.col("many") > hot)
    if large.limit(1).count():  # groups that no task should hold: the same again by longer keys
        bins = written(dealt(large, BIN, length), "bins")
        counts = bins.groupBy("gid", "cid").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.groupBy("gid").agg(F.count(F.lit(1)).cast("int").alias("size"))
        bins = bins.join(counts, ["gid", "cid"]).join(sizes, "gid").filter("n > 1 or size > 1")
        twice = bins.filter("n > 1 and alone")
        found.append(_ranges(twice))
        # of contexts that occur more than once one row is enough for comparison
        rest = bins.filter("size > 1").withColumn("alone", F.col("alone") & (F.col("n") == 1)).withColumn("many", F.col("size")).drop("n", "size")
        rest = written(rest.dropDuplicates(["gid", "cid"]), "rest")
        found.append(sorted_out(rest.filter(F.col("many") <= hot), length))
        ones = dealt(rest.filter(F.col("many") > hot), 1, length).drop("data")
        equal = ones.groupBy("gid", "cid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gid", "cid")
        found.append(_ranges(ones.join(equal, ["gid", "cid"], "left_semi").filter("alone")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed): each whole text without every byte that lies in a string
    of `length` bytes that starts anywhere else too, in the same document or another; removed lists the runs, in bytes.

    Equal strings share their anchor, so anchors' hashes (of all documents) are counted first, equal contexts are counted as
    one, and only contexts that differ around a shared anchor are fetched and sorted, by two suffix arrays for each block of whole
    groups. A group of more than `hot` contexts is dealt out by keys that are nearly as long as the strings, then by the
    strings themselves, which are only counted; so no group has to fit one task, and none is cut.

    A null text counts as empty, and texts shorter than `length` lose nothing. Repeated rows are documents of their own, which
    repeat each other. Rows with a null id are kept. An empty table gives no rows.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("rid"), text.cast("binary").alias("data"))
    spans = repeats(d, length, hot).groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, spans in zip(b.column(1), b.column(2), strict=True):
                data, gone = data.as_py(), []
                for s in spans.as_py() or ():
                    lo, hi = s["lo"], s["hi"] + length
                    if gone and lo <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], hi)
                    else:
                        gone.append([lo, hi])
                cut = [0, *(x for g in gone for x in g), len(data)]
                sha = hashlib.sha256()
                for k in range(0, len(cut), 2):
                    sha.update(data[cut[k] : cut[k + 1]])
                out.append((len(data), sum(e - s for s, e in gone), len(gone), sha.hexdigest(), [{"start": s, "end": e} for s, e in gone]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    rows = d.join(spans, "rid", "left").select("doc_id", "data", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
