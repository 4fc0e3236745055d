"""Greedy removal of similar values where one document has too many for one task: a lexicographically first independent set."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.text import split_words
from quarry.plans.materialise import materialised

log = logging.getLogger("quarry")
#: Words that are known to be common (by their counts; the order only makes buckets small), and rows of a bucket compared in one task.
COMMON, TILE = 1 << 16, 1024
#: Rounds go on as long as each decides this share of the rows; earlier candidates for each row that are compared at once.
SHARE, FEW = 1 / 8, 64


def _order(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with _r, increasing in the order of `by`: a range-partitioned sort, so that the rows of one document are in many tasks."""
    return materialised(rows.orderBy(*by).withColumn("_r", F.monotonically_increasing_id()), "ordered")


def _sets(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with _w, the distinct words; a text without words has the empty word, a null text no set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [None if t is None else sorted(set(split_words(t))) or [""] for t in b.column("_t").to_pylist()]
            yield b.drop_columns(["_t"]).append_column("_w", pa.array(words, pa.list_(pa.string())))

    kept = [f for f in rows.schema if f.name != text_col]
    return rows.withColumnRenamed(text_col, "_t").mapInArrow(run, StructType([*kept, *StructType.fromDDL("_w array<string>")]))


def _buckets(sets: DataFrame, found: int, of: int) -> DataFrame:
    """(doc, word, _r): each row at the first words of its set in an order of all words, common ones last; of two sets of one
    document that are alike, both have one of these."""
    counts = sets.select(F.explode("_w").alias("word")).groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(COMMON)
    sent = sets.sparkSession.sparkContext.broadcast({r["word"]: r["count"] for r in counts.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for b in batches:
            first = [sorted(w, key=lambda x: (rank.get(x, 0), x))[: len(w) + (-len(w) * found // of) + 1] for w in b.column("_w").to_pylist()]
            at = pa.array([i for i, w in enumerate(first) for _ in w], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_doc").take(at), pa.array([x for w in first for x in w], pa.string()), b.column("_r").take(at)], ["_doc", "word", "_r"])

    return sets.select("_doc", "_r", "_w").mapInArrow(run, StructType([sets.schema["_doc"], *StructType.fromDDL("word string, _r bigint")]))


def _alike(found: int, of: int, position_aware: bool) -> Column:
    """Whether b's row goes once a's is kept; columns are named with a_ and b_."""
    both = F.size(F.array_intersect("a_w", "b_w"))
    over = F.coalesce((F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")), F.lit(False))
    same = over if position_aware else over | F.coalesce(F.col("a_k") == F.col("b_k"), F.lit(False))
    return (both * of >= (F.size("a_w") + F.size("b_w") - both) * found) & same


def _sided(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(F.col("_r").alias(side), F.col("_w").alias(f"{side}_w"), F.col("_k").alias(f"{side}_k"), F.col("_s").alias(f"{side}_s"), F.col("_e").alias(f"{side}_e"))


def _edges(buckets: DataFrame, sets: DataFrame, alike: Column) -> DataFrame:
    """(a, b), a before b, of all rows of one bucket that are alike. Buckets are dealt out by parts of TILE earlier rows; pairs are
    compared where they meet, so none that is not alike is ever shuffled."""
    parts = buckets.groupBy("_doc", "word").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("parts")).filter("parts > 1")
    x = buckets.join(parts, ["_doc", "word"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = x.join(sets.select("_r", "_w", "_k", "_s", "_e"), "_r")
    a = x.select("_doc", "word", F.pmod(F.xxhash64("_r"), F.col("parts")).cast("int").alias("part"), F.col("_r").alias("a"), *(F.col(f"_{c}").alias(f"a_{c}") for c in "wkse"))
    b = x.select("_doc", "word", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("_r").alias("b"), *(F.col(f"_{c}").alias(f"b_{c}") for c in "wkse"))
    return a.join(b, ["_doc", "word", "part"]).filter((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()


def independent(rows: DataFrame, doc_col: str, by: list[str], threshold: tuple[int, int], position_aware: bool) -> DataFrame:
    """Of rows (extraction_text, extraction_class, start_pos, end_pos and what is in `by`) those that a greedy pass over each
    document in the order of `by` keeps; no task ever has a whole document.

    A row is kept if no earlier row that it is alike to is kept. Rows meet in buckets of the first words of their sets. First come
    rounds: what stands first in all of its buckets is kept, and each row of a bucket is compared with the bucket's first one
    alone, so any number of like values costs one comparison each. When few rows are left for each other, or a round decides little, the
    pairs left that are alike are listed, and rounds over these decide the rest: kept is what no undecided earlier row is alike to.
    """
    spark = rows.sparkSession
    found, of = threshold
    every = _order(rows, [doc_col, *by])
    sets = _sets(every.select("_r", F.concat(F.lit("="), F.col(doc_col).cast("string")).alias("_doc"), "extraction_text", F.col("extraction_class").alias("_k"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e")), "extraction_text")
    sets = materialised(sets.filter(F.col("_w").isNotNull()).withColumn("_doc", F.coalesce("_doc", F.lit(""))), "sets")
    alike = _alike(found, of, position_aware)
    buckets = materialised(_buckets(sets, found, of), "buckets")
    kept = every.filter(F.col("extraction_text").isNull()).select("_r")
    while True:
        sizes = buckets.groupBy("_doc", "word").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("a"))
        state = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
        if not state["rows"]:
            return every.join(kept, "_r", "left_semi").drop("_r")
        if state["pairs"] <= FEW * state["rows"]:
            break
        later = buckets.join(sizes.select("_doc", "word", "a"), ["_doc", "word"]).filter("_r > a").select("a", F.col("_r").alias("b"))
        heads = materialised(sizes.select(F.col("a").alias("_r")).distinct().join(later.select(F.col("b").alias("_r")), "_r", "left_anti"), "kept")
        near = later.join(heads.select(F.col("_r").alias("a")), "a", "left_semi").distinct()
        gone = near.join(_sided(sets, "a"), "a").join(_sided(sets, "b"), "b").filter(alike).select(F.col("b").alias("_r")).distinct()
        decided = materialised(heads.unionByName(gone), "decided")
        kept = kept.unionByName(heads)
        buckets = materialised(buckets.join(decided, "_r", "left_anti"), "buckets")
        left = buckets.count()
        log.info("similar values: %d of %d bucket rows undecided", left, state["rows"])
        if left > (1 - SHARE) * state["rows"]:
            break
    edges = materialised(_edges(buckets, sets, alike), "edges")
    # what has no edge at all is kept now; the rest by rounds
    ends = edges.select(F.col("a").alias("_r")).unionByName(edges.select(F.col("b").alias("_r")))
    kept = kept.unionByName(buckets.select("_r").distinct().join(ends, "_r", "left_anti"))
    while edges.limit(1).count():
        heads = materialised(edges.select(F.col("a").alias("_r")).distinct().join(edges.select(F.col("b").alias("_r")), "_r", "left_anti"), "kept")
        gone = materialised(edges.join(heads.select(F.col("_r").alias("a")), "a", "left_semi").select(F.col("b").alias("_r")).distinct(), "gone")
        kept = kept.unionByName(heads)
        decided = heads.unionByName(gone)
        rest = edges.join(decided.select(F.col("_r").alias("a")), "a", "left_anti").join(gone.select(F.col("_r").alias("b")), "b", "left_anti")
        # rows whose last undecided earlier row has gone are free
        free = edges.select(F.col("b").alias("_r")).unionByName(edges.select(F.col("a").alias("_r"))).distinct().join(decided, "_r", "left_anti")
        edges = materialised(rest, "edges")
        ends = edges.select(F.col("a").alias("_r")).unionByName(edges.select(F.col("b").alias("_r")))
        kept = kept.unionByName(materialised(free.join(ends, "_r", "left_anti"), "kept"))
    return every.join(materialised(kept, "kept"), "_r", "left_semi").drop("_r")
