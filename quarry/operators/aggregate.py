"""Filters, scores, duplicates and spans of extractions."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import split_words
from quarry.operators.similar import independent
from quarry.plans.materialise import materialised
from quarry.schema import EXACT, FUZZY, GREATER, LESSER

ORDER = ("pass_number", "chunk_id", "ordinal")
#: Rows of a document that one task reduces.
WHOLE = 4096


def quality_score(text: Column, status: Column) -> Column:
    """0 to 1 from length, alignment and kinds of characters, summed in whole hundredths."""
    n = F.length(text)
    points = (
        F.lit(50) + F.when(n.between(2, 100), 20).when(n > 100, -10).otherwise(0)
        + F.when(status == EXACT, 30).when(status == FUZZY, 10).when(status == LESSER, 5).when(status == GREATER, -5).otherwise(-20)
        + F.when(text.rlike(r"\p{IsAlphabetic}"), 10).otherwise(0) + F.when(text.rlike(r"\p{N}"), 5).otherwise(0) + F.when(n <= 1, -30).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points)) / F.lit(100.0)


def quality_stats(rows: DataFrame, *keys: str) -> DataFrame:
    s = F.col("quality_score")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.avg(s).alias("average_quality"), F.count_if(s >= 0.7).alias("high_quality"), F.count_if((s >= 0.3) & (s < 0.7)).alias("medium_quality"), F.count_if(s < 0.3).alias("low_quality")
    )


def pass_stats(responses: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each document and pass: chunks asked, failures, time, and the new values that the pass kept."""
    asked = responses.groupBy(id_col, "pass_number").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("success")).alias("failed"), F.sum("latency_ms").alias("latency_ms"))
    new = rows.groupBy(F.col(id_col).alias("_d"), F.col("pass_number").alias("_p")).agg(F.count(F.lit(1)).alias("new"))
    x = asked.join(new, F.col(id_col).eqNullSafe(F.col("_d")) & (F.col("pass_number") == F.col("_p")), "left")
    return x.select(id_col, "pass_number", "chunks", "failed", "latency_ms", F.coalesce("new", F.lit(0)).alias("new"))


def class_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "extraction_class").agg(F.count(F.lit(1)).alias("n"))


def by_class(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("extraction_class") == name)


def _first_of(rows: DataFrame, by: list, order: tuple[str, ...]) -> DataFrame:
    """The first row of each group; groups are reduced before they are shuffled, so a large one costs no task more than others."""
    keys = [k if isinstance(k, Column) else F.col(k) for k in by]
    at = F.struct(F.lit(0), *(F.col(c) for c in order if c in rows.columns))
    first = rows.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*rows.columns), at).alias("_x"))
    return first.select("_x.*")


def dedupe_normalized(rows: DataFrame, id_col: str = "doc_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first row of each document's texts that are equal but for case and outer white space, whatever their class."""
    return _first_of(rows, [id_col, F.lower(F.regexp_replace("extraction_text", r"(?U)^\s+|\s+\z", ""))], order)


def dedupe_similar(rows: DataFrame, id_col: str = "doc_id", threshold: tuple[int, int] = (4, 5), position_aware: bool = False, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Greedy: a row goes if an earlier kept row of its document is alike and of its class, or of another class and overlapping.

    Alike are equal texts, and word sets of a Jaccard similarity of at least the threshold (a fraction, so comparisons are of
    whole numbers); texts without words are alike. Equal (class, text) pairs are reduced first (with position_aware only at equal
    places; same-class rows must then overlap too). Rows are written once. Documents of at most WHOLE rows are reduced each in
    one task; larger ones by rounds over all tasks (similar.independent), with the same result.
    """
    exact = [id_col, "extraction_class", "extraction_text", *(["start_pos", "end_pos"] if position_aware else [])]
    # an equal text of the same class is always dropped, but a dropped row may have stood for nothing: keep the first only
    x = materialised(_first_of(rows, exact, order), "values")
    keys = [c for c in order if c in x.columns]
    large = materialised(x.groupBy(F.col(id_col).alias("_d")).count().filter(F.col("count") > WHOLE).select("_d"), "large")
    if not large.limit(1).count():
        return _in_one_task(x, id_col, keys, threshold, position_aware)
    same = F.col(id_col).eqNullSafe(F.col("_d"))
    some = independent(x.join(F.broadcast(large), same, "left_semi"), id_col, keys, threshold, position_aware)
    return _in_one_task(x.join(F.broadcast(large), same, "left_anti"), id_col, keys, threshold, position_aware).unionByName(some)


def _in_one_task(x: DataFrame, id_col: str, keys: list[str], threshold: tuple[int, int], position_aware: bool) -> DataFrame:
    """One pass over each document's rows in order, which keeps the numbers of kept rows by word, so that a row is compared only
    with those that it shares a word with."""
    found, of = threshold

    def reduce(t: pa.Table) -> pa.Table:
        at = pc.sort_indices(t, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start") if keys else pa.array(range(t.num_rows))
        text, kind, start, end = (t.column(c).take(at).to_pylist() for c in ("extraction_text", "extraction_class", "start_pos", "end_pos"))
        kept: list[int] = []
        sets: dict[int, frozenset[str]] = {}
        by_word: dict[str, list[int]] = {}
        blank: list[int] = []

        def doubled(i: int, j: int) -> bool:
            over = None not in (start[i], end[i], start[j], end[j]) and start[i] < end[j] and start[j] < end[i]
            return over if position_aware or kind[i] is None or kind[i] != kind[j] else True

        for i, value in enumerate(text):
            own = frozenset(split_words(value))
            shared = Counter(k for w in own for k in by_word.get(w, ())) if own else dict.fromkeys(blank, 0) if value is not None else {}
            if any(n * of >= (len(sets[k]) + len(own) - n) * found and doubled(k, i) for k, n in shared.items()):
                continue
            kept.append(i)
            sets[i] = own
            for w in own:
                by_word.setdefault(w, []).append(i)
            if not own and value is not None:
                blank.append(i)
        return t.take(at.take(pa.array(kept, pa.int64())))

    return x.groupBy(id_col).applyInArrow(reduce, x.schema)


def nested(rows: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("extraction_class", "extraction_text", "start_pos", "end_pos", "alignment_status", "group_index"), order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row for each document: its extractions as an ordered array."""
    keys = [c for c in order if c in rows.columns]
    g = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*keys, *(c for c in fields if c in rows.columns)))).alias("_x"))
    return g.select(id_col, F.transform("_x", lambda s: F.struct(*(s[c].alias(c) for c in fields if c in rows.columns))).alias("extractions"))
