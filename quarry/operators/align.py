"""Alignment of values with their source: exact, first-and-last-word, then fuzzy."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import split_words, words
from quarry.operators.arrow import explode_rows
from quarry.operators.responses import EXTRACTION, parse_rows
from quarry.schema import EXACT, FUZZY, GREATER, LESSER


@dataclass(frozen=True)
class AlignConfig:
    """threshold as a fraction (found, of) of a value's words, so that comparisons are of whole numbers."""

    fuzzy: bool = True
    threshold: tuple[int, int] = (2, 5)
    accept_lesser: bool = True
    case_sensitive: bool = False
    max_window: int = 100


def exact_start(value: Column, text: Column) -> Column:
    """0-based first occurrence, null if there is none; an empty value is found at 0."""
    return F.nullif(F.instr(text, value), F.lit(0)) - 1


def lesser(value: Column, text: Column) -> Column:
    """(start, end) from the first word's first occurrence to the last word's next one, if that is under twice the value's length."""
    w = words(value)
    first = F.instr(text, F.get(w, F.lit(0)))
    last_word = F.try_element_at(w, F.lit(-1))
    at = F.call_function("locate", last_word, text, F.greatest(first, F.lit(1)))
    end = at + F.length(last_word) - 1
    ok = (F.size(w) > 1) & (first > 0) & (at > 0) & (end - (first - 1) < 2 * F.length(value))
    return F.when(ok, F.struct((first - 1).cast("bigint").alias("start_pos"), end.cast("bigint").alias("end_pos")))


@lru_cache(8)
def _indexed(text: str) -> tuple[list[str], list[int], dict[str, list[int]]]:
    """Words, where they start, and the places of each among them; the values of one answer share their text."""
    words_, starts, where, at = text.split(), [], {}, 0
    for i, x in enumerate(words_):
        at = text.index(x, at)
        starts.append(at)
        where.setdefault(x, []).append(i)
        at += len(x)
    return words_, starts, where


def fuzzy(value: str, text: str, c: AlignConfig = AlignConfig()) -> tuple[int, int] | None:
    """The earliest best window of words, of the fewest words (from the value's number up) with any window over the threshold.

    A window's likeness is the share of the value's words, repeats counted, that are among its words. One that reaches the last
    word takes the rest of the text. Windows are not visited one by one: each place of one of the value's words adds its weight to
    the stretch of windows that hold it, and a sweep over the stretches' ends finds the best.
    """
    v = value.split()
    w, starts, where = _indexed(text)
    n, most = len(w), min(len(w), c.max_window)
    if not v or len(v) > most:
        return None
    found, of = c.threshold
    need = Counter(v)
    hits = [(many, where[x]) for x, many in need.items() if x in where]
    if sum(many for many, _ in hits) * of < found * len(v):
        return None  # no window can be better than the whole text
    for size in range(len(v), most + 1):
        steps: dict[int, int] = {}
        for many, places in hits:
            free = 0  # the first window that no earlier place of this word has reached
            for p in places:
                a, b = max(free, p - size + 1), min(p, n - size) + 1
                if a < b:
                    steps[a] = steps.get(a, 0) + many
                    steps[b] = steps.get(b, 0) - many
                    free = b
        score, best, first = 0, 0, 0
        for i in sorted(steps):
            score += steps[i]
            if score > best:
                best, first = score, i
        if best * of >= found * len(v):
            last = first + size - 1
            return starts[first], (starts[last] + len(w[last]) if last + 1 < n else len(text))
    return None


#: Values that are looked for one by one before it shows whether most are missing, and the share of missing ones from which an
#: automaton pays: a search that succeeds ends where its value stands, one that fails reads the whole text.
TRIED, MISSING = 64, 3 / 4


def first_places(values: list[str], text: str) -> list[int | None]:
    """Each value's first occurrence in the text, None without one; an empty value is found at 0.

    Distinct values are searched one after another while most of them are found; where most are missing, one pass of an
    Aho-Corasick automaton finds all others, so that many values that a text does not have cost one reading of it.
    """
    at: dict[str, int | None] = {}
    rest = list(dict.fromkeys(values))
    for n, v in enumerate(rest):
        if n >= TRIED and len(rest) - n > TRIED and sum(p is None for p in at.values()) > MISSING * n:
            at |= _one_pass(rest[n:], text)
            break
        at[v] = None if (k := text.find(v)) < 0 else k
    return [at[v] for v in values]


def _one_pass(values: list[str], text: str) -> dict[str, int | None]:
    at: dict[str, int | None] = dict.fromkeys(values)
    a = ahocorasick.Automaton()
    for v in filter(None, values):
        a.add_word(v, v)
    if "" in at:
        at[""] = 0
    if not len(a):
        return at
    a.make_automaton()
    left = len(a)
    for end, v in a.iter(text):
        if at[v] is None:
            at[v] = end - len(v) + 1
            left -= 1
            if not left:
                break
    return at


def near_ends(value: str, text: str) -> tuple[int, int] | None:
    """lesser() of a text outside the JVM."""
    w = split_words(value)
    if len(w) < 2 or (first := text.find(w[0])) < 0 or (last := text.find(w[-1], first)) < 0:
        return None
    end = last + len(w[-1])
    return (first, end) if end - first < 2 * len(value) else None


Place = tuple[int | None, int | None, str | None]


def places(values: list[str | None], text: str | None, c: AlignConfig = AlignConfig()) -> list[Place]:
    """(start, end, status) of every value of one text: exact places of all values first, then the other ways for those without."""
    if text is None:
        return [(None, None, None)] * len(values)
    fold = (lambda x: x) if c.case_sensitive else str.lower
    t = fold(text)
    folded = [None if v is None else fold(v) for v in values]
    found = iter(first_places([v for v in folded if v is not None], t))
    out: list[Place] = []
    for v, f in zip(values, folded, strict=True):
        if f is None:
            out.append((None, None, None))
        elif (k := next(found)) is not None:
            out.append((k, k + len(v), EXACT))
        elif c.accept_lesser and (hit := near_ends(f, t)):
            out.append((*hit, LESSER))
        elif c.fuzzy and (hit := fuzzy(f, t, c)):
            out.append((*hit, FUZZY))
        else:
            out.append((None, None, None))
    return out


GROUNDED = EXTRACTION + ", start_pos bigint, end_pos bigint, alignment_status string"


def grounded(responses: DataFrame, fields: list[str], yaml: bool = False, unwrap: bool = False, text_col: str = "text", offset_col: str | None = "char_offset", config: AlignConfig = AlignConfig()) -> DataFrame:
    """Answers beside their texts to a row for each value with its place; without response and text.

    As responses.extractions() and align(), but all values of an answer are placed together, so a text goes through Arrow once and
    is neither repeated for its values nor sent back.
    """

    def make(response: str | None, text: str | None) -> list[tuple]:
        values = parse_rows(response, fields, yaml, unwrap)
        return [(*v, *p) for v, p in zip(values, places([v[2] for v in values], text, config), strict=True)]

    x = explode_rows(responses, ["response", text_col], make, GROUNDED, ("response", text_col))
    if offset_col:
        x = x.withColumn("start_pos", F.col("start_pos") + F.col(offset_col)).withColumn("end_pos", F.col("end_pos") + F.col(offset_col))
    return x


def align(rows: DataFrame, text_col: str = "chunk_text", value_col: str = "extraction_text", offset_col: str | None = "char_offset", config: AlignConfig = AlignConfig()) -> DataFrame:
    """rows with start_pos, end_pos, alignment_status instead of the text: where each value lies in its row's own text, plus the offset.

    The text is on the row (it came through inference with it), so nothing is joined or shuffled. Exact and lesser matches are
    Column expressions; if fuzzy matching is on, the texts of rows without one go through Arrow, those of the others do not. A
    null value or text aligns with nothing.
    """
    fold = (lambda c: c) if config.case_sensitive else F.lower
    t, v = fold(F.col(text_col)), fold(F.col(value_col))
    start = exact_start(v, t).cast("bigint")
    near = lesser(v, t) if config.accept_lesser else F.lit(None).cast("struct<start_pos:bigint,end_pos:bigint>")
    x = rows.withColumn("_e", start).withColumn("_l", F.when(F.col("_e").isNull(), near))
    x = x.withColumn("start_pos", F.coalesce("_e", "_l.start_pos")).withColumn("end_pos", F.coalesce(F.col("_e") + F.length(value_col), F.col("_l.end_pos")))
    x = x.withColumn("alignment_status", F.when(F.col("_e").isNotNull(), EXACT).when(F.col("_l").isNotNull(), LESSER)).drop("_e", "_l")
    if config.fuzzy:

        def make(value, text, s, e, status):
            if value is not None and text is not None and (hit := fuzzy(value, text, config)):
                return [(*hit, FUZZY)]
            return [(s, e, status)]

        names = ("start_pos", "end_pos", "alignment_status")
        unmatched = F.col("alignment_status").isNull()
        x = x.withColumn(text_col, F.when(unmatched, t)).withColumn("_v", F.when(unmatched, v))
        x = explode_rows(x, ["_v", text_col, *names], make, "start_pos bigint, end_pos bigint, alignment_status string", (*names, text_col, "_v"))
    else:
        x = x.drop(text_col)
    if offset_col:
        x = x.withColumn("start_pos", F.col("start_pos") + F.col(offset_col)).withColumn("end_pos", F.col("end_pos") + F.col(offset_col))
    return x


def alignment_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by status and the two rates (1 and 0 where there is nothing)."""
    is_ = lambda s: F.count_if(F.col("alignment_status") == s).alias(s)
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), is_(EXACT), is_(FUZZY), is_(LESSER), is_(GREATER), F.count_if(F.col("alignment_status").isNull()).alias("unaligned"))
    some = F.col("total") > 0
    return g.withColumn("success_rate", F.when(some, (F.col("total") - F.col("unaligned")) / F.col("total")).otherwise(1.0)).withColumn("exact_match_rate", F.when(some, F.col(EXACT) / F.col("total")).otherwise(0.0))
