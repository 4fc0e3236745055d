"""Greedy removal of similar values: rounds over all tasks against one pass over each document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregate, similar

SCHEMA = "doc_id long, ordinal int, extraction_class string, extraction_text string, start_pos long, end_pos long"


def values(r, docs, n, words):
    out = []
    for d in docs:
        for i in range(n):
            if out and r.random() < 0.3:  # near an earlier one
                w = (r.choice(out)[3] or "").split()
                if w and r.random() < 0.8:
                    w[r.randrange(len(w))] = r.choice(words)
            else:
                w = [r.choice(words) for _ in range(r.randint(0, 9))]
            s = r.choice([None, r.randint(0, 60)])
            out.append((d, i, r.choice("ab") if r.random() < 0.95 else None, " ".join(w) if r.random() < 0.97 else None, s, None if s is None else s + r.randint(1, 30)))
    return out


def greedy(rows, found, of, position_aware):
    """The definition, row by row."""
    kept, seen = [], set()
    for row in sorted(rows, key=lambda x: x[1]):
        d, _, k, t, s, e = row
        if (same := (k, t, s, e) if position_aware else (k, t)) in seen:
            continue
        seen.add(same)
        w = set((t or "").split())

        def goes(x):
            if x[3] is None or t is None:
                return False
            v = set(x[3].split())
            n = len(w & v) if w or v else 1
            over = None not in (s, e, x[4], x[5]) and x[4] < e and s < x[5]
            return n * of >= (len(w | v) or 1) * found and (over if position_aware or k is None or k != x[2] else True)

        if not any(goes(x) for x in kept):
            kept.append(row)
    return kept


@pytest.mark.parametrize("position_aware, few", [(False, 64), (True, 64), (False, 0), (True, 0)])
def test_rounds_equal_the_definition(spark, monkeypatch, position_aware, few):
    monkeypatch.setattr(aggregate, "WHOLE", 30)
    monkeypatch.setattr(similar, "FEW", few)  # 0: rounds first, until they decide little
    monkeypatch.setattr(similar, "TILE", 7)
    r = random.Random(few)
    rows = values(r, (1, 2, None), 120, [f"w{i}" for i in range(14)]) + values(r, (3, 4), 8, ["x", "y"])
    d = spark.createDataFrame(rows, SCHEMA).withColumn("attributes", F.create_map(F.lit("k"), "ordinal")).repartition(3)
    got = aggregate.dedupe_similar(d, position_aware=position_aware)
    assert got.columns == d.columns
    want = [x for k in (1, 2, 3, 4, None) for x in greedy([v for v in rows if v[0] == k], 4, 5, position_aware)]
    assert sorted(map(str, (tuple(x)[:6] for x in got.collect()))) == sorted(map(str, want))


def test_many_values_under_one_id(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    n = 100_000
    rows = [(7, i, "a", " ".join(["same", "words", "in", "each", "value", "but", "one", "of", "them", f"n{i}"] if i % 3 == 0 else r.choices(words, k=r.randint(2, 6))), None, None) for i in range(n)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(8).cache()
    start = time.time()
    got = {x.ordinal for x in aggregate.dedupe_similar(d).select("ordinal").collect()}
    took = time.time() - start
    want = {x.ordinal for x in aggregate._in_one_task(aggregate._first_of(d, ["doc_id", "extraction_class", "extraction_text"], ("ordinal",)), "doc_id", ["ordinal"], (4, 5), False).select("ordinal").collect()}
    assert got == want and sum(i % 3 == 0 for i in got) == 1 and took < 300
    d.unpersist()
