"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import periodic
from quarry.llm.queries import repeated_tail


def every_run(w, least=24, times=3):
    """{(start, end): smallest period}, period by period."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                out.setdefault((s, i + p), p)
    return sorted((s, p, e) for (s, e), p in out.items())


def text_of(r, words):
    w = []
    while len(w) < words:
        unit = [r.choice("abcé") for _ in range(r.randint(1, 20))]
        w += (unit * r.randint(1, 9))[: r.randint(1, 100)] if r.random() < 0.6 else [r.choice("abcdefghij") for _ in range(r.randint(1, 30))]
    return w


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (2, 5)])
def test_runs_equal_a_scan_of_every_period(least, times):
    r = random.Random(least)
    for _ in range(40):
        lists = [[c.encode() for c in text_of(r, r.choice((0, 5, 60, 200)))] for _ in range(4)]
        for w, x in zip(lists, periodic._several(lists, least, times), strict=True):
            assert [(s, p, e) for s, e, p in x.tolist()] == every_run(w, least, times)


def test_long_and_hard_sequences():
    morse = [0]
    while len(morse) < 20000:
        morse += [1 - x for x in morse]
    assert len(periodic.runs_of(np.array(morse), len(morse))) == 0  # cubes never occur in it
    assert periodic.runs_of(np.ones(30000, int), 30000).tolist() == [[0, 30000, 1]]
    assert periodic.runs_of(np.array([1, 2] * 10000 + [1] * 5000), 25000).tolist() == [[0, 20001, 2], [20000, 25000, 1]]


def test_a_collision_of_hashes_is_seen(monkeypatch):
    real = periodic.Prefixes
    seeds = []

    class Lying(real):
        def __init__(self, ids, seed):
            super().__init__(ids, seed)
            seeds.append(seed)

        def equal(self, i, j, n):
            return super().equal(i, j, n) | (seeds[-1] == 0)

    monkeypatch.setattr(periodic, "Prefixes", Lying)
    w = np.array([5, 6] * 15 + list(range(10, 40)))
    assert periodic.runs_of(w, len(w)).tolist() == [[0, 30, 2]] and seeds == [0, 1]


def test_digests_equal_brute_force(spark):
    r = random.Random(7)
    docs = [(i, " \n".join(text_of(r, r.choice((0, 10, 80, 400))))) for i in range(60)] + [(100 + i, " ".join(f"w{k}" for k in range(90 + i))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "\x0b\x0c "), (503, " ".join("ab")), (None, "x " * 30), (1, "y " * 24), (1, "y " * 24)]
    got = periodic.run_digests(periodic.find_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), edit=repeated_tail)).collect()
    want = []
    for i, t in docs:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = every_run(w)
        gone = {k for s, p, e in runs for k in range(s + p, e)}
        best = min(runs, key=lambda x: (-Fraction(x[2] - x[0], x[1]), x[0], x[1]), default=None)
        said = "".join(f"{s},{e - s},{p}\n" for s, p, e in runs)
        cells = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
        sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
        want.append((i, len(runs), *cells, sha(said), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(x[1] > 0 for x in want) > 30


def test_ids_of_any_type_clashing_columns_and_empty_tables(spark):
    d = spark.createDataFrame([("a", "k " * 30, 1), (None, None, 2)], "name string, body string, runs int")
    got = {x.doc_id: (x.n_words, len(x.runs), x.collapsed) for x in periodic.find_runs(d, id_col="name", text_col="body").collect()}
    assert got == {"a": (30, 1, "k"), None: (0, 0, "")}
    assert periodic.find_runs(d.limit(0), id_col="name", text_col="body").count() == 0


def test_a_very_long_text(spark):
    words = [f"v{k % 7919}" for k in range(150000)] + ["z", "q", "p"] * 20000
    (x,) = periodic.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert x.n_words == 210000 and [tuple(r) for r in x.runs] == [(0, 150000, 7919), (150000, 60000, 3)]
