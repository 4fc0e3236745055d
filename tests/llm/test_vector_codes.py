"""Product codes against every part compared with every entry."""

import hashlib
import math

import numpy as np
import pytest

from quarry.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("n, dim, k, spread", [(1, 4, 3, 5), (17, 4, 64, 3), (400, 32, 64, 2), (1500, 48, 64, 40), (300, 0, 5, 1), (200, 3, 4, 5), (900, 16, 1, 9)])
def test_filtering_assigns_like_brute_force(n, dim, k, spread):
    r = np.random.default_rng(n)
    x, books = (vc.parted(r.integers(-spread, spread + 1, (m, dim)), 16) for m in (n, k))
    code, sums, counts = vc.Trees(x).assign(books)
    want = ((x[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1).argmin(2)
    assert (code == want).all()
    for p in range(16):
        for e in range(k):
            assert counts[p, e] == (want[p] == e).sum() and (sums[p, e] == x[p][want[p] == e].sum(0)).all()


def test_boxes_decide_whole_subtrees(monkeypatch):
    r = np.random.default_rng(0)
    far = [np.zeros((4096, 4), int), np.full((4096, 4), 1000)]
    x = vc.parted(np.tile(np.concatenate(far) + r.integers(0, 9, (8192, 4)), 16), 16)
    monkeypatch.setattr(vc.Trees, "_leaves", lambda self, part, *a: (_ for _ in ()).throw(AssertionError) if len(part) else None)
    code, _, counts = vc.Trees(x).assign(np.stack([np.array([[0] * 4, [1000] * 4])] * 16))
    assert (counts == 4096).all() and (code[:, :4096] == 0).all()


def plain(rows, parts=16, entries=64, rounds=2):
    """{id: (code, error, label error, digest)} of vectors of one length by the definition."""
    kept = [(i, [math.floor(256 * v) for v in x], y) for i, x, y in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: r[0])
    d = len(kept[0][1]) // parts
    cut = lambda x: [x[p * d : p * d + d] for p in range(parts)]
    books = [[cut(x)[p] for _, x, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    nearest = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                own.setdefault(nearest(cut(x)[p], books[p]), []).append(cut(x)[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(books[p])]
    out, by = {}, {}
    for i, x, y in kept:
        code = [nearest(part, book) for part, book in zip(cut(x), books, strict=True)]
        error = sum(far(part, book[e]) for part, book, e in zip(cut(x), books, code, strict=True))
        out[i] = ("".join(f"{e:02x}" for e in code), error, y)
        by[y] = by.get(y, 0) + error
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return {i: (c, e, by[y], sha) for i, (c, e, y) in out.items()}


def test_codes_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(vc, "HOT", 0.2)  # some labels are joined, others broadcast
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=32) / 4).tolist(), (None, 1, 1, 1, 2, 3)[i % 6]) for i in range(260)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]  # ties and copies
    bad = [(2000, None, 1), (2001, [1.0] * 31 + [None], 1), (2002, [math.nan] * 32, 2), (2003, [math.inf] + [0.0] * 31, 2)]
    d = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    got = {x.vec_id: (x.code, x.error, x.label_error, x.codebooks_sha256) for x in vc.compress_vectors(d).collect()}
    assert got == plain(rows)


def test_odd_tables(spark):
    assert vc.compress_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, [0.5] * 16, 1), (5, [0.5] * 16, 1), (None, [1e300] * 16, None), (6, [], 1), (7, [0.25] * 20, 2), (8, [1.0, -1.0], 2)]
    d = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "length").withColumnRenamed("vec_id", "code")
    got = vc.compress_vectors(d, id_col="code", label_col="length").collect()
    assert len(got) == 6 and all(x.error == 0 and len(x.code) == 32 for x in got)
    assert {x.vec_id for x in got} == {5, None, 6, 7, 8} and len({x.codebooks_sha256 for x in got}) == 4


def test_decoded_vectors_lose_what_the_error_says(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=32).tolist(), 0) for i in range(200)]
    d = spark.createDataFrame(rows, SCHEMA)
    books = vc.learn_books(d)
    got = {x.vec_id: x for x in vc.decode(vc.encode(d, books), books, 32).collect()}
    for i, v, _ in rows:
        assert ((np.floor(256 * np.array(v)) - 256 * np.array(got[i].vector)) ** 2).sum() == got[i].error
