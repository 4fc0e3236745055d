"""Near-duplicate groups against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import jaccard
from quarry.llm.common import union_roots


def sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("tile", [6])
def test_groups_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(2000)}"
    head = [word() for _ in range(40)]
    texts = [None, "", " \n", "a b", "A  b", "a b c d e f", "a b c d e g"]
    for _ in range(12):
        base = head + [word() for _ in range(r.randint(20, 250))]
        for _ in range(8):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 40))):
                x[r.randrange(len(x))] = word()
            texts.append(" ".join(x))
    s = [sets(t) for t in texts]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    root = union_roots(len(s), *np.array(pairs).T)
    assert len(set(root.tolist())) < len(s) - 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in jaccard.similar_groups(docs).collect()} == dict(enumerate(root.tolist()))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(root.tolist()))


def test_long_texts_that_share_a_passage_give_no_square_of_pairs(spark, monkeypatch):
    r = random.Random(10)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = words(60)
    texts = []
    for _ in range(30):  # of 1000 to 1100 shingles, where 384 bits say nothing any more
        w = words(r.randint(940, 1040))
        at = r.randrange(len(w))
        texts.append(" ".join(w[:at] + passage + w[at:]))
    texts += [f"{texts[0]} one more", f"{texts[1]} another"]
    tables = []

    def written(df, name):
        out = kept(df, name)
        if name == "pairs":
            tables.append(out.count())
        return out

    kept = jaccard.written
    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)  # the passage is not common in so small a sample
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in jaccard.similar_groups(docs, radius=0).collect()}
    assert got == {i: {30: 0, 31: 1}.get(i, i) for i in range(32)}
    assert len(tables) == 2 and sum(tables) <= 8, tables


def test_pairs_that_are_alike_pass_every_filter():
    r = np.random.default_rng(11)
    common, rank = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    met = 0
    for k in range(400):
        size = int(r.integers(1, 900))
        base = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
        a, b = (np.unique(np.r_[base[r.random(len(base)) > 0.04], r.integers(0, 1 << 63, size // 40).astype(np.uint64)]) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if not both or both < 0.8 * (len(a) + len(b) - both):
            continue
        met += 1
        x, y = (jaccard.prefix(v, common, rank, 0.8)[0] for v in (a, b))
        _, i, j = np.intersect1d(x, y, return_indices=True)
        n, at = np.array([len(a), len(b)]), np.array([i.min(), j.min()])
        assert jaccard.first_here(n, at, 0, 2, 0.8)[0, 1], k
        maps = np.array([jaccard.wide(a), jaccard.wide(b), None], object)[:2]
        assert jaccard.possible_pairs(maps, np.array([len(m) for m in maps]), n, np.array([0]), np.array([1]), 0.8)[0], k
    assert met > 100
