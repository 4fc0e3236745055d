"""Personal data: base spans against plain patterns, what the trees add, and whole texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from quarry.llm import personal as P

BITS = (
    "a.b", "@", "@", "c.de", "1.2.3.4", "300.", "+1 (017) 555-7713", "+", "4845168114407329", " ", "-", ".", "(", "٣", "é", "\n", "99", "12-34 ", "x_y%", "-.-", "+49 30 1234567", "0", "..",
    "7536784127813050 4845168114407329",
)


def check_digit(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def by_patterns(text):
    """(start, rank, end) of base spans by the patterns as they are written down."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and check_digit(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m))


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    n = 0
    for _ in range(20000):
        t = "".join(r.choice(BITS) for _ in range(r.randint(1, 9)))
        got = sorted((s, k, e) for k, s, e in P.Base(t).spans)
        assert got == by_patterns(t), t
        n += len(got)
    assert n > 5000


@pytest.mark.parametrize("unit", ["1", "a", "a@", "1.", "1 ", "+1", "a@b.", "123 ", "+1 ( "])
def test_scans_are_linear(unit):
    def seconds(n):
        t, start = unit * n, time.perf_counter()
        many = sum(1 for _ in P.Base(t).proposed(t))
        return time.perf_counter() - start, many

    seconds(2000)
    (a, few), (b, many) = seconds(20000), seconds(100000)
    assert b < 25 * a + 0.2 and many <= 5 * few + 200


def test_trees_learn_and_thresholds_hold_their_precision():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, len(P.FEATURES)))
    y = ((x[:, 3] > 0.2) & (x[:, 7] < 0.8) | (x[:, 5] > 1.5)).astype(float)
    y = np.where(r.random(4000) < 0.02, 1 - y, y)
    t = P.calibrated(P.boosted(x[:2000], y[:2000], P.Settings()), x[2000:3000], y[2000:3000], P.Settings(precision=0.95))
    p = t.probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.95 and y[3000:][p >= t.threshold].mean() > 0.92 and (p >= t.threshold).sum() > 200
    for lo, hi in ((0, 0.2), (0.8, 1.01)):  # probabilities mean what they say
        inside = (p >= lo) & (p < hi)
        assert abs(p[inside].mean() - y[3000:][inside].mean()) < 0.06


def valid_card(r):
    d = "".join(str(r.randrange(10)) for _ in range(15))
    return next(d + str(k) for k in range(10) if check_digit(d + str(k)))


def broken_card(r):
    c = valid_card(r)
    return c[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10)


def corpus(r, n):
    """Texts with valid and invalid numbers among words."""
    words = ["lorem", "ipsum", "dolor", "amet", "sit"]
    made = (
        valid_card, broken_card, lambda r: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", lambda r: f"+{r.randint(10**16, 10**17)}", lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda r: ".".join(str(r.randint(256, 900)) for _ in range(4)), lambda r: f"{r.choice(words)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda r: f"{r.choice(words)}@{r.choice(words)}",
    )
    return [" ".join(r.choice(words) for _ in range(12)) + f" {r.choice(made)(r)} " + " ".join(r.choice(words) for _ in range(12)) for _ in range(n)]


def test_added_spans_are_those_the_patterns_cannot_part(spark):
    r = random.Random(5)
    good = [valid_card(r) for _ in range(8)]
    planted = {
        10001: f"pay {broken_card(r)} {good[0]} now", 10002: f"pay {good[1]} {good[2]} now", 10003: "call +1 (212) 555-0199 10.20.30.40 today", 10004: "write lorem.12 (at) mail3 (dot) example (dot) com please",
        10005: f"the number {broken_card(r)} is wrong", 10010: "from 1990-1995 2001 to 2024-01-15 10", 10011: " ".join(str(r.randrange(1000, 10000)) for _ in range(400)), 10006: "no data at all in this dot", 10007: f"a1b2c3{good[3]}f0e1d2", 10008: None, 10009: "",
    }
    rows = list(enumerate(corpus(r, 1500))) + list(planted.items()) + [(10002, planted[10002])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "spans").repartition(3)
    found = P.find_private(d, text_col="spans").cache()
    by = {}
    for x in found.collect():
        for s in x.spans:
            by.setdefault(x.doc_id, set()).add((s["kind"], x.text[s["start"] : s["end"]], s["base"]))
    assert ("card", good[0], False) in by[10001] and len(by[10001]) == 1
    assert by[10002] == {("card", good[1], False), ("card", good[2], False)}
    assert by[10003] == {("phone", "+1 (212) 555-0199", False), ("ip", "10.20.30.40", True)}
    assert by[10004] == {("email", "lorem.12 (at) mail3 (dot) example (dot) com", False)}
    assert not {10005, 10006, 10008, 10009, 10010, 10011} & by.keys()
    digests = {x.doc_id: x for x in P.private_digests(found).collect()}
    for i, t in rows:
        base = by_patterns(t or "")
        said = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base)
        x = digests[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == n for _, n, _ in base) for k in range(4)]
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(x.spans.split(","))
        if i < 10000:  # nothing is added where the patterns see all there is
            assert x.spans == said
    clean = {x.doc_id: x.text for x in P.redacted(found).collect()}
    assert clean[10003] == "call [phone] [ip] today" and clean[10005] == planted[10005] and clean[10009] == ""
    found.unpersist()


def test_a_table_without_examples_has_base_spans_alone(spark):
    d = spark.createDataFrame([(None, "mail a@b.example or +1 (212) 555-0199 8.8.8.8"), (1, "é 4845168114407329")], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in P.private_digests(P.find_private(d)).collect()}
    assert got == {None: "email:5:16,phone:20:45,ip:38:45", 1: "card:2:18"}
    assert P.find_private(d.limit(0)).count() == 0


def test_overlapping_spans_become_one_when_redacted(spark):
    d = spark.createDataFrame([(1, "x", [(0, 4, "a", 1.0, True), (2, 6, "b", 1.0, True), (6, 8, "c", 1.0, True)])], f"doc_id long, text string, spans {P.SPANS}").selectExpr("doc_id", "'0123456789' AS text", "spans")
    assert P.redacted(d).first().text == "[a][c]89"


def test_all_candidates_teach_the_trees(spark):
    """Over 5,000 candidates of a kind and label, in any number of partitions: trees, scaling and threshold as from all rows at once."""
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(16000, len(P.FEATURES))), 1)
    y = ((x[:, 3] > 0.2) & (x[:, 7] < 0.8) | (x[:, 5] > 1.5)).astype(int)
    y = np.where(r.random(len(y)) < 0.03, 1 - y, y)
    rest = r.random(len(y)) < 0.25
    assert min(y[~rest].sum(), (1 - y)[~rest].sum()) > 3000 and (1 - y)[~rest].sum() > 5000
    rows = spark.createDataFrame([(2, int(a), bool(b), v.tolist(), 1) for a, b, v in zip(y, rest, x, strict=True)], "kind int, y int, rest boolean, x array<double>, n long")
    s = P.Settings(rounds=4, precision=0.9)
    got = P.fit(rows.repartition(3), s)
    want = P.calibrated(P.boosted(x[~rest], y[~rest], s), x[rest], y[rest], s)
    assert (got[2].feature == want.feature).all() and (got[2].cut == want.cut).all() and np.allclose(got[2].value, want.value, atol=1e-5)
    assert np.allclose([got[2].shift, got[2].slope, got[2].threshold], [want.shift, want.slope, want.threshold], atol=1e-4) and want.threshold < 1
    assert all(t.threshold == np.inf for k, t in enumerate(got) if k != 2)
    again = P.fit(rows.repartition(5), s)[2]
    assert (again.value == got[2].value).all() and (again.shift, again.slope, again.threshold) == (got[2].shift, got[2].slope, got[2].threshold)


def test_every_labelled_candidate_is_counted(spark):
    """Over 5,000 of one kind and label in one text."""
    d = spark.createDataFrame([(1, " , ".join(f"300.{i % 250}.{i // 250}.1" for i in range(6000)))], "doc_id long, text string")
    assert sum(x.n for x in P.labelled(d).collect() if (x.kind, x.y) == (P.IP, 0)) == 6000
