import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregate, align, responses, validate
from quarry.schema import ResolverError


def rows(t, fields=(), **more):
    return [(c, v, g) for _, c, v, g in responses.parse_rows(t, list(fields), **more)]


def test_parse():
    assert rows('[{"tree":"oak","rings":"88"}, {"tree":"elm"}]') == [("rings", "88", 0), ("tree", "oak", 0), ("tree", "elm", 1)]
    assert rows('{"data":[{"port":"Bari","ship":"Alba"}]}') == [("port", "Bari", 0), ("ship", "Alba", 0)]
    assert rows("nothing to see {") == [("raw_response", "nothing to see {", None)]
    for fence in ("json", "yaml", "python", "javascript", "rust", ""):
        assert rows(f'```{fence}\n{{"a": 1.0, "b": [1, {{"d": null}}], "c": null, "e": true}}\n```') == [("a", "1.0", None), ("b", '[1,{"d":null}]', None), ("e", "true", None)]
    assert rows('Sure: {"a": "x"} done') == [("a", "x", None)]
    assert rows('["x", {"k": 2}]') == [("item_0", "x", None), ("k", "2", 1)]
    assert rows("[1]") == [("raw_response", "[1]", None)] and rows("3") == [] and rows(None) == []
    assert rows('{"extractions":[{"a":"b"}]}', unwrap=True) == [("a", "b", 0)]
    assert rows("a: 1\nb: x", yaml=True) == [("a", "1", None), ("b", "x", None)]
    assert rows('{"a": 1} {"b": NaN}') == [("raw_response", '{"a": 1} {"b": NaN}', None)]
    with pytest.raises(ResolverError):
        responses.parse("{")


def test_repair():
    assert rows('{"all":"ship = Alba Nova, port- Bari, crew: "}', ["ship", "port", "crew"]) == [("port", "Bari", None), ("ship", "Alba Nova", None)]
    assert rows('{"all":"ship: Alba"}', ["ship", "port"]) == [("all", "ship: Alba", None)]


def test_leaves():
    assert responses.json_leaves({"a": {"b": ["x", "", {"c": "y"}]}, "d": 3}, "r") == [("r:a:b:[0]", "x"), ("r:a:b:[2]:c", "y")]


COERCED = [
    ("42", "integer", 42), ("-7", "integer", -7), ("+8", "integer", 8), ("3.25", "float", 3.25), ("-.5", "float", -0.5), ("6e3", "float", 6000.0), ("Enabled", "boolean", True), ("n", "boolean", False), ("$2 million", "currency", 2e6), ("$4.1M", "currency", 4.1e6),
    ("$12,345", "currency", 12345.0), ("90K", "currency", 9e4), ("$3 billion", "currency", 3e9), ("12.5%", "percentage", 0.125), ("kim@post.example", "email", "kim@post.example"), ("kim@post", "string", None), ("(212) 555-0188", "phone", "(212) 555-0188"),
    ("212.555.0188", "phone", "(212) 555-0188"), ("2125550188", "phone", "(212) 555-0188"), ("212-55", "string", None), ("123456789012345678901", "integer", None), ("http://q.example/r?s", "url", "http://q.example/r?s"), ("1999-12-31", "date", "1999-12-31"),
    ("until March 9, 2031", "date", "until March 9, 2031"), ("", "string", None), ("  17 ", "integer", 17),
]


def test_coercion(spark):
    d = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(COERCED)], "i int, v string").select("i", validate.coerce(F.col("v")).alias("c"))
    for r, (v, kind, value) in zip(d.orderBy("i").collect(), COERCED, strict=True):
        got = next((x for x in (r.c.long_value, r.c.double_value, r.c.bool_value, r.c.string_value) if x is not None), None)
        assert (r.c.target_type, r.c.success) == (kind, value is not None), v
        assert got == (pytest.approx(value) if isinstance(value, float) else value), v


def test_validation(spark):
    d = spark.createDataFrame([(1, 0, "person", "John"), (1, 1, "age", "25"), (1, 2, "age", "26"), (2, 0, "person", " "), (3, 0, "x", "y" * 1001)], "k int, ordinal int, extraction_class string, extraction_text string")
    r = {x.k: x for x in validate.validate(d, ["person", "age", "city", "job"], ["k"], validate.ValidationConfig(True)).collect()}
    assert [e.field_path for e in r[1].errors] == ["city", "job"] and not r[1].is_valid
    assert r[1].corrected_data == '{"age":26,"person":"John"}' and (r[1].successful, r[1].failed) == (2, 1)
    assert "no text" in r[2].warnings[0].message and "only 1 values" in r[2].warnings[1].message and r[2].corrected_data is None
    assert "a text of 1001" in r[3].warnings[0].message


def test_alignment(spark):
    cases = [
        ("red kite", "Above, red kite circles.", 0, (7, 15, "match_exact")), ("RED Kite", "Above, Red kITE circles.", 0, (7, 15, "match_exact")), ("red bird", "Above, red is the wing of that bird.", 0, (0, 10, "match_fuzzy")),
        ("blue heron", "Above, red kite circles.", 0, (None, None, None)), ("kite", "kite up", 40, (40, 44, "match_exact")), ("", "abc", 0, (0, 0, "match_exact")), ("So Far", "So is far", 0, (0, 9, "match_lesser")),
        (None, "a", 0, (None, None, None)), ("a", None, 0, (None, None, None)),
    ]
    d = spark.createDataFrame([(i, v, t, o) for i, (v, t, o, _) in enumerate(cases)], "i int, extraction_text string, chunk_text string, char_offset int")
    got = [(r.start_pos, r.end_pos, r.alignment_status) for r in align.align(d).orderBy("i").collect()]
    assert got == [c[3] for c in cases]


def brute_fuzzy(v, t):
    a, w = v.split(), t.split()
    spans, at = [], 0
    for x in w:
        s = t.index(x, at)
        spans.append((s, s + len(x)))
        at = s + len(x)
    for size in range(len(a), min(len(w), 100) + 1):
        best = max(((sum(x in set(w[i : i + size]) for x in a), -i) for i in range(len(w) - size + 1)), default=(0, 0))
        if a and 5 * best[0] >= 2 * len(a):
            i = -best[1]
            return spans[i][0], spans[i + size - 1][1] if i + size < len(w) else len(t)
    return None


def test_fuzzy_equals_definition():
    import random

    r = random.Random(1)
    for _ in range(400):
        v = " ".join(r.choices("abcdexyz", k=r.randint(0, 5)))
        t = " ".join(r.choices("abcdefgh", k=r.randint(0, 14))) + r.choice(["", " "])
        assert align.fuzzy(v, t) == brute_fuzzy(v, t), (v, t)


def test_stats(spark):
    d = spark.createDataFrame([("match_exact",), ("match_fuzzy",), (None,)], "alignment_status string")
    r = align.alignment_stats(d).first()
    assert r.success_rate == pytest.approx(2 / 3) and r.exact_match_rate == pytest.approx(1 / 3)


def greedy(items):
    kept = []
    for x in items:
        def like(k, x=x):
            a, b = set(k[1].split()), set(x[1].split())
            jac = k[1] == x[1] or 5 * len(a & b) >= 4 * len(a | b)
            return jac and (k[0] == x[0] or k[2] < x[3] and x[2] < k[3])

        if not any(like(k) for k in kept):
            kept.append(x)
    return kept


def test_similar_duplicates(spark):
    import random

    r = random.Random(2)
    items = [(d, i, r.choice("ab"), " ".join(r.choices("pqrst", k=r.randint(0, 6))), s := r.randint(0, 30), s + r.randint(1, 9)) for d in range(12) for i in range(15)]
    got = aggregate.dedupe_similar(spark.createDataFrame(items, "doc_id int, ordinal int, extraction_class string, extraction_text string, start_pos bigint, end_pos bigint"))
    want = {(d, k[4]) for d in range(12) for k in greedy([(c, t, s, e, i) for x, i, c, t, s, e in items if x == d])}
    assert {(x.doc_id, x.ordinal) for x in got.collect()} == want
    again = aggregate.dedupe_similar(got)
    assert again.count() == got.count()


@pytest.mark.parametrize("missing", [0.0, 0.5, 0.95])
def test_places_of_many_values_equal_single_searches(missing):
    r = random.Random(int(10 * missing))
    text = " ".join(r.choice(["pump", "valve", "İx", "shall", "40", "é", "ΑΣ", "straße"]) for _ in range(3000))
    values = []
    for _ in range(400):
        a = r.randrange(len(text) - 30)
        values.append(text[a : a + r.randint(0, 25)] + ("#q" if r.random() < missing else ""))
    values += ["", "pump pump", values[0], "#"]
    assert align.first_places(values, text) == [None if (k := text.find(v)) < 0 else k for v in values]
    assert align._one_pass(list(dict.fromkeys(values)), text) == {v: None if (k := text.find(v)) < 0 else k for v in values}
    assert align._one_pass([], text) == {} and align.first_places([], "") == []


def test_grounded_equals_values_aligned_one_by_one(spark):
    r = random.Random(4)
    words = ["Pump", "valve", "SHALL", "deliver", "40", "litres", "per", "minute"]
    rows = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 40))]
        said = [{"v": " ".join(w[k : k + r.randint(1, 4)][:: r.choice([1, 1, -1, 2])]).lower()} for k in range(0, len(w), 3)] + [{"v": "nothing here"}]
        rows.append((i, 0, " ".join(w), json.dumps(said), 100 * i))
    rows += [(90, 0, None, '{"a": "x"}', 0), (91, 0, "text", None, 0), (92, 0, "not json", "not json", 7)]
    d = spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, response string, char_offset long")
    one = align.align(responses.extractions(d, ["v"]).withColumnRenamed("text", "chunk_text"))
    all_ = align.grounded(d, ["v"])
    assert sorted(all_.columns) == sorted(one.columns)
    assert sorted(map(str, all_.select(*one.columns).collect())) == sorted(map(str, one.collect())) and all_.count() > 300
