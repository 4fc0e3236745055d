import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import content, text
from quarry.operators import chunks, tokens
from quarry.schema import ConfigurationError, InvalidInputError, document_id, interval_length, overlaps, parse_format, token_interval


def sentences(t):
    x = tokens.tokenize(t)
    return [t[x[a].start : x[b - 1].end] for a, b in tokens.sentences(t)]


def cut(t, n):
    return [t[a:b] for a, b in chunks.spans(t, chunks.ChunkConfig(chunks.TOKEN, n, 0))]


def test_tokens():
    assert [(t.text, t.start, t.end, t.kind) for t in tokens.tokenize("ab 12;")] == [("ab", 0, 2, "Word"), ("12", 3, 5, "Number"), (";", 5, 6, "Punctuation")]
    assert [(t.text, t.kind) for t in tokens.tokenize("x7,8")] == [("x", "Word"), ("7", "Number"), (",", "Punctuation"), ("8", "Number")]
    assert [t.text for t in tokens.tokenize("(so?!) ... no-one's") if t.kind == "Punctuation"] == ["(", "?!)", "...", "-", "'"]
    assert [(t.text, t.kind) for t in tokens.tokenize("p/q/r 3km/h //a/ b/")] == [("p/q/r", "Acronym"), ("3km/h", "Number"), ("//", "Punctuation"), ("a", "Word"), ("/", "Punctuation"), ("b", "Word"), ("/", "Punctuation")]
    assert [t.newline for t in tokens.tokenize("\none\r\ntwo three")] == [False, True, False]
    assert [t.text for t in tokens.tokenize("naïve\u3000ß1")] == ["na", "ï", "ve", "ß", "1"]
    assert tokens.tokenize("") == [] and tokens.tokenize(None) == []


def test_intervals():
    t = "No rain, no rainbow. Right?"
    assert tokens.tokens_text(t, tokens.tokenize(t), 1, 4) == "rain, no"
    with pytest.raises(InvalidInputError):
        tokens.tokens_text(t, tokens.tokenize(t), 5, 3)
    with pytest.raises(InvalidInputError, match="Start index 5 must be < end index 3"):
        token_interval(5, 3)


def test_sentences():
    assert sentences("Ask Mrs. Oak at Elm Rd. today! Then rest.") == ["Ask Mrs. Oak at Elm Rd. today!", "Then rest."]
    assert sentences("A list\nÄpfel and pears\nand plums") == ["A list", "Äpfel and pears\nand plums"]
    assert sentences("") == [] and sentences(" \n") == []
    assert tokens.sentences("One two. Three four.", 1) == [(1, 3), (3, 6)] and tokens.sentences("One two.", 3) == []
    with pytest.raises(InvalidInputError):
        tokens.sentences("a", 2)


def plain_tokens(t):
    """Tokens by one pattern, and sentence ends by the rule, one token at a time."""
    import re

    out, last = [], 0
    for m in re.finditer(rf"[A-Za-z0-9]+(?:/[A-Za-z0-9]+)+|[A-Za-z]+|[0-9]+|[^A-Za-z0-9{tokens.SPACE}]+", t):
        gap = t[last : m.start()]
        out.append((m[0], m.start(), m.end(), gap))
        last = m.end()
    ends = []
    for k, (w, _, e, _) in enumerate(out):
        if k == len(out) - 1:
            ends.append(k + 1)
        elif not re.match("[A-Za-z0-9]", w) and w[-1] in ".?!":
            if not (k and out[k - 1][0] + w in tokens.ABBREVIATIONS):
                ends.append(k + 1)
        elif "\n" in out[k + 1][3] and out[k + 1][0][0].isupper():
            ends.append(k + 1)
    return [(w, s, e, bool(k) and bool(re.search("[\r\n]", gap))) for k, (w, s, e, gap) in enumerate(out)], ends


def test_scan_equals_plain_tokens():
    r = random.Random(3)
    bits = ["a", "B", "1", "/", "//", ".", "!", "?", " ", "\n", "\r", "é", "Ü", "Mr", ".", "etc", " ", "😀", "/a", "x1", "\u2003"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 40))) for _ in range(1500)]
    every = tokens.scan(texts)
    for i, t in enumerate(texts):
        want, ends = plain_tokens(t)
        assert [(x.text, x.start, x.end, x.newline) for x in tokens.tokenize(t)] == want, t
        assert [b for _, b in tokens.sentences(t)] == ends, t
        mine = every.text == i
        assert [*zip(every.start[mine].tolist(), every.end[mine].tolist(), strict=True)] == [(s, e) for _, s, e, _ in want]


def test_token_chunks():
    assert cut("Seven small boats drift slowly over a wide and empty lake.", 18) == ["Seven small boats", "drift slowly over", "a wide and empty", "lake."]
    assert cut("a wordwhichislongerthanallowed b.", 8) == ["a", "wordwhichislongerthanallowed", "b."]
    assert cut("the list so far\nmilk and bread and much more", 22) == ["the list so far", "milk and bread and", "much more"]
    assert cut("Go. Stay. Come.", 9) == ["Go. Stay.", "Come."] and cut("Go. Stay. Come.", 99) == ["Go. Stay. Come."]
    assert cut("", 10) == []


@pytest.mark.parametrize("strategy", [chunks.FIXED, chunks.SENTENCE, chunks.PARAGRAPH, chunks.SEMANTIC, chunks.TOKEN])
def test_spans_are_ordered_and_small(strategy):
    t = "One sentence here. Another one, with a clause; and more!\n\nA new paragraph? Yes. " * 9 + "x" * 130
    s = chunks.spans(t, chunks.ChunkConfig(strategy, 60, 0, 10), len)
    tokens_in = [len(tokens.tokenize(t[a:b])) for a, b in chunks.spans(t, chunks.ChunkConfig(chunks.SEMANTIC, 60, 0))]
    assert max(tokens_in) <= 60 < 2 * min(tokens_in[:-1]) + 60
    assert all(0 <= a < b <= len(t) for a, b in s)
    assert all(b <= c for (_, b), (c, _) in zip(s, s[1:], strict=False))
    assert all(b - a <= 60 for a, b in s) or strategy == chunks.TOKEN
    if strategy != chunks.TOKEN:
        assert "".join(t[a:b] for a, b in s) == t


def test_caps_and_tails():
    assert chunks.capped([(0, 5), (5, 9), (9, 12)], 2) == [(0, 5), (5, 12)]
    c = chunks.ChunkConfig(chunks.SENTENCE, 50, 0, 10)
    assert chunks.by_boundaries(23, [20], c) == [(0, 20), (20, 23)]
    assert chunks.by_boundaries(23, [20], chunks.ChunkConfig(chunks.SENTENCE, 50, 0, 10, drop_short_tail=True)) == [(0, 20)]
    with pytest.raises(ConfigurationError):
        chunks.ChunkConfig(max_size=10, overlap=10)


def test_overlap_metadata(spark):
    d = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    rows = chunks.chunks(d, chunks.ChunkConfig(chunks.FIXED, 10, 4)).orderBy("doc_id", "chunk_id").collect()
    assert [r.text for r in rows] == ["abcdefghij", "ghijklmnop", "mnopqrstuv", "stuvwxyz", "yz", "short"]
    assert [(r.overlap_start, r.overlap_end) for r in rows] == [(0, 4), (4, 4), (4, 4), (4, 0), (2, 0), (0, 0)]
    assert spark.sql("select 'overlap test text' t").select(chunks.core_text(F.col("t"), F.lit(3), F.lit(4)).alias("c")).first().c == "rlap test "


def test_normalisation(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(text.squeeze(F.lit("  Hello    world  \n\n  How are you?  "))) == "Hello world How are you?"
    assert one(text.html_to_text(F.lit("<html><body><h1>Hello</h1><p>World</p></body></html>"))) == "Hello World"
    assert one(text.html_escape(F.lit("<a href=\"x\">'&'</a>"))) == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    assert one(text.csv_escape(F.lit('a,"b"'))) == '"a,""b"""' and one(text.csv_escape(F.lit("plain"))) == "plain"
    assert one(text.sanitized(F.lit("  "))) is None
    assert one(text.is_url(F.lit("https://a"))) and not one(text.is_url(F.lit("ftp://a")))
    assert one(document_id(F.lit("x"))).startswith("doc_") and len(one(document_id(F.lit("x")))) == 12
    assert one(overlaps(F.lit(0), F.lit(5), F.lit(3), F.lit(8))) and not one(overlaps(F.lit(0), F.lit(5), F.lit(10), F.lit(15))) and one(overlaps(F.lit(None).cast("int"), F.lit(5), F.lit(3), F.lit(8))) is False
    assert one(interval_length(F.lit(3), F.lit(9))) == 6 and one(interval_length(F.lit(9), F.lit(3))) is None


@pytest.mark.parametrize(("t", "kind"), [('{"a": 1}', "json"), ("[1, 2]", "json"), ("{'a': 1} x", "plain_text"), ("---\na: 1", "yaml"), ("name: x\nage: 3", "yaml"), ("<p>hi</p>", "html"), ("hello", "plain_text"), ("", "plain_text"), (None, "plain_text"), ('{"a": NaN}', "yaml")])
def test_content(t, kind):
    assert content.detect(t) == kind


def test_format():
    assert parse_format("JSON") == "json"
    with pytest.raises(ConfigurationError):
        parse_format("xml")


def test_bpe_sizes_of_parts_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.operators import bpe

    path, library = public_tokenizers.path("byte_bpe_50k.tiktoken"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    r = random.Random(2)
    bits = ["it's", "'stop", "  ", " ", "\n\n", "\t ", "word", "Straße", "ñandú", "1234", "...", "!?", "é", "日本", "a" * 50, " \n ", "don't'll", "_x_", "…", "'", "<|endoftext|>"]
    for _ in range(120):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        size = bpe.sizer(t, path)
        for _ in range(25):
            a = r.randint(0, len(t))
            b = r.randint(a, len(t))
            assert size(a, b) == len(library.encode(t[a:b], add_special_tokens=False).ids), (t, a, b)


def test_bpe_limits_hold_where_nothing_parts_a_text():
    import public_tokenizers

    from quarry.operators import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for t in ("日本語" * 200, "x" * 3000, "a b " * 500, "…" * 7, ""):
        got = chunks.spans(t, chunks.ChunkConfig("semantic", 20, 0, tokenizer=path))
        assert "".join(t[a:b] for a, b in got) == t and all(bpe.count(t[a:b], path) <= 20 for a, b in got)


def test_reports_take_batches_in_slices(spark):
    """No more rows or bytes are taken up at once than a slice has, whatever the batch; rows stay in order, and a long one stands alone."""
    import pyarrow as pa

    from quarry.operators.arrow import ROWS, SLICE, slices
    from quarry.sinks import export

    b = pa.RecordBatch.from_pydict({"i": list(range(5000)), "t": ["x" * (3 * SLICE if i == 77 else 900) for i in range(5000)]})
    parts = list(slices(b))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(5000))
    assert all(p.num_rows <= ROWS and (p.nbytes <= SLICE or p.num_rows == 1) for p in parts)
    d = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('y', 1000) AS text")
    x = d.selectExpr("doc_id", "0 AS ordinal", "'c' AS extraction_class", "'y' AS extraction_text", "0L AS start_pos", "1L AS end_pos", "'match_exact' AS alignment_status")
    made = export.reports(d, x, export.ExportConfig("markdown"))
    assert made.filter("report LIKE '%**y**yyy%'").count() == 3000


def test_scans_take_a_quarter_of_a_million_code_points():
    """A scan holds about 60 bytes for each code point, so a batch of many texts is scanned in parts, and one long text alone."""
    import pyarrow as pa

    from quarry.operators.tokens import pieces

    got = list(pieces(pa.array(["x" * 2000] * 1000 + ["y" * 400_000] + [None])))
    assert [first for first, _ in got] == [0, *(sum(len(t) for _, t in got[:k]) for k in range(1, len(got)))] and sum(len(t) for _, t in got) == 1002
    assert all(sum(map(len, t)) <= 1 << 18 or len(t) == 1 for _, t in got)
