"""Every query against DuckDB on the smallest tables; the three that SQL cannot express against what they promise."""

import glob
import math
import os

import duckdb
import pytest

from quarry.operators import tokens
from quarry.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def same(spark_rows, sql_rows):
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(spark_rows) == key(sql_rows)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    same([tuple(r) for r in df.select(*cols).collect()], [tuple(r[i] for i in order) for r in got.fetchall()])


def test_only_these_have_no_sql():
    assert core.queries().keys() - core.oracle_sql().keys() == {"chunk_semantic", "chunk_semantic_bpe", "content_type"}


def test_semantic_chunks_cover_the_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in core.queries()["chunk_semantic"](spark, SF).orderBy("doc_id", "chunk_id").collect():
        assert r.char_offset == len(got.get(r.doc_id, "")) and 0 < r.char_length == len(r.text) and len(tokens.tokenize(r.text)) <= 1000
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == {i: t for i, t in texts.items() if t}


def test_bpe_chunks_cover_the_texts_within_their_limit(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, sizes = {}, {}
    for r in core.queries()["chunk_semantic_bpe"](spark, SF).orderBy("doc_id", "chunk_id").collect():
        assert r.char_offset == len(got.get(r.doc_id, "")) and 0 < r.char_length == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
        sizes.setdefault(r.doc_id, []).append(len(library.encode_ordinary(r.text)))
    assert got == {i: t for i, t in texts.items() if t} and max(map(max, sizes.values())) <= 256
    many = [n for x in sizes.values() if len(x) > 3 for n in x[:-1]]
    assert sum(many) / len(many) > 128  # packed, not crumbled


def test_content_types_equal_the_detector(spark):
    from collections import Counter

    from quarry.functions.content import detect

    want = Counter()
    for origin, table, column in (("page", "pages", "html"), ("event", "events", "props"), ("document", "documents", "text")):
        want.update((origin, detect(r[0])) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(column).collect())
    assert {(r.origin, r.content_type): r.n for r in core.queries()["content_type"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
