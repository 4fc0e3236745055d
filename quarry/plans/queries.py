"""Queries over the test tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import ExtractConfig, MultiPassConfig
from quarry.functions import text as texts
from quarry.functions.content import with_content_type
from quarry.functions.register import register
from quarry.operators import aggregate, align, chunks, responses, tokens, validate
from quarry.plans import engine, pipeline, prompts
from quarry.schema import EXACT, FUZZY, LESSER, Example, Extraction, document_id, interval_length, overlaps
from quarry.sinks import export
from quarry.sources.models import InferenceConfig, RuleModel, Scored
from quarry.sources.readers import ANNOTATED, annotated_rows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

RULES = {"email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "number": r"[0-9]{3,}"}
SPEC = engine.Spec("List e-mail addresses and long numbers.", (Example("Write to a.b@c.org or call 5551234.", (Extraction("email", "a.b@c.org"), Extraction("number", "5551234"))),))
TEMPLATE = prompts.PromptTemplate(SPEC.description, SPEC.examples)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(table: str, key: str = "doc_id", text: str = "text") -> str:
    """The tokens of a column as the CTE tok: gaps and tokens of every match, with offsets by running sums."""
    p = r"(\s*)([A-Za-z0-9]+(?:/[A-Za-z0-9]+)+|[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]+)"
    return rf"""
t AS (SELECT {key}, regexp_extract_all({text}, '{p}', 1) g, regexp_extract_all({text}, '{p}', 2) w FROM {table}),
u AS (SELECT {key}, unnest(g) g, unnest(w) w, generate_subscripts(w, 1) - 1 AS i FROM t),
tok AS (SELECT {key}, i, w, g, sum(length(g) + length(w)) OVER (PARTITION BY {key} ORDER BY i) AS e,
               i > 0 AND regexp_matches(g, '[\n\r]') AS nl,
               CASE WHEN regexp_matches(w, '[0-9]') THEN 'Number' WHEN contains(w, '/') AND regexp_full_match(w, '[A-Za-z0-9]+(/[A-Za-z0-9]+)+') THEN 'Acronym'
                    WHEN regexp_full_match(w, '[A-Za-z]+') THEN 'Word' ELSE 'Punctuation' END AS kind FROM u)
"""


TOKENS_SQL = tokens_sql("documents")
ABBREVIATED = ", ".join(quoted(a) for a in sorted(tokens.ABBREVIATIONS))


# ---- text ------------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", texts.squeeze(F.col("text")).alias("normalized"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("plain"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", texts.html_escape(F.col("html")).alias("escaped"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[,\"\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell FROM documents")
def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", texts.csv_escape(F.col("text")).alias("cell"))


@query("SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS url_ok, html LIKE 'http://%' AS html_ok FROM pages")
def is_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", texts.is_url(F.col("url")).alias("url_ok"), texts.is_url(F.col("html")).alias("html_ok"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents")
def word_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(texts.words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT doc_id, 'doc_' || substr(sha256(text), 1, 8) AS auto_id FROM documents")
def auto_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", document_id(F.col("text")).alias("auto_id"))


@query()
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    d = d.unionByName(_t(spark, sf_dir, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), F.col("props").alias("text")))
    d = d.unionByName(_t(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text"))
    return with_content_type(d).groupBy("origin", "content_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'plain_text' END AS content_type FROM events")
def content_type_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_content_type(_t(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "content_type")


@query("SELECT a.doc_id, a.n_chars > 1000 AS near, CASE WHEN a.n_chars >= 1000 THEN a.n_chars - 1000 END AS span FROM documents a")
def interval_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = _t(spark, sf_dir, "documents"), F.col("n_chars")
    return d.select("doc_id", overlaps(F.lit(0), n, F.lit(1000), F.lit(3000)).alias("near"), interval_length(F.lit(1000), n).alias("span"))


# ---- tokens and sentences ------------------------------------------------------------------------------------------------------


@query(
    "WITH " + TOKENS_SQL + """SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (kind = 'Word') AS BIGINT) AS n_words,
    CAST(count(*) FILTER (kind = 'Number') AS BIGINT) AS n_numbers, CAST(count(*) FILTER (kind = 'Acronym') AS BIGINT) AS n_acronyms,
    CAST(sum(e - length(w)) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end, CAST(count(*) FILTER (nl) AS BIGINT) AS n_after_newline
    FROM tok GROUP BY doc_id"""
)
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.tokens(_t(spark, sf_dir, "documents"), with_text=False)
    kind = lambda k: F.count_if(F.col("token_type") == k)
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), kind("Word").alias("n_words"), kind("Number").alias("n_numbers"), kind("Acronym").alias("n_acronyms"),
        F.sum("start_pos").alias("sum_start"), F.sum("end_pos").alias("sum_end"), F.count_if("first_token_after_newline").alias("n_after_newline"),
    )


#: Sentences as the CTE s: tokens with the number k of their sentence.
SENTENCES_SQL = TOKENS_SQL + f""", b AS (SELECT *, lead(g) OVER o AS ng, lead(w) OVER o AS nw, coalesce(lag(w) OVER o, '') || w AS two FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    f AS (SELECT *, CASE WHEN kind = 'Punctuation' AND regexp_matches(w, '[.?!]$') THEN NOT (i > 0 AND two IN ({ABBREVIATED}))
                         ELSE coalesce(contains(ng, chr(10)) AND regexp_matches(nw, '^\\p{{Lu}}'), false) END AS fin FROM b),
    s AS (SELECT *, coalesce(sum(CASE WHEN fin THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM f)"""


@query(
    "WITH " + SENTENCES_SQL + """ SELECT s.doc_id, CAST(k AS INTEGER) AS sentence_index, CAST(min(i) AS INTEGER) AS token_start, CAST(max(i) + 1 AS INTEGER) AS token_end,
           CAST(min(e - length(w)) AS BIGINT) AS start_pos, CAST(max(e) AS BIGINT) AS end_pos,
           substr(any_value(d.text), CAST(min(e - length(w)) + 1 AS BIGINT), CAST(max(e) - min(e - length(w)) AS BIGINT)) AS text FROM s JOIN documents d ON d.doc_id = s.doc_id GROUP BY s.doc_id, k"""
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sentence_rows(_t(spark, sf_dir, "documents"))


@query("WITH " + tokens_sql("part", "p_partkey", "p_name") + " SELECT p_partkey, CAST(i AS INTEGER) AS token_index, w AS token_text, kind AS token_type, nl AS first_token_after_newline FROM tok")
def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(_t(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", "token_index", "token_text", "token_type", "first_token_after_newline")


# ---- chunks --------------------------------------------------------------------------------------------------------------------

FIXED_SQL = """c AS (SELECT doc_id, text, length(text) AS n, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 900) END) AS p,
 CASE WHEN length(text) <= 1000 THEN 1 ELSE 0 END AS whole FROM documents WHERE length(text) > 0),
f AS (SELECT doc_id, CAST(p / 900 AS INTEGER) AS chunk_id, substr(text, CAST(p + 1 AS BIGINT), least(p + 1000, n) - p) AS text, CAST(p AS BIGINT) AS char_offset, CAST(least(p + 1000, n) - p AS BIGINT) AS char_length,
 whole, n, p FROM c)"""


@query(
    "WITH " + FIXED_SQL + """ SELECT doc_id, chunk_id, text, char_offset, char_length,
    whole = 0 AND (chunk_id > 0 OR p + 1000 < n) AS has_overlap, CAST(CASE WHEN whole = 0 AND chunk_id > 0 THEN least(100, n - p) ELSE 0 END AS INTEGER) AS overlap_start,
    CAST(CASE WHEN whole = 0 AND p + 1000 < n THEN 100 ELSE 0 END AS INTEGER) AS overlap_end FROM f"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(_t(spark, sf_dir, "documents"), chunks.ChunkConfig(chunks.FIXED, 1000, 100))


@query(
    "WITH " + FIXED_SQL + """, g AS (SELECT doc_id, least(chunk_id, 1) AS chunk_id, min(char_offset) AS char_offset, max(char_offset + char_length) AS e FROM f GROUP BY ALL)
    SELECT g.doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, substr(d.text, char_offset + 1, e - char_offset) AS text, char_offset, CAST(e - char_offset AS BIGINT) AS char_length FROM g JOIN documents d USING (doc_id)"""
)
def chunk_merge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.chunks(_t(spark, sf_dir, "documents"), chunks.ChunkConfig(chunks.FIXED, 1000, 100, max_chunks=2))
    return c.select("doc_id", "chunk_id", "text", "char_offset", "char_length")


def _chunked(strategy: str, **more) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunks.chunks(_t(spark, sf_dir, "documents"), chunks.ChunkConfig(strategy, 1000, 0, **more))

    return run


def _boundary_sql(pattern: str) -> str:
    """The fold over boundaries as a recursion: a section closes once it is long enough, is the first, or is the last."""
    return f"""WITH RECURSIVE g AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '(?s)(.*?)({pattern})', 1) AS a, regexp_extract_all(text, '(?s)(.*?)({pattern})', 2) AS b FROM documents WHERE length(text) > 0),
    u AS (SELECT doc_id, n, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS i FROM g WHERE n > 1000),
    p AS (SELECT doc_id, n, sum(length(x) + length(y)) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM u UNION SELECT doc_id, n, n FROM g),
    e AS (SELECT doc_id, n, CAST(pos AS BIGINT) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM p),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS done, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM g
      UNION ALL SELECT doc_id, k, CASE WHEN take THEN pos ELSE start END, done + CASE WHEN take THEN 1 ELSE 0 END, CASE WHEN take THEN start END, CASE WHEN take THEN pos END FROM (
        SELECT e.doc_id, e.k, e.pos, w.start, w.done, e.pos - w.start >= 100 OR w.done = 0 OR e.pos = e.n AS take FROM w JOIN e ON e.doc_id = w.doc_id AND e.k = w.k + 1)),
    c AS (SELECT doc_id, unnest(range(a, b, 1000)) AS o, b FROM w WHERE a IS NOT NULL)
    SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY o) - 1 AS INTEGER) AS chunk_id, o AS char_offset, least(1000, b - o) AS char_length, substr(d.text, o + 1, least(1000, b - o)) AS text,
      false AS has_overlap, CAST(0 AS INTEGER) AS overlap_start, CAST(0 AS INTEGER) AS overlap_end FROM c JOIN documents d USING (doc_id)"""


def _greedy_sql(size: int) -> str:
    """Greedy chunks of whole sentences as the CTEs up to w: a recursion over chunks, each from the tokens that can be in it."""
    return "WITH RECURSIVE " + SENTENCES_SQL + f""", k AS (SELECT doc_id, i, e - length(w) AS s, e, nl, max(i) OVER (PARTITION BY doc_id, k) + 1 AS aft, lag(e) OVER (PARTITION BY doc_id ORDER BY i) AS pe FROM s),
    w AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS pos, false AS rest, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM k
      UNION ALL SELECT doc_id, CAST(stop AS BIGINT), CASE WHEN lone THEN stop < aft ELSE wide END, CAST(pos AS BIGINT), CAST(stop AS BIGINT) FROM (
        SELECT *, beyond IS NOT NULL AS wide, CASE WHEN lone THEN pos + 1 WHEN beyond IS NOT NULL THEN coalesce(brk, beyond) WHEN rest THEN aft ELSE packed END AS stop FROM (
          SELECT w.doc_id, w.pos, w.rest, f.aft, f.e - f.s > {size} AS lone, min(t.i) FILTER (t.i < f.aft AND t.e - f.s > {size}) AS beyond,
            max(t.i) FILTER (t.nl AND t.i > w.pos AND t.i < f.aft AND t.pe - f.s <= {size}) AS brk, max(t.aft) FILTER (t.i = t.aft - 1 AND t.e - f.s <= {size}) AS packed
          FROM w JOIN k f ON f.doc_id = w.doc_id AND f.i = w.pos JOIN k t ON t.doc_id = w.doc_id AND t.i >= w.pos AND t.i <= w.pos + {size} + 1
          GROUP BY w.doc_id, w.pos, w.rest, f.aft, f.e, f.s))),
    spans AS (SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.a) - 1 AS chunk_id, CAST(x.s AS BIGINT) AS o, CAST(y.e AS BIGINT) AS e
      FROM w JOIN k x ON x.doc_id = w.doc_id AND x.i = w.a JOIN k y ON y.doc_id = w.doc_id AND y.i = w.b - 1)"""


for _name, _strategy in (("chunk_sentence", chunks.SENTENCE), ("chunk_paragraph", chunks.PARAGRAPH), ("chunk_semantic", chunks.SEMANTIC), ("chunk_token", chunks.TOKEN)):
    _QUERIES[_name] = _chunked(_strategy)
_SQL["chunk_token"] = _greedy_sql(1000) + """ SELECT spans.doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, substr(d.text, o + 1, e - o) AS text, o AS char_offset, e - o AS char_length, false AS has_overlap,
    CAST(0 AS INTEGER) AS overlap_start, CAST(0 AS INTEGER) AS overlap_end FROM spans JOIN documents d USING (doc_id)"""
_SQL["chunk_sentence"], _SQL["chunk_paragraph"] = _boundary_sql(r"[.!?]+\s+"), _boundary_sql(r"\n\s*\n")


@query()
def chunk_semantic_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks of at most 256 tokens of a public vocabulary."""
    import public_tokenizers

    c = chunks.ChunkConfig(chunks.SEMANTIC, 256, 0, tokenizer=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return chunks.chunks(_t(spark, sf_dir, "documents"), c).select("doc_id", "chunk_id", "text", "char_offset", "char_length")


@query(
    "WITH " + FIXED_SQL + """, o AS (SELECT doc_id, chunk_id, text, CASE WHEN whole = 0 AND chunk_id > 0 THEN least(100, n - p) ELSE 0 END AS a, CASE WHEN whole = 0 AND p + 1000 < n THEN 100 ELSE 0 END AS b FROM f)
    SELECT doc_id, chunk_id, substr(text, CAST(a + 1 AS BIGINT), greatest(0, length(text) - a - b)) AS core FROM o"""
)
def chunk_core_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.chunks(_t(spark, sf_dir, "documents"), chunks.ChunkConfig(chunks.FIXED, 1000, 100))
    return c.select("doc_id", "chunk_id", chunks.core_text(F.col("text"), F.col("overlap_start"), F.col("overlap_end")).alias("core"))


# ---- prompts and inference -----------------------------------------------------------------------------------------------------

_HEAD = """List e-mail addresses and long numbers.

You extract information from texts with care and copy values exactly as they are written. Answer with valid JSON of the same structure as in the examples.

Examples:
Example 1:
Input: Write to a.b@c.org or call 5551234.
Output:
{
  "email": "a.b@c.org",
  "number": "5551234"
}


Now take the values from this text:

Input: """
_TAIL = "\n\nOutput (JSON):\n"


@query(f"SELECT doc_id, {quoted(_HEAD)} || text || {quoted(_TAIL)} AS prompt FROM documents")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.prompts(_t(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATE).select("doc_id", "prompt")


_LOCAL_HEAD, _LOCAL_MIDDLE = _HEAD.split("\n\nExamples:")


@query(
    f"""SELECT doc_id, {quoted(_LOCAL_HEAD + chr(10) + "One object for each address." + chr(10) * 2 + "Additional Context: ")} || lang || chr(10) || {quoted(chr(10) * 2 + "Examples:" + _LOCAL_MIDDLE.split(chr(10) * 2 + "Now take")[0])}
    || {quoted(chr(10) * 2 + "Work in steps:" + chr(10) + "1. Read the whole text" + chr(10) + "2. Find what is asked for" + chr(10) + "3. Give it in the form of the examples" + chr(10) * 2 + "Now take the values from this text:" + chr(10) * 2 + "Input: ")}
    || text || {quoted(_TAIL)} AS prompt FROM documents"""
)
def prompt_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for a local model: it is asked to reason, and gets a hint of the structure and each row's own context."""
    t = replace(prompts.PromptTemplate.for_provider("ollama", SPEC.description, SPEC.examples), schema_hint="One object for each address.")
    return prompts.prompts(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), t, context_col="lang").select("doc_id", "prompt")


def _rules_sql(pieces: str) -> str:
    """The rule model's answers as the CTE v: every match of the table `pieces` (doc_id, chunk_id, text, o), by place, then class."""
    parts = []
    for k, r in RULES.items():
        p = quoted(f"(?s)(.*?)({r}|$)")
        parts.append(f"""SELECT doc_id, chunk_id, text, o, '{k}' AS extraction_class, w AS extraction_text, upto - length(w) AS place FROM (
          SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY doc_id, chunk_id ORDER BY i) AS upto FROM (
            SELECT doc_id, chunk_id, text, o, unnest(regexp_extract_all(text, {p}, 1)) AS g, unnest(regexp_extract_all(text, {p}, 2)) AS w, generate_subscripts(regexp_extract_all(text, {p}, 2), 1) AS i FROM {pieces})) WHERE w <> ''""")
    return f"""m AS ({' UNION ALL '.join(parts)}),
    v AS (SELECT doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY place, extraction_class) - 1 AS INTEGER) AS ordinal, extraction_class, extraction_text,
      CAST(o + strpos(lower(text), lower(extraction_text)) - 1 AS BIGINT) AS start_pos, CAST(o + strpos(lower(text), lower(extraction_text)) - 1 + length(extraction_text) AS BIGINT) AS end_pos FROM m)"""


_RULE_ROWS = "one AS (SELECT doc_id, 0 AS chunk_id, text, 0 AS o FROM documents WHERE length(text) > 0), " + _rules_sql("one")


def _chunked_rules_sql(size: int) -> str:
    """extract() with rules over greedy chunks, as the CTE x: values of several chunks keep the first of each class and text."""
    return _greedy_sql(size) + f""", pc AS (SELECT spans.doc_id, chunk_id, substr(d.text, o + 1, e - o) AS text, o FROM spans JOIN documents d USING (doc_id) WHERE length(d.text) > {size}
      UNION ALL SELECT doc_id, 0, text, 0 FROM documents WHERE length(text) BETWEEN 1 AND {size}), """ + _rules_sql("pc") + f""",
    r AS (SELECT v.*, row_number() OVER (PARTITION BY v.doc_id, extraction_class, extraction_text ORDER BY chunk_id, ordinal) AS nth, length(d.text) <= {size} AS single FROM v JOIN documents d USING (doc_id)),
    x AS (SELECT *, (50 + 30 + CASE WHEN length(extraction_text) <= 100 THEN 20 ELSE -10 END + CASE WHEN extraction_class = 'email' THEN 10 ELSE 0 END + CASE WHEN regexp_matches(extraction_text, '[0-9]') THEN 5 ELSE 0 END) AS points FROM r WHERE single OR nth = 1)"""


def _rule_config(**more) -> ExtractConfig:
    return ExtractConfig(RuleModel(RULES), max_char_buffer=1_000_000, **more)


@query("WITH " + _RULE_ROWS + " SELECT doc_id, ordinal, extraction_class, extraction_text, start_pos, end_pos, 'match_exact' AS alignment_status FROM v")
def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, model, parse, align, coerce and score, end to end."""
    r = engine.extract(_t(spark, sf_dir, "documents"), SPEC, _rule_config())
    return r.extractions.select("doc_id", "ordinal", "extraction_class", "extraction_text", "start_pos", "end_pos", "alignment_status")


@query("WITH " + _RULE_ROWS + " SELECT extraction_class, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.class_counts(engine.extract(_t(spark, sf_dir, "documents"), SPEC, _rule_config()).extractions)


class FirstWords:
    """Gives the first words of a text: one, and one more for each class that it is told was found before."""

    def infer(self, asked: list[str], config: InferenceConfig) -> list[list[Scored]]:
        out = []
        for p in asked:
            head, _, text = p.rpartition("\n\nInput: ")
            words = texts.first_words(text[: text.rfind("\n\nOutput (")], head.count("\n- ") + 1)
            out.append([Scored(json.dumps({f"c{i}": w for i, w in enumerate(words)}))])
        return out


class Told:
    """Gives back the context that it is told beside a text, under the class `said`."""

    def infer(self, asked: list[str], config: InferenceConfig) -> list[list[Scored]]:
        said = (p.partition("\n\nAdditional Context: ")[2].partition("\n")[0] for p in asked)
        return [[Scored(json.dumps({"said": x}, ensure_ascii=False))] for x in said]


@query("SELECT nullif(source, (SELECT min(source) FROM documents)) AS doc_id, 'the text numbered ' || doc_id AS extraction_text, CAST(count(*) AS BIGINT) AS n FROM documents WHERE length(text) > 0 GROUP BY ALL")
def extract_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's own context reaches its prompts and no others, though ids are repeated (sources stand for them) or null; similar
    values of several chunks become one."""
    d = _t(spark, sf_dir, "documents")
    first = d.agg(F.min("source")).first()[0]
    d = d.select(F.nullif("source", F.lit(first)).alias("doc_id"), "text", F.concat(F.lit("the text numbered "), "doc_id").alias("additional_context"))
    r = engine.extract(d, SPEC, ExtractConfig(Told(), max_char_buffer=1000))
    return r.extractions.groupBy("doc_id", "extraction_text").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, 1 AS pass_number, w[1] AS extraction_text FROM w WHERE len(w) > 0
      UNION ALL SELECT doc_id, 2, w[2] FROM w WHERE len(w) > 1 AND w[2] <> w[1] UNION ALL SELECT doc_id, 3, w[3] FROM w WHERE len(w) > 2 AND w[2] <> w[1] AND w[3] NOT IN (w[1], w[2])),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(extraction_text) ORDER BY pass_number) AS n FROM p)
    SELECT doc_id, CAST(pass_number AS INTEGER) AS pass_number, extraction_text FROM f WHERE n = 1"""
)
def multipass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes of a model that finds one more value each time it is told what it has found."""
    c = ExtractConfig(FirstWords(), max_char_buffer=1_000_000, multipass=MultiPassConfig(3))
    return engine.extract(_t(spark, sf_dir, "documents"), SPEC, c).extractions.select("doc_id", "pass_number", "extraction_text")


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE length(text) > 0),
    p AS (SELECT doc_id, 1 AS pass_number, w[1] AS t FROM w WHERE len(w) > 0 UNION ALL SELECT doc_id, 2, w[2] FROM w WHERE len(w) > 1 AND w[2] <> w[1] UNION ALL SELECT doc_id, 3, w[3] FROM w WHERE len(w) > 2 AND w[2] <> w[1] AND w[3] NOT IN (w[1], w[2])),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY pass_number) AS n FROM p),
    a AS (SELECT doc_id, 1 AS pass_number FROM w UNION ALL SELECT doc_id, 2 FROM w WHERE len(w) > 0 UNION ALL SELECT doc_id, 3 FROM w WHERE len(w) > 1 AND w[2] <> w[1])
    SELECT a.doc_id, CAST(a.pass_number AS INTEGER) AS pass_number, CAST(1 AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS failed, CAST(count(f.doc_id) AS BIGINT) AS new FROM a LEFT JOIN f ON f.doc_id = a.doc_id AND f.pass_number = a.pass_number AND f.n = 1 GROUP BY ALL"""
)
def pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pass asked and found; a document whose pass finds nothing new is not asked again."""
    c = ExtractConfig(FirstWords(), max_char_buffer=1_000_000, multipass=MultiPassConfig(3))
    r = engine.extract(_t(spark, sf_dir, "documents"), SPEC, c)
    return aggregate.pass_stats(r.responses, r.extractions).drop("latency_ms")


@query(
    f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, n <= 1000 AS single, i AS chunk_id, CASE WHEN n <= 1000 THEN text ELSE substr(text, CAST(1000 * i + 1 AS BIGINT), 1000) END AS t FROM d, LATERAL (SELECT unnest(range(CASE WHEN n <= 1000 THEN 1 ELSE (n + 999) // 1000 END)) AS i)),
    m AS (SELECT doc_id, single, chunk_id, len(regexp_extract_all(t, '{RULES["email"]}')) + len(regexp_extract_all(t, '{RULES["number"]}')) AS raw FROM c),
    a AS (SELECT doc_id FROM m GROUP BY doc_id HAVING sum(raw) > 0),
    k AS (SELECT doc_id, chunk_id FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS n FROM m WHERE NOT single AND raw < 2) WHERE n <= 3)
    SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(1 AS INTEGER) AS pass_number FROM m UNION ALL SELECT doc_id, CAST(chunk_id AS INTEGER), 2 FROM m SEMI JOIN a USING (doc_id) WHERE single
      UNION ALL SELECT doc_id, CAST(chunk_id AS INTEGER), 2 FROM k SEMI JOIN a USING (doc_id)"""
)
def multipass_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two passes over chunks ask: the second one only documents that gave anything, and of their chunks the first three of low yield."""
    c = ExtractConfig(RuleModel(RULES), max_char_buffer=1000, chunking=chunks.ChunkConfig(chunks.FIXED, 1000, 0), multipass=MultiPassConfig(2, min_extractions=2, max_reprocess=3))
    return engine.extract(_t(spark, sf_dir, "documents"), SPEC, c).responses.select("doc_id", "chunk_id", "pass_number")


@query(_chunked_rules_sql(1000) + " SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, ordinal, extraction_class, extraction_text, start_pos, end_pos, least(points, 100) / 100.0 AS quality_score FROM x")
def extract_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over chunks of whole sentences, with the removal of similar values."""
    r = engine.extract(_t(spark, sf_dir, "documents"), SPEC, ExtractConfig(RuleModel(RULES), max_char_buffer=1000))
    return r.extractions.select("doc_id", "chunk_id", "ordinal", "extraction_class", "extraction_text", "start_pos", "end_pos", "quality_score")


# ---- answers -------------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, 'name' AS extraction_class, c_name AS extraction_text FROM customer UNION ALL SELECT c_custkey, 'raw_response', '```rust no JSON ' || c_name || ' ```' FROM customer")
def response_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences around an answer go before it is parsed; an answer that is no JSON stays as it came."""
    c = _t(spark, sf_dir, "customer")
    said = F.array(F.concat(F.lit("\n```json\n{\"name\": \""), "c_name", F.lit("\"}\n```\n ")), F.concat(F.lit("```rust no JSON "), "c_name", F.lit(" ```")))
    return responses.extractions(c.select("c_custkey", F.explode(said).alias("response")), []).select("c_custkey", "extraction_class", "extraction_text")


@query(
    """SELECT c_custkey, 0 AS ordinal, 'key' AS extraction_class, CAST(c_custkey AS VARCHAR) AS extraction_text, 0 AS group_index FROM customer
    UNION ALL SELECT c_custkey, 1, 'name', c_name, 0 FROM customer UNION ALL SELECT c_custkey, 2, 'segment', c_mktsegment, 1 FROM customer"""
)
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    item = F.concat(F.lit('Here: {"data": ['), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))), F.lit(","), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))), F.lit("]} as asked"))
    return responses.extractions(c.select("c_custkey", item.alias("response")), [])


@query("SELECT c_custkey, 'name' AS extraction_class, c_name AS extraction_text FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def repair_crammed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer whose one value names two expected fields is taken apart; empty fields (note) go."""
    t = F.to_json(F.struct(F.concat(F.lit("Name: "), "c_name", F.lit(", segment = "), "c_mktsegment", F.lit(", note:")).alias("all")))
    x = responses.extractions(_t(spark, sf_dir, "customer").select("c_custkey", t.alias("response")), ["name", "note", "segment"])
    return x.select("c_custkey", "extraction_class", "extraction_text")


@query(
    """SELECT event_id, CAST(1 AS INTEGER) AS leaf_index, 'e:k:[0]' AS leaf_class, event_type AS leaf_text FROM events UNION ALL SELECT event_id, 2, 'e:k:[2]:u', 'user ' || user_id FROM events
    UNION ALL SELECT event_id, 3, 'e:z', 'last' FROM events UNION ALL SELECT event_id, 0, 'e', event_type FROM events"""
)
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts inside nested objects and arrays, in order; numbers and empty texts are none; what is no JSON stands for itself."""
    said = F.concat(F.lit('{"z":"last","n":"","m":null,"k":["'), "event_type", F.lit('",7,{"u":"user '), F.col("user_id").cast("string"), F.lit('","v":true}]}'))
    e = _t(spark, sf_dir, "events").select("event_id", F.lit("e").alias("extraction_class"), F.explode(F.array(said, F.col("event_type"))).alias("extraction_text"))
    return responses.leaf_rows(e).select("event_id", "leaf_index", "leaf_class", "leaf_text")


# ---- coercion and validation ---------------------------------------------------------------------------------------------------

VALUES_SQL = """x AS (SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN '$' || CAST(o_custkey AS VARCHAR) || '.50' WHEN 2 THEN CAST(o_custkey AS VARCHAR) || '%'
 WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN o_orderstatus WHEN 5 THEN 'user' || CAST(o_custkey AS VARCHAR) || '@mail.example.com' WHEN 6 THEN '-' || CAST(o_custkey AS VARCHAR) || '.25'
 WHEN 7 THEN CAST(o_custkey AS VARCHAR) || ',000 K' WHEN 8 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'off' END
 WHEN 10 THEN 'https://x.example.com/' || CAST(o_custkey AS VARCHAR) WHEN 11 THEN '$' || CAST(o_custkey AS VARCHAR) || '.5 million' ELSE '617-555-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END AS v FROM orders)"""
TYPED_SQL = r"""y AS (SELECT *, CASE WHEN regexp_full_match(v, '\d*\.?\d+%') THEN 'percentage' WHEN regexp_full_match(v, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN 'email'
 WHEN regexp_full_match(v, '\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}') THEN 'phone' WHEN starts_with(v, 'https://') THEN 'url' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}') THEN 'date'
 WHEN regexp_full_match(v, '\$+[\d,]+(\.\d{1,2})?\s*(million|M|billion|B|thousand|K)?|[\d,]+(\.\d{1,2})?\s*(million|M|billion|B|thousand|K)') THEN 'currency'
 WHEN regexp_full_match(v, '[+-]?\d+') THEN 'integer' WHEN regexp_full_match(v, '[+-]?\d*\.?\d+([eE][+-]?\d+)?') THEN 'float'
 WHEN lower(v) IN ('true','yes','y','on','enabled','false','no','n','off','disabled') THEN 'boolean' ELSE 'string' END AS target_type FROM x)"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    k, s = F.col("o_custkey"), F.col("o_custkey").cast("string")
    forms = [
        s, F.concat(F.lit("$"), s, F.lit(".50")), F.concat(s, F.lit("%")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus"), F.concat(F.lit("user"), s, F.lit("@mail.example.com")),
        F.concat(F.lit("-"), s, F.lit(".25")), F.concat(s, F.lit(",000 K")), F.when(k % 2 == 0, "Yes").otherwise("off"), F.concat(F.lit("617-555-"), F.lpad((k % 10000).cast("string"), 4, "0")),
        F.concat(F.lit("https://x.example.com/"), s), F.concat(F.lit("$"), s, F.lit(".5 million")),
    ]
    v = F.when(F.col("o_orderkey") % 12 == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        v = v.when(F.col("o_orderkey") % 12 == i, f)
    return o.select("o_orderkey", v.alias("v"))


@query(
    "WITH " + VALUES_SQL + ", " + TYPED_SQL + r""" SELECT o_orderkey, v, target_type, target_type <> 'string' AS success,
    CASE WHEN target_type = 'integer' THEN CAST(v AS BIGINT) END AS long_value,
    round(CASE target_type WHEN 'percentage' THEN CAST(replace(v, '%', '') AS DOUBLE) / 100 WHEN 'float' THEN CAST(v AS DOUBLE)
      WHEN 'currency' THEN CAST(regexp_replace(v, '[^0-9.]', '', 'g') AS DOUBLE) * CASE WHEN contains(v, 'K') THEN 1000 WHEN contains(v, 'million') THEN 1000000 ELSE 1 END END, 6) AS double_value,
    CASE WHEN target_type IN ('email', 'url', 'date') THEN v WHEN target_type = 'phone' THEN '(617) 555-' || right(v, 4) END AS string_value,
    CASE WHEN target_type IN ('email', 'url', 'date') THEN '{"' || target_type || '":"' || v || '","type":"' || target_type || '"}' WHEN target_type = 'phone' THEN '{"area_code":"617","phone":"(617) 555-' || right(v, 4) || '","type":"phone"}' END AS json_value,
    CASE WHEN target_type = 'boolean' THEN lower(v) IN ('true','yes','y','on','enabled') END AS bool_value FROM y"""
)
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _values(spark, sf_dir).withColumn("c", validate.coerce(F.col("v")))
    return x.select("o_orderkey", "v", "c.target_type", "c.success", "c.long_value", F.round("c.double_value", 6).alias("double_value"), "c.string_value", "c.json_value", "c.bool_value")


@query("WITH " + VALUES_SQL + ", " + TYPED_SQL + " SELECT target_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (target_type <> 'string') AS BIGINT) AS successful FROM y GROUP BY ALL")
def coerce_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _values(spark, sf_dir).select(validate.coerce(F.col("v")).alias("c"))
    return x.groupBy("c.target_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.success").alias("successful"))


def _customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each customer: always a name, a balance in whole units for even keys, an empty note for keys divisible by 3."""
    c = _t(spark, sf_dir, "customer")
    v = F.array(
        F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.when(F.col("c_custkey") % 2 == 0, F.struct(F.lit("key").alias("k"), F.col("c_custkey").cast("string").alias("v"))),
        F.when(F.col("c_custkey") % 3 == 0, F.struct(F.lit("note").alias("k"), F.lit(" ").alias("v"))),
    )
    x = c.select("c_custkey", F.posexplode(F.filter(v, lambda e: e.isNotNull())).alias("ordinal", "e"))
    return x.select("c_custkey", "ordinal", F.col("e.k").alias("extraction_class"), F.col("e.v").alias("extraction_text"))


@query(
    """SELECT c_custkey, c_custkey % 6 = 0 AS is_valid, CAST((CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END) + (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END) AS INTEGER) AS n_errors,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_warnings,
    CASE WHEN c_custkey % 2 = 0 THEN '{"key":' || CAST(c_custkey AS VARCHAR) || ',"name":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN ',"note":" "' ELSE '' END || '}' END AS corrected_data,
    CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS successful, CAST(1 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS failed,
    CASE WHEN c_custkey % 3 = 0 THEN 'no text under ''note''' END AS warning, CASE WHEN c_custkey % 2 = 1 THEN 'nothing found for ''key''' WHEN c_custkey % 3 <> 0 THEN 'nothing found for ''note''' END AS error FROM customer"""
)
def validate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate.validate(_customer_rows(spark, sf_dir), ["name", "key", "note"], ["c_custkey"], validate.ValidationConfig(True))
    return v.select("c_custkey", "is_valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "corrected_data", "successful", "failed", F.get("warnings", F.lit(0))["message"].alias("warning"), F.get("errors", F.lit(0))["message"].alias("error"))


@query(
    r"""SELECT doc_id, concat_ws('|', CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'no text under ''body''' WHEN length(text) > 1000 THEN 'a text of ' || length(text) || ' characters under ''body''' END, 'only 1 values for 4 fields') AS warnings FROM documents"""
)
def validate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings about long and blank texts, and about fewer values than half the fields."""
    x = _t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.lit("body").alias("extraction_class"), F.col("text").alias("extraction_text"))
    v = validate.validate(x, ["body", "a", "b", "c"], ["doc_id"])
    return v.select("doc_id", F.array_join(F.transform("warnings", lambda w: w["message"]), "|").alias("warnings"))


# ---- alignment -----------------------------------------------------------------------------------------------------------------


def _many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of many values: every tenth word of a document, alone and with the word two places on (so that first and last
    word stand near each other), and for every one of them a word that the text lacks."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", texts.words(F.col("text")).alias("w"))
    k = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - 1) / 10)).cast("int"))
    at = F.when(F.size("w") > 0, k).otherwise(F.array().cast("array<int>"))
    value = lambda i: F.concat_ws(" ", F.get("w", i * 10), F.get("w", i * 10 + 2))
    items = F.flatten(F.transform(at, lambda i: F.array(F.struct(F.get("w", i * 10).alias("v")), F.struct(value(i).alias("v")), F.struct(F.concat(F.lit("#"), i).alias("v")))))
    return d.select("doc_id", "text", F.to_json(items).alias("response"))


@query(
    r"""WITH d AS (SELECT doc_id, lower(text) AS t, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    i AS (SELECT doc_id, t, w, unnest(range((len(w) + 9) // 10)) AS i FROM d),
    v AS (SELECT doc_id, t, 3 * i AS ordinal, w[10 * i + 1] AS v FROM i UNION ALL SELECT doc_id, t, 3 * i + 1, concat_ws(' ', w[10 * i + 1], w[10 * i + 3]) FROM i UNION ALL SELECT doc_id, t, 3 * i + 2, '#' || i FROM i),
    x AS (SELECT *, strpos(t, lower(v)) - 1 AS e, regexp_split_to_array(lower(v), '\s+') AS p FROM v),
    f AS (SELECT *, strpos(t, p[1]) - 1 AS a FROM x), n AS (SELECT *, a + strpos(substr(t, CAST(a + 1 AS BIGINT)), p[-1]) - 1 + length(p[-1]) AS z, strpos(substr(t, CAST(a + 1 AS BIGINT)), p[-1]) > 0 AS has FROM f),
    o AS (SELECT *, e < 0 AND len(p) > 1 AND a >= 0 AND has AND z - a < 2 * length(v) AS near FROM n)
    SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, v AS extraction_text, CAST(CASE WHEN e >= 0 THEN e WHEN near THEN a END AS BIGINT) AS start_pos, CAST(CASE WHEN e >= 0 THEN e + length(v) WHEN near THEN z END AS BIGINT) AS end_pos,
      CASE WHEN e >= 0 THEN 'match_exact' WHEN near THEN 'match_lesser' END AS alignment_status FROM o"""
)
def align_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of a document placed together; a third of them is not in it."""
    x = align.grounded(_many_values(spark, sf_dir), ["v"], offset_col=None, config=align.AlignConfig(fuzzy=False))
    return x.select("doc_id", "ordinal", "extraction_text", "start_pos", "end_pos", "alignment_status")


def _to_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for each document: a piece of it in small letters, its first and eighth word, or words that are not in it."""
    d = _t(spark, sf_dir, "documents")
    w = F.split("text", r"\s+")
    value = F.when(F.col("doc_id") % 3 == 0, F.lower(F.substring("text", 11, 20))).when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(3)))).otherwise(F.lit("qqq zzz"))
    return d.select("doc_id", "lang", F.col("text").alias("chunk_text"), value.alias("extraction_text"))


ALIGN_SQL = r"""v AS (SELECT doc_id, lang, lower(text) AS t, lower(CASE WHEN doc_id % 3 = 0 THEN lower(substr(text, 11, 20)) WHEN doc_id % 3 = 1 THEN
 concat_ws(' ', regexp_split_to_array(text, '\s+')[1], regexp_split_to_array(text, '\s+')[4]) ELSE 'qqq zzz' END) AS v FROM documents),
e AS (SELECT *, strpos(t, v) AS ex, list_filter(regexp_split_to_array(v, '\s+'), lambda x: x <> '') AS w FROM v),
l AS (SELECT *, strpos(t, w[1]) AS f, CASE WHEN strpos(t, w[1]) > 0 AND strpos(substr(t, strpos(t, w[1])), w[-1]) > 0 THEN strpos(t, w[1]) - 1 + strpos(substr(t, strpos(t, w[1])), w[-1]) END AS la FROM e),
r AS (SELECT doc_id, lang, CASE WHEN ex > 0 THEN ex - 1 WHEN len(w) > 1 AND f > 0 AND la > 0 AND la - 1 + length(w[-1]) - (f - 1) < 2 * length(v) THEN f - 1 END AS s,
 CASE WHEN ex > 0 THEN ex - 1 + length(v) WHEN len(w) > 1 AND f > 0 AND la > 0 AND la - 1 + length(w[-1]) - (f - 1) < 2 * length(v) THEN la - 1 + length(w[-1]) END AS e, ex > 0 AS exact FROM l)"""


@query("WITH " + ALIGN_SQL + " SELECT doc_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, CASE WHEN exact THEN 'match_exact' WHEN s IS NOT NULL THEN 'match_lesser' END AS alignment_status FROM r")
def align_exact_lesser(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.align(_to_align(spark, sf_dir), offset_col=None, config=align.AlignConfig(fuzzy=False))
    return x.select("doc_id", "start_pos", "end_pos", "alignment_status")


@query(
    "WITH " + ALIGN_SQL + """ SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (exact) AS BIGINT) AS match_exact, CAST(0 AS BIGINT) AS match_fuzzy,
    CAST(count(*) FILTER (NOT exact AND s IS NOT NULL) AS BIGINT) AS match_lesser, CAST(0 AS BIGINT) AS match_greater, CAST(count(*) FILTER (s IS NULL) AS BIGINT) AS unaligned,
    round(count(*) FILTER (s IS NOT NULL) / count(*), 6) AS success_rate, round(count(*) FILTER (exact) / count(*), 6) AS exact_match_rate FROM r GROUP BY lang"""
)
def align_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.alignment_stats(align.align(_to_align(spark, sf_dir), offset_col=None, config=align.AlignConfig(fuzzy=False)), "lang")
    return x.withColumn("success_rate", F.round("success_rate", 6)).withColumn("exact_match_rate", F.round("exact_match_rate", 6))


@query("SELECT doc_id, CASE WHEN strpos(text, v) > 0 THEN CAST(strpos(text, v) - 1 AS BIGINT) END AS start_pos, CASE WHEN strpos(text, v) > 0 THEN CAST(strpos(text, v) - 1 + length(v) AS BIGINT) END AS end_pos FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN lower(substr(text, 11, 20)) WHEN doc_id % 3 = 1 THEN concat_ws(' ', regexp_split_to_array(text, '\\s+')[1], regexp_split_to_array(text, '\\s+')[4]) ELSE 'qqq zzz' END AS v FROM documents)")
def align_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches only, and letters as they are."""
    c = align.AlignConfig(fuzzy=False, accept_lesser=False, case_sensitive=True)
    return align.align(_to_align(spark, sf_dir), offset_col=None, config=c).select("doc_id", "start_pos", "end_pos")


@query(
    r"""WITH d AS (SELECT doc_id, text, lower(text) AS t, list_filter(regexp_split_to_array(text, '\s+'), lambda x: true) AS p FROM documents),
    a AS (SELECT doc_id, t, text, concat_ws(' ', p[7], 'qqq', p[5], p[6]) AS value FROM d),
    v AS (SELECT *, lower(value) AS lv, list_filter(regexp_split_to_array(lower(value), '\s+'), lambda x: x <> '') AS vw FROM a),
    l AS (SELECT doc_id, strpos(t, vw[1]) AS f, CASE WHEN strpos(t, vw[1]) > 0 AND strpos(substr(t, strpos(t, vw[1])), vw[-1]) > 0 THEN strpos(t, vw[1]) - 1 + strpos(substr(t, strpos(t, vw[1])), vw[-1]) END AS la FROM v),
    lesser AS (SELECT doc_id, f - 1 AS s, la - 1 + length(vw[-1]) AS e FROM l JOIN v USING (doc_id) WHERE len(vw) > 1 AND f > 0 AND la > 0 AND la - 1 + length(vw[-1]) - (f - 1) < 2 * length(lv)),
    u AS (SELECT doc_id, unnest(regexp_extract_all(t, '(\s*)(\S+)', 1)) AS g, unnest(regexp_extract_all(t, '(\s*)(\S+)', 2)) AS w, generate_subscripts(regexp_extract_all(t, '(\s*)(\S+)', 2), 1) - 1 AS i FROM v),
    w AS (SELECT doc_id, i, w, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e, count(*) OVER (PARTITION BY doc_id) AS n FROM u),
    q AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(vw) AS x FROM v) GROUP BY ALL),
    h AS (SELECT DISTINCT w.doc_id, unnest(range(greatest(0, w.i - len(v.vw) + 1), least(w.i, w.n - len(v.vw)) + 1)) AS i, q.x, q.c FROM w JOIN q ON q.doc_id = w.doc_id AND q.x = w.w JOIN v ON v.doc_id = w.doc_id WHERE len(v.vw) <= least(w.n, 100)),
    b AS (SELECT doc_id, i, sum(c) AS score FROM h GROUP BY ALL),
    best AS (SELECT doc_id, first(i ORDER BY score DESC, i) AS i FROM b JOIN v USING (doc_id) WHERE 5 * score >= 2 * len(vw) GROUP BY doc_id),
    z AS (SELECT best.doc_id, x.e - length(x.w) AS s, CASE WHEN best.i + len(v.vw) < x.n THEN y.e ELSE length(v.t) END AS e FROM best JOIN v USING (doc_id) JOIN w x ON x.doc_id = best.doc_id AND x.i = best.i JOIN w y ON y.doc_id = best.doc_id AND y.i = best.i + len(v.vw) - 1)
    SELECT v.doc_id, v.value AS extraction_text, CAST(coalesce(lesser.s, z.s) AS BIGINT) AS start_pos, CAST(coalesce(lesser.e, z.e) AS BIGINT) AS end_pos,
      CASE WHEN lesser.s IS NOT NULL THEN 'match_lesser' WHEN z.s IS NOT NULL THEN 'match_fuzzy' END AS alignment_status FROM v LEFT JOIN lesser USING (doc_id) LEFT JOIN z USING (doc_id)"""
)
def align_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbouring words of each document, in another order and with a word that it lacks."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk_text"))
    w = F.split("chunk_text", r"\s+")
    x = d.withColumn("extraction_text", F.concat_ws(" ", F.get(w, F.lit(6)), F.lit("qqq"), F.get(w, F.lit(4)), F.get(w, F.lit(5))))
    return align.align(x, offset_col=None).select("doc_id", "extraction_text", "start_pos", "end_pos", "alignment_status")


# ---- aggregation ---------------------------------------------------------------------------------------------------------------


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document as its values: class by language, of every third one by source, small letters for every other one,
    five places that overlap."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    k = F.col("ordinal")
    at = (k % 5 * 100).cast("long")
    return d.select(
        "doc_id", "ordinal", F.when(k % 3 == 2, F.col("source")).otherwise(F.col("lang")).alias("extraction_class"), F.when(k % 2 == 0, F.lower("line")).otherwise(F.col("line")).alias("extraction_text"),
        at.alias("start_pos"), (at + 150).alias("end_pos"), F.when(k % 4 == 0, EXACT).when(k % 4 == 1, FUZZY).when(k % 4 == 2, LESSER).alias("alignment_status"),
    )


MENTIONS_SQL = """m AS (SELECT doc_id, ordinal, CASE WHEN ordinal % 3 = 2 THEN source ELSE lang END AS extraction_class, CASE WHEN ordinal % 2 = 0 THEN lower(line) ELSE line END AS extraction_text, ordinal % 5 * 100 AS a,
 CASE ordinal % 4 WHEN 0 THEN 'match_exact' WHEN 1 THEN 'match_fuzzy' WHEN 2 THEN 'match_lesser' END AS alignment_status
 FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ordinal FROM documents))"""
SCORE_SQL = r"""q AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN length(extraction_text) BETWEEN 2 AND 100 THEN 20 WHEN length(extraction_text) > 100 THEN -10 ELSE 0 END
 + CASE alignment_status WHEN 'match_exact' THEN 30 WHEN 'match_fuzzy' THEN 10 WHEN 'match_lesser' THEN 5 ELSE -20 END + CASE WHEN regexp_matches(extraction_text, '\pL') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(extraction_text, '\pN') THEN 5 ELSE 0 END + CASE WHEN length(extraction_text) <= 1 THEN -30 ELSE 0 END)) / 100.0 AS s FROM m)"""


@query("WITH " + MENTIONS_SQL + r", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(extraction_text, '^\s+|\s+$', '', 'g')) ORDER BY ordinal) AS r FROM m) SELECT doc_id, ordinal, extraction_class, extraction_text FROM n WHERE r = 1")
def dedupe_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.dedupe_normalized(_mentions(spark, sf_dir)).select("doc_id", "ordinal", "extraction_class", "extraction_text")


@query(
    "WITH RECURSIVE " + MENTIONS_SQL + r""", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k, list_distinct(list_filter(regexp_split_to_array(extraction_text, '\s+'), lambda x: x <> '')) AS ws
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, extraction_class, extraction_text ORDER BY ordinal) AS f FROM m) WHERE f = 1),
    r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(t VARCHAR, w VARCHAR[], c VARCHAR, a BIGINT)[]) AS kept, CAST(NULL AS INTEGER) AS ordinal FROM m
      UNION ALL SELECT doc_id, k, CASE WHEN hit THEN kept ELSE list_append(kept, {'t': t, 'w': ws, 'c': c, 'a': a}) END, CASE WHEN hit THEN NULL ELSE ordinal END FROM (
        SELECT o.doc_id, o.k, r.kept, o.extraction_text AS t, o.ws, o.ordinal, o.extraction_class AS c, o.a,
          len(list_filter(r.kept, lambda x: (x.c = o.extraction_class OR abs(x.a - o.a) < 150) AND 9 * least(len(x.w), len(o.ws)) >= 7 * greatest(len(x.w), len(o.ws)) AND 5 * len(list_intersect(x.w, o.ws)) >= 4 * (len(x.w) + len(o.ws) - len(list_intersect(x.w, o.ws))))) > 0 AS hit
        FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1))
    SELECT m.doc_id, m.ordinal, m.extraction_class, m.extraction_text FROM r JOIN m USING (doc_id, ordinal)"""
)
def dedupe_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.dedupe_similar(_mentions(spark, sf_dir)).select("doc_id", "ordinal", "extraction_class", "extraction_text")


@query("WITH " + MENTIONS_SQL + ", " + SCORE_SQL + " SELECT doc_id, ordinal, CAST(s AS DOUBLE) AS quality_score FROM q")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select("doc_id", "ordinal", aggregate.quality_score(F.col("extraction_text"), F.col("alignment_status")).alias("quality_score"))


@query(
    "WITH " + MENTIONS_SQL + ", " + SCORE_SQL + """ SELECT doc_id, CAST(count(*) AS BIGINT) AS total, round(avg(CAST(s AS DOUBLE)), 6) AS average_quality, CAST(count(*) FILTER (s >= 0.7) AS BIGINT) AS high_quality,
    CAST(count(*) FILTER (s >= 0.3 AND s < 0.7) AS BIGINT) AS medium_quality, CAST(count(*) FILTER (s < 0.3) AS BIGINT) AS low_quality FROM q GROUP BY doc_id"""
)
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _mentions(spark, sf_dir).withColumn("quality_score", aggregate.quality_score(F.col("extraction_text"), F.col("alignment_status")))
    return aggregate.quality_stats(x, "doc_id").withColumn("average_quality", F.round("average_quality", 6))


@query("WITH " + MENTIONS_SQL + " SELECT doc_id, ordinal, extraction_text FROM m WHERE extraction_class = 'fr'")
def filter_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.by_class(_mentions(spark, sf_dir), "fr").select("doc_id", "ordinal", "extraction_text")


def _picked_sql(rows: str) -> str:
    """Of the rows (doc_id, ordinal, a, b) of a table those that fit the text and overlap none before them, as the CTE picked; hl: the text with them in bold."""
    return f"""o AS (SELECT r.*, row_number() OVER (PARTITION BY doc_id ORDER BY a, ordinal) AS k FROM {rows} r JOIN (SELECT doc_id, length(text) AS n FROM documents) USING (doc_id) WHERE a < b AND b <= n),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS INTEGER) AS ordinal FROM documents
      UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.a >= w.last THEN o.b ELSE w.last END, CASE WHEN o.a >= w.last THEN o.a END, CASE WHEN o.a >= w.last THEN o.b END, CASE WHEN o.a >= w.last THEN o.ordinal END FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1),
    picked AS (SELECT doc_id, a, b, ordinal, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM w WHERE a IS NOT NULL),
    hl AS (SELECT d.doc_id, coalesce(string_agg(substr(text, p + 1, a - p) || '**' || substr(text, a + 1, b - a) || '**', '' ORDER BY a), '') || substr(any_value(text), coalesce(max(b), 0) + 1) AS hl FROM documents d LEFT JOIN picked USING (doc_id) GROUP BY d.doc_id)"""


SPANS_SQL = """s AS (SELECT doc_id, CAST(i AS INTEGER) AS ordinal, 's' || i AS c, text, CAST(i * 7 % 50 AS BIGINT) AS a, CAST(i * 7 % 50 + 5 + i % 4 * 6 AS BIGINT) AS b FROM documents, range(0, 12) r(i))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve spans of each document, many of which overlap, or reach beyond its end."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("ordinal"))
    a = (F.col("ordinal") * 7 % 50).cast("long")
    b = a + 5 + F.col("ordinal") % 4 * 6
    return d.select("doc_id", "ordinal", F.concat(F.lit("s"), F.col("ordinal")).alias("extraction_class"), F.substring("text", (a + 1).cast("int"), (b - a).cast("int")).alias("extraction_text"), a.alias("start_pos"), b.alias("end_pos"), F.lit(EXACT).alias("alignment_status"))


@query(
    "WITH RECURSIVE " + SPANS_SQL + ", " + _picked_sql("s") + r""", l AS (SELECT doc_id, string_agg('| ' || c || ' | ' || replace(replace(substr(text, a + 1, b - a), '|', '\|'), chr(10), ' ') || ' |' || chr(10), '' ORDER BY ordinal) AS l FROM s GROUP BY doc_id)
    SELECT doc_id, '# Extractions' || chr(10) || chr(10) || '## Text' || chr(10) || chr(10) || '```' || chr(10) || hl || chr(10) || '```' || chr(10) || chr(10) || '## Extractions' || chr(10) || chr(10) || '| Class | Text |' || chr(10) || '|---|---|' || chr(10) || l AS report FROM hl JOIN l USING (doc_id)"""
)
def nonoverlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's highlights: spans that overlap an earlier one, or do not fit the text, are not marked."""
    return export.reports(_t(spark, sf_dir, "documents").select("doc_id", "text"), _spans(spark, sf_dir), export.ExportConfig("markdown", intervals=False, statistics=False))


def _escaped_sql(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{raw}', '{safe}')"
    return text


@query(
    "WITH " + SPANS_SQL + f""", fit AS (SELECT doc_id, ordinal, c, CASE WHEN b <= length(text) THEN a ELSE strpos(text, t) - 1 END AS a, CASE WHEN b <= length(text) THEN b ELSE strpos(text, t) - 1 + length(t) END AS b
      FROM (SELECT *, substr(text, a + 1, b - a) AS t FROM s) WHERE b <= length(text) OR t <> ''),
    cuts AS (SELECT doc_id, 0 AS x FROM documents UNION SELECT doc_id, length(text) FROM documents UNION SELECT doc_id, a FROM fit UNION SELECT doc_id, b FROM fit),
    p AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS y FROM cuts),
    q AS (SELECT p.doc_id, x, y, count(fit.c) AS n, string_agg(fit.c, ' | ' ORDER BY ordinal) AS names FROM p LEFT JOIN fit ON fit.doc_id = p.doc_id AND fit.a <= x AND fit.b >= y WHERE y IS NOT NULL GROUP BY ALL)
    SELECT q.doc_id, string_agg(CASE WHEN n > 0 THEN '<span class="layer layers-' || n || '" title="' || names || '">' ELSE '' END || {_escaped_sql("substr(text, x + 1, y - x)")} || CASE WHEN n > 0 THEN '</span>' ELSE '' END, '' ORDER BY x) AS body
    FROM q JOIN documents d USING (doc_id) GROUP BY q.doc_id"""
)
def layered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline report's text: cut at every boundary of overlapping spans; spans that do not fit lie where their text first stands."""
    r = export.reports(_t(spark, sf_dir, "documents").filter("length(text) > 0").select("doc_id", "text"), _spans(spark, sf_dir), export.ExportConfig("html", statistics=False), layers=True)
    return r.select("doc_id", F.regexp_extract("report", r'(?s)<div class="text">(.*?)</div>\n', 1).alias("body"))


@query(
    "WITH " + MENTIONS_SQL + f""", c AS (SELECT doc_id, extraction_class, string_agg(extraction_text, ', ' ORDER BY ordinal, extraction_text) AS x FROM m GROUP BY ALL)
    SELECT doc_id, {quoted(chr(10) * 2 + 'Previous extractions found:')} || string_agg(chr(10) || '- ' || extraction_class || ': ' || x, '' ORDER BY extraction_class) || {quoted(prompts.MORE)} AS context FROM c GROUP BY doc_id"""
)
def refinement_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.refinement_context(_mentions(spark, sf_dir))


# ---- pipelines and exports -----------------------------------------------------------------------------------------------------


@query("WITH " + MENTIONS_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r FROM m WHERE extraction_class = 'en' AND regexp_matches(extraction_text, '^T')) SELECT doc_id, ordinal, extraction_text FROM n WHERE r <= 3")
def pipeline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.filtered(_mentions(spark, sf_dir), pipeline.Filter("en", "^T", 3)).select("doc_id", "ordinal", "extraction_text")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN CASE WHEN doc_id % 2 = 0 THEN 4 ELSE strpos(text, v) - 1 END + 10 END AS start_pos,
    CASE WHEN doc_id % 3 <> 2 THEN CASE WHEN doc_id % 2 = 0 THEN 9 ELSE strpos(text, v) - 1 + length(v) END + 10 END AS end_pos
    FROM (SELECT doc_id, text, string_split(text, ' ')[-1] AS v FROM documents)"""
)
def pipeline_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values inside a parent that starts at 10, whose text is a document: placed, or to be found (the last word), or under a parent that is not exact."""
    even = F.col("doc_id") % 2 == 0
    d = _t(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("item_text"), F.try_element_at(F.split("text", " "), F.lit(-1)).alias("extraction_text"), F.when(even, F.lit(4)).cast("bigint").alias("start_pos"), F.when(even, F.lit(9)).cast("bigint").alias("end_pos"),
        F.lit(10).cast("bigint").alias("parent_start"), F.when(F.col("doc_id") % 3 == 2, FUZZY).otherwise(EXACT).alias("parent_status"),
    )
    return pipeline.lifted(d).select("doc_id", "start_pos", "end_pos")


def _requirement_pipeline() -> pipeline.Pipeline:
    one = (Example("Call 5551234.", (Extraction("number", "5551234"),)),)
    return pipeline.Pipeline("numbers", (pipeline.Step("find", "List numbers.", one), pipeline.Step("again", "List numbers.", one, filter=pipeline.Filter("number", None, 5), depends_on=("find",))))


@query(
    "WITH " + _RULE_ROWS + """, j AS (SELECT *, '{"class":"' || extraction_class || '","text":"' || extraction_text || '","start":' || start_pos || ',"end":' || end_pos || '}' AS j FROM v),
    f AS (SELECT doc_id, '"find":{"extractions":[' || string_agg(j, ',' ORDER BY ordinal) || '],"count":' || count(*) || '}' AS f FROM j GROUP BY doc_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r FROM j WHERE extraction_class = 'number'),
    a AS (SELECT doc_id, '"again":{"extractions":[' || string_agg(j, ',' ORDER BY ordinal) || '],"count":' || count(*) || '},' AS a FROM n WHERE r <= 5 GROUP BY doc_id)
    SELECT doc_id, '{' || coalesce(a, '') || f || '}' AS output FROM f LEFT JOIN a USING (doc_id)"""
)
def pipeline_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps: values of each document, then the values in its first five numbers."""
    r = pipeline.execute(_t(spark, sf_dir, "documents").select("doc_id", "text"), _requirement_pipeline(), _rule_config())
    return pipeline.nested_output(r)


@query(
    "WITH " + _RULE_ROWS + """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r FROM v WHERE extraction_class = 'number')
    SELECT doc_id, 'find' AS step_id, CAST(0 AS INTEGER) AS item, extraction_class, extraction_text, start_pos, CAST(NULL AS VARCHAR) AS parent_step_id, CAST(NULL AS VARCHAR) AS parent_class, CAST(NULL AS VARCHAR) AS parent_text, CAST(0 AS BIGINT) AS parent_start FROM v
    UNION ALL SELECT doc_id, 'again', CAST(r - 1 AS INTEGER), extraction_class, extraction_text, start_pos, 'find', extraction_class, extraction_text, start_pos FROM n WHERE r <= 5"""
)
def pipeline_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of a pipeline with the step, class, text and place that it comes from."""
    r = pipeline.execute(_t(spark, sf_dir, "documents").select("doc_id", "text"), _requirement_pipeline(), _rule_config())
    return r.rows().select("doc_id", "step_id", "item", "extraction_class", "extraction_text", "start_pos", "parent_step_id", "parent_class", "parent_text", "parent_start")


@query(
    """WITH x AS (SELECT c_custkey AS doc_id, c_name AS n, c_mktsegment AS s, '{"a":"' || c_mktsegment || '","b":["' || c_name || '","gone"]}' AS j FROM customer)
    SELECT doc_id, '{"extractions":[{"extraction_class":"name","extraction_text":"' || n || '","step_id":"one","step_name":"First","char_interval":{"start_pos":3,"end_pos":' || 3 + length(n) || '}},'
    || '{"extraction_class":"all","extraction_text":"' || replace(j, '"', '\\"') || '","step_id":"two","step_name":"Second","parent_step_id":"one","parent_start":3,"parent_end":9},'
    || '{"extraction_class":"all:a","extraction_text":"' || s || '","step_id":"two","step_name":"Second","char_interval":{"start_pos":' || 4 + length(n) || ',"end_pos":' || 4 + length(n) + length(s) || '},"parent_step_id":"one","parent_start":3,"parent_end":9},'
    || '{"extraction_class":"all:b:[0]","extraction_text":"' || n || '","step_id":"two","step_name":"Second","char_interval":{"start_pos":3,"end_pos":' || 3 + length(n) || '},"parent_step_id":"one","parent_start":3,"parent_end":9},'
    || '{"extraction_class":"all:b:[1]","extraction_text":"gone","step_id":"two","step_name":"Second","parent_step_id":"one","parent_start":3,"parent_end":9}],"metadata":{"steps":2,"total_time_ms":5,"expand_nested_json":true}}' AS json FROM x"""
)
def pipeline_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flattened export: a placed value, a nested one, and its leaves where they stand in the document."""
    c = _t(spark, sf_dir, "customer")
    none = F.lit(None)
    j = F.concat(F.lit('{"a":"'), "c_mktsegment", F.lit('","b":["'), "c_name", F.lit('","gone"]}'))
    row = lambda step, kind, text, start, end, parent: F.struct(
        F.lit(step).alias("step_id"), F.lit(0).alias("item"), F.lit(0).alias("chunk_id"), F.lit(0).alias("ordinal"), F.lit(kind).alias("extraction_class"), text.alias("extraction_text"), start.cast("bigint").alias("start_pos"), end.cast("bigint").alias("end_pos"),
        (F.lit(parent) if parent else none.cast("string")).alias("parent_step_id"), F.lit(3).cast("bigint").alias("parent_start"), F.lit(9).cast("bigint").alias("parent_end"),
    )
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(row("one", "name", F.col("c_name"), F.lit(3), F.length("c_name") + 3, None), row("two", "all", j, none, none, "one"))))
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("To "), "c_name", F.lit(" "), "c_mktsegment").alias("text"))
    return export.flattened(rows, docs, {"one": "First", "two": "Second"}, 5, expanded=True)


@query("SELECT c_custkey AS doc_id, CAST(0 AS INTEGER) AS ordinal, 'segment' AS extraction_class, c_mktsegment AS extraction_text, CAST(0 AS BIGINT) AS start_pos, CAST(3 AS BIGINT) AS end_pos, 'match_exact' AS alignment_status, CAST(0 AS BIGINT) AS group_index FROM customer")
def reread_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export read back keeps places, statuses and groups."""
    x = export_json(spark, sf_dir).select(F.from_json("json", ANNOTATED).alias("d")).select("d.*")
    r = annotated_rows(x).withColumn("doc_id", F.col("doc_id").cast("long"))
    return r.select("doc_id", "ordinal", "extraction_class", "extraction_text", "start_pos", "end_pos", "alignment_status", "group_index")


@query(
    "WITH " + MENTIONS_SQL + """ SELECT doc_id, ordinal, concat_ws(',', CASE WHEN regexp_matches(extraction_class, '[,"]') THEN '"' || extraction_class || '"' ELSE extraction_class END,
    CASE WHEN contains(extraction_text, ',') OR contains(extraction_text, '"') OR contains(extraction_text, chr(10)) THEN '"' || replace(extraction_text, '"', '""') || '"' ELSE extraction_text END, '', CAST(a AS VARCHAR), CAST(a + 150 AS VARCHAR), coalesce(alignment_status, 'None'), '') AS line FROM m"""
)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).withColumn("description", F.lit(None).cast("string")).withColumn("group_index", F.lit(None).cast("int"))
    return m.select("doc_id", "ordinal", export.csv_line().alias("line"))


@query(
    """SELECT c_custkey AS doc_id, '{"document_id":"' || c_custkey || '","export_config":{"format":"json","show_char_intervals":true,"include_text":true,"include_statistics":true,"title":null},"text":"' || c_name ||
    '","extractions":[{"extraction_class":"segment","extraction_text":"' || c_mktsegment || '","description":null,"char_interval":{"start_char":0,"end_char":3,"alignment_status":"match_exact"},"group_index":0}],"statistics":{"total_extractions":1,"text_length":' ||
    length(c_name) || ',"unique_classes":1,"extraction_classes":{"segment":1}}}' AS json FROM customer"""
)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("ordinal"), F.lit("segment").alias("extraction_class"), F.col("c_mktsegment").alias("extraction_text"), F.lit(None).cast("string").alias("description"), F.lit(0).cast("bigint").alias("start_pos"), F.lit(3).cast("bigint").alias("end_pos"), F.lit(EXACT).alias("alignment_status"), F.lit(0).alias("group_index"))
    return export.json_document(c.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text")), rows)


_REPORT_SQL = "WITH RECURSIVE " + _RULE_ROWS + ", r AS (SELECT doc_id, ordinal, extraction_class AS c, extraction_text AS t, start_pos AS a, end_pos AS b FROM v), " + _picked_sql("r") + """,
    n AS (SELECT doc_id, c, count(*) AS n FROM r GROUP BY ALL),
    g AS (SELECT doc_id, sum(n) AS found, count(*) AS classes, string_agg('; ' || c || ' ' || n, '' ORDER BY c) AS short, string_agg(chr(10) || '  - ' || c || ': ' || n, '' ORDER BY c) AS listed, string_agg('<li>' || c || ': ' || n || '</li>', '' ORDER BY c) AS items FROM n GROUP BY doc_id),
    l AS (SELECT doc_id, string_agg('[' || a || '..' || b || ' match_exact] ' || c || ' = ' || t || chr(10), '' ORDER BY ordinal) AS lines, string_agg('| ' || c || ' | ' || t || ' | ' || a || '-' || b || ' | match_exact |' || chr(10), '' ORDER BY ordinal) AS cells,
      string_agg('<div class="card" id="e' || ordinal || '"><b>' || c || '</b> ' || t || ' <small>' || a || '-' || b || ' match_exact</small></div>' || chr(10), '' ORDER BY ordinal) AS cards,
      'Class' AS head FROM r GROUP BY doc_id),
    d AS (SELECT doc_id, text, hl, coalesce(lines, '') AS lines, coalesce(cells, '') AS cells, coalesce(cards, '') AS cards, coalesce(found, 0) AS found, coalesce(classes, 0) AS classes, coalesce(short, '') AS short, coalesce(listed, '') AS listed, coalesce(items, '') AS items
      FROM documents JOIN hl USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN g USING (doc_id)),
    hm AS (SELECT d.doc_id, coalesce(string_agg(""" + _escaped_sql("substr(d.text, p + 1, a - p)") + """ || '<mark data-i="' || picked.ordinal || '" title="' || r.c || '">' || """ + _escaped_sql("substr(d.text, picked.a + 1, picked.b - picked.a)") + """ || '</mark>', '' ORDER BY picked.a), '') || """ + _escaped_sql("substr(any_value(d.text), coalesce(max(picked.b), 0) + 1)") + """ AS marked
      FROM documents d LEFT JOIN picked USING (doc_id) LEFT JOIN (SELECT doc_id, ordinal, c FROM r) r ON r.doc_id = picked.doc_id AND r.ordinal = picked.ordinal GROUP BY d.doc_id)"""
_REPORTS = {
    "text": " SELECT doc_id, '# Extractions of ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || lines || chr(10) || found || ' values in ' || length(text) || ' characters' || short || chr(10) AS report FROM d",
    "markdown": """ SELECT doc_id, '# Extractions' || chr(10) || chr(10) || '## Text' || chr(10) || chr(10) || '```' || chr(10) || hl || chr(10) || '```' || chr(10) || chr(10) || '## Extractions' || chr(10) || chr(10) || '| Class | Text | Position | Status |' || chr(10) || '|---|---|---|---|' || chr(10)
      || cells || chr(10) || '## Statistics' || chr(10) || chr(10) || '- Document: ' || doc_id || chr(10) || '- Characters: ' || length(text) || chr(10) || '- Extractions: ' || found || chr(10) || '- Classes: ' || classes || listed || chr(10) AS report FROM d""",
    "html": """ SELECT doc_id, '<div class="text">' || marked || '</div>' || chr(10) || cards || '<h2>Statistics</h2><p>' || doc_id || ': ' || length(text) || ' characters, ' || found || ' extractions</p><ul>' || items || '</ul>' AS report FROM d JOIN hm USING (doc_id)""",
}


def _report(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _t(spark, sf_dir, "documents").select("doc_id", "text")
        r = export.reports(d, engine.extract(d, SPEC, _rule_config()).extractions, export.ExportConfig(fmt))
        # of a page all between its head and its script
        return r if fmt != "html" else r.select("doc_id", F.regexp_extract("report", r'(?s)(<div class="text">.*</ul>)\n<script>', 1).alias("report"))

    return run


for _fmt, _sql in _REPORTS.items():
    _QUERIES[f"export_{_fmt}"] = _report(_fmt)
    _SQL[f"export_{_fmt}"] = _REPORT_SQL + _sql


@query(
    "WITH " + _RULE_ROWS + """, l AS (SELECT doc_id, string_agg(chr(10) || extraction_class || ',' || extraction_text || ',,' || start_pos || ',' || end_pos || ',match_exact,' || ordinal, '' ORDER BY ordinal) AS l FROM v GROUP BY doc_id)
    SELECT doc_id, 'extraction_class,extraction_text,description,start_char,end_char,alignment_status,group_index' || coalesce(l, '') || chr(10) AS report FROM documents LEFT JOIN l USING (doc_id)"""
)
def export_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return export.reports(d, engine.extract(d, SPEC, _rule_config()).extractions, export.ExportConfig("csv"))


@query(
    "WITH " + tokens_sql("part", "p_partkey", "p_name") + """ SELECT p_partkey, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(w, '_' ORDER BY i) AS joined, any_value(p_name) AS said
    FROM tok JOIN part USING (p_partkey) GROUP BY p_partkey"""
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernels by their SQL names."""
    register(spark)
    _t(spark, sf_dir, "part").createOrReplaceTempView("quarry_part")
    return spark.sql(
        """SELECT p_partkey, size(t) AS n_tokens, array_join(transform(t, x -> x.token_text), '_') AS joined, quarry_parse_response(to_json(named_struct('name', p_name)))[0].extraction_text AS said
        FROM (SELECT p_partkey, p_name, quarry_tokenize(p_name) AS t FROM quarry_part)"""
    )


@query(_chunked_rules_sql(2000).replace("x AS (SELECT *, (50", "z AS (SELECT *, extraction_text AS v, (50") + ", x AS (SELECT * FROM z), " + TYPED_SQL + """ SELECT extraction_class, target_type, CAST(count(*) AS BIGINT) AS n, round(avg(least(points, 100) / 100.0), 6) AS quality FROM y GROUP BY ALL""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers of all documents, chunked, grounded, coerced, scored, without duplicates: counts by class and type."""
    r = engine.extract(_t(spark, sf_dir, "documents"), SPEC, ExtractConfig(RuleModel(RULES), max_char_buffer=2000))
    return r.extractions.groupBy("extraction_class", F.col("coerced.target_type").alias("target_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_score"), 6).alias("quality"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
