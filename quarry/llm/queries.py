"""The queries of this subpackage's operators, with production parameters, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chat import digests, format_trees, linear
from quarry.llm.decontaminate import find_leaks
from quarry.llm.embeddings import near_vectors
from quarry.llm.mixing import mix
from quarry.llm.periodic import find_runs, run_digests
from quarry.llm.personal import find_private, private_digests
from quarry.llm.quality import score_quality
from quarry.llm.secrets import BASE, KINDS, SCOPE, WEAK, scan_secrets
from quarry.llm.simhash import near_groups
from quarry.llm.suffix import remove_repeats
from quarry.llm.tokens import count_tokens
from quarry.llm.toxicity import score_toxicity
from quarry.llm.vector_codes import Settings as CodeSettings
from quarry.llm.vector_codes import compress_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=400).drop("removed")


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.05)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(format_trees(linear(rows)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, fold=0)
    return r.withColumn("n_passages", F.size("passages").cast("long")).drop("passages")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, folds=4, fold=2)


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), words=3, radius=3)


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), slots=1000, power=0.5, block=8)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that operator 11 is given: in a tenth of the documents they repeat themselves from some place on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(_table(spark, sf_dir, "documents"), least=24, times=3, edit=repeated_tail))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings"), CodeSettings(parts=16, entries=64, rounds=2, scale=256)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_digests(find_private(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts, op2_repeated_passages, op3_benchmark_leaks, op4_near_vectors, op5_secret_scan, op6_chat_format, op7_toxicity, op8_quality, op9_simhash_groups,
        op10_source_mixture, op11_periodic_runs, op12_vector_codes, op13_private_data,
    )
    return {f.__name__: f for f in every}


def _parts_sql(kind: str, pattern: str, least: int) -> str:
    """Matches of one kind with code-point offsets: gaps and matches of each text, summed along the text."""
    p = f"(?s)(.*?)({pattern}|$)".replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, e - w AS s, e FROM (
      SELECT doc_id, length(w) AS w, h, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, unnest(g) AS g, unnest(w) AS w, unnest(h) AS h, generate_subscripts(w, 1) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS g, regexp_extract_all(text, '{p}', 2) AS w, regexp_extract_all(text, '{p}', 3) AS h FROM d)))
      WHERE w > 0 AND length(h) >= {least}"""


#: The same spans by other means: RE2 has no looking around, so bare keys are whole runs of key letters that pass as a whole.
SECRETS_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), base AS ("
    + " UNION ALL ".join(_parts_sql(k, p, n) for k, p, n in BASE)
    + "), runs AS ("
    + _parts_sql("bare", "([A-Za-z0-9+/=_-]+)", 32)
    + "), bare AS (SELECT r.* FROM runs r JOIN d USING (doc_id) WHERE regexp_full_match(substr(d.text, CAST(r.s + 1 AS BIGINT), CAST(r.e - r.s AS BIGINT)), '[A-Za-z0-9+/_-]{32,}={0,2}')"
    + "".join(f" AND regexp_matches(substr(d.text, CAST(r.s + 1 AS BIGINT), CAST(r.e - r.s AS BIGINT)), '{c}')" for c in ("[0-9]", "[A-Z]", "[a-z]"))
    + "), ident AS ("
    + _parts_sql(*WEAK[0])
    + "), ends AS ("
    + _parts_sql(*WEAK[2])
    + f"""), names AS (SELECT * FROM base WHERE kind = 'access' UNION ALL SELECT * FROM ident),
    keys AS (SELECT * FROM base WHERE kind <> 'access' UNION ALL SELECT * FROM bare),
    every AS (SELECT * FROM base
      UNION ALL SELECT * FROM ident x WHERE EXISTS (SELECT 1 FROM keys k WHERE k.doc_id = x.doc_id AND k.s - {SCOPE} < x.e AND x.s < k.e + {SCOPE})
      UNION ALL SELECT * FROM bare x WHERE EXISTS (SELECT 1 FROM names k WHERE k.doc_id = x.doc_id AND k.s - {SCOPE} < x.e AND x.s < k.e + {SCOPE})
      UNION ALL SELECT * FROM ends x WHERE EXISTS (SELECT 1 FROM names k WHERE k.doc_id = x.doc_id AND k.s - {SCOPE} < x.e AND x.s < k.e + {SCOPE})
        AND EXISTS (SELECT 1 FROM keys k WHERE k.doc_id = x.doc_id AND k.s - {SCOPE} < x.e AND x.s < k.e + {SCOPE})),
    said AS (SELECT doc_id, kind, s, list_position({KINDS}, kind) AS r, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS t FROM every)
    SELECT d.doc_id, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
      sha256(coalesce(string_agg(t, ',' ORDER BY s, r) FILTER (r <= 3), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY s, r), '') AS spans
    FROM d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id"""
)

VECTORS_SQL = """WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND list_bool_and(list_transform(v, lambda a: a IS NOT NULL AND isfinite(a))) AND list_sum(list_transform(v, lambda a: a * a)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, m AS component_id, vec_id = m AS kept
    FROM (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a)"""

CHAT_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '\\<\\\1', 'g'), '\[(/?(INST|ROLE)\])', '\\[\\\1', 'g') AS body,
             regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '\\<\\\1', 'g'), '\[(/?(INST|ROLE)\])', '\\[\\\1', 'g') AS who FROM c)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(3 + sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 17 + length(who) END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


#: crc32 bit by bit; equal words less than a third of the text apart, gathered by distance into stretches of consecutive places.
RUNS_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    h AS (SELECT *, len(w) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS h FROM d),
    a AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h WHERE n > 0),
    e AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM a),
    x AS (SELECT doc_id, n, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS i FROM e),
    same AS (SELECT l.doc_id, l.i, r.i - l.i AS p FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.v = r.v AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
    isle AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same),
    found AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM isle GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(24, 3 * p)),
    runs AS (SELECT doc_id, s, len, min(p) AS p FROM found GROUP BY doc_id, s, len),
    said AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat_ws(',', s, len, p) || chr(10), '' ORDER BY s, p) AS t, arg_min({'s': s, 'l': len, 'p': p}, ROW(-CAST(len AS DOUBLE) / p, s, p)) AS best FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
      CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(said.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
    FROM d LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Every part against every entry, without trees."""
    ctes = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
    f"x AS (SELECT vec_id, label, m AS part, e[m * len(e) // {parts} + 1 : (m + 1) * len(e) // {parts}] AS x FROM v, range({parts}) r(m))",
    f"b0 AS (SELECT part, k, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))"]
    for n in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        ctes.append(f"a{n} AS (SELECT vec_id, label, x.part, any_value(x.x) AS x, min({{'far': CAST({far} AS BIGINT), 'k': k}}) AS best FROM x JOIN b{n} b ON x.part = b.part GROUP BY vec_id, label, x.part)")
        if n < rounds:
            ctes.append(f"""m{n} AS (SELECT part, k, list(f ORDER BY i) AS c FROM (SELECT part, best.k AS k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS f FROM a{n}, range(1, len(x) + 1) r(i) GROUP BY ALL) GROUP BY part, k)""")
            ctes.append(f"b{n + 1} AS (SELECT part, k, coalesce(m{n}.c, b{n}.c) AS c FROM b{n} LEFT JOIN m{n} USING (part, k))")
    return f"""WITH {', '.join(ctes)}, one AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best.k), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) FROM b{rounds}) AS codebooks_sha256 FROM one"""


def oracle_sql() -> dict[str, str]:
    """Token counts, repeated passages, edit matching, scores, SimHash and the schedule have no plain SQL; tests/llm has their brute force."""
    return {"op4_near_vectors": VECTORS_SQL, "op5_secret_scan": SECRETS_SQL, "op6_chat_format": CHAT_SQL, "op11_periodic_runs": RUNS_SQL, "op12_vector_codes": _codes_sql(16, 64, 2, 256)}
