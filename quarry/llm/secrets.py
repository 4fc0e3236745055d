"""Secret scans: multipart credentials linked by an interval join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import fresh, text_key, written

#: Kind, pattern, and what the pattern's match must hold besides (the group that is measured, its least length).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    ("hex", r"([0-9a-f]{32,})", 32),
)
#: Weak candidates, reported only with their complement in scope: identifiers, bare keys, endpoints.
WEAK = (
    ("identifier", r"""(?i:client|account|access|user|app)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_-]+)""", 8),
    ("bare", r"(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2})(?![A-Za-z0-9+/=_-])", 32),
    ("endpoint", r"""(https?://[^\s"'<>\\^`{|}]+)""", 12),
)
KINDS = [k for k, _, _ in BASE + WEAK]
#: A cheap test that every match's text passes, so that texts without it skip the pattern.
NEEDS = {"access": "AKIA", "endpoint": "://"}
#: Code points around a part within which its complements count.
SCOPE = 256


def _matches(kind: str, pattern: str, text: Column) -> Column:
    """All leftmost non-overlapping matches: array of (kind, idx, gap, len, held), gap being what lies before the match.

    The pattern is put behind a lazy gap and may match the end of the text instead, so every text is consumed in one pass.
    """
    p = f"(?s)(.*?)({pattern}|\\z)"
    gaps, whole, held = (F.regexp_extract_all(text, F.lit(p), F.lit(g)) for g in (1, 2, 3))
    made = F.transform(
        F.arrays_zip(gaps.alias("g"), whole.alias("w"), held.alias("h")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["w"]).cast("long").alias("len"), F.length(x["h"]).cast("long").alias("held")),
    )
    some = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(pattern)
    return F.when(some, made)


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, copies, kind, start, end): matches of all kinds, weak ones too, and one row of null kind for each text.

    Offsets are code points, end exclusive. copies counts equal rows (same id and text), which are scanned as one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", text_key(F.col("text")))
    none = F.array(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("idx", "int"), ("gap", "long"), ("len", "long"), ("held", "long")))))
    each = [F.coalesce(_matches(k, p, F.col("text")), F.filter(none, lambda x: F.lit(False))) for k, p, _ in BASE + WEAK]
    x = d.select("doc_id", "text_key", F.inline(F.concat(none, *each)))
    x = x.groupBy("doc_id", "text_key", "kind", "idx", "gap", "len", "held").agg(F.count(F.lit(1)).alias("copies"))
    upto = Window.partitionBy("doc_id", "text_key", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    least = F.create_map(*(F.lit(v) for k, _, n in BASE + WEAK for v in (k, n)))
    return x.filter(F.col("kind").isNull() | ((F.col("len") > 0) & (F.col("held") >= least[F.col("kind")]))).select("doc_id", "text_key", "copies", "kind", "start", "end")


def _near(some: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Rows of some that have one of others within scope in the same text: an interval join by buckets of scope code points.

    Both sides are in every bucket that they touch, as spans may cross buckets; rows of some are distinct, and stay so.
    A bucket holds a bounded stretch of one text, so no key can gather many rows, however common a text is.
    """
    o = others.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("start").alias("os"), F.col("end").alias("oe"))
    o = o.withColumn("ob", F.explode(F.sequence(F.floor((F.col("os") - scope) / scope), F.floor((F.col("oe") + scope) / scope))))
    s = some.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))))
    within = (F.col("os") - scope < F.col("end")) & (F.col("start") < F.col("oe") + scope)
    return s.join(o, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("b") == F.col("ob")) & within, "left_semi").drop("b").distinct()


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, copies, kind, start, end) of every reported span, and one row of null kind for each text.

    Base kinds are always reported. A weak identifier needs a secret (assign, hex or bare) within `scope` code points, a bare
    key an identifier (access or weak), an endpoint both. Texts that are null or empty have no spans.
    """
    p = written(parts(docs, id_col, text_col), "parts")
    of = lambda *kinds: p.filter(F.col("kind").isin(*kinds))
    names, keys = of("access", "identifier"), of("assign", "hex", "bare")
    out = p.filter(F.col("kind").isNull() | F.col("kind").isin(*(k for k, _, _ in BASE)))
    for more in (_near(of("identifier"), keys, scope), _near(of("bare"), names, scope), _near(_near(of("endpoint"), names, scope), keys, scope)):
        out = out.unionByName(more)
    return out


def _spans(found: DataFrame) -> DataFrame:
    """One row for each text: its spans by start, then kind as listed."""
    rank = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    item = F.when(F.col("kind").isNotNull(), F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))
    g = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(item)).alias("spans"), F.max(F.when(F.col("kind").isNull(), F.col("copies"))).alias("copies"))
    return g


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of base kinds, the base spans' digest, and all spans as text.

    Repeated rows give repeated results; a null text counts as empty; rows with a null id are kept.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    g = _spans(find_secrets(docs, scope, id_col, text_col))
    said = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    out = g.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, (k, _, _) in enumerate(BASE)),
        F.sha2(said(F.filter("spans", lambda x: x["rank"] < len(BASE))).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), "copies",
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def redact_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every reported span replaced by [kind]; overlapping spans become one. All rows and columns stay,
    whatever the columns are called; rows with null or repeated ids are redacted each by its own text."""
    g = _spans(find_secrets(docs, scope, id_col, text_col)).filter(F.size("spans") > 0)
    merged = F.aggregate(
        F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))),
        F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("kind"))), lambda x: F.lit(False)),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"), F.try_element_at(acc, F.lit(-1))["kind"].alias("kind")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    d, k, m = fresh(docs, "_d", "_k", "_m")
    g = g.select(F.col("doc_id").alias(d), F.col("text_key").alias(k), merged.alias(m))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = docs.join(g, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (text_key(text) == F.col(k)), "left")
    upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(F.col(m), i)["end"])
    piece = lambda x, i: F.concat(F.substring(text, (upto(i) + 1).cast("int"), (x["start"] - upto(i)).cast("int")), F.lit("["), x["kind"], F.lit("]"))
    clean = F.concat(F.array_join(F.transform(m, piece), ""), F.substring(text, (F.try_element_at(F.col(m), F.lit(-1))["end"] + 1).cast("int"), F.length(text)))
    return x.withColumn(text_col, F.when(F.col(m).isNotNull(), clean).otherwise(F.col(text_col))).select(*docs.columns)
