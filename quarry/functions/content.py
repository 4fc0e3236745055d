"""Content-type detection: Column expressions where they suffice, strict parsers over Arrow batches for the rest."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JSON, YAML, HTML, PLAIN = "json", "yaml", "html", "plain_text"
_TAG = re.compile("<[^>]+>")


def _refuse(name: str) -> None:
    raise ValueError(name)


def strict_json(text: str):
    """json.loads without the names that JSON lacks (NaN, Infinity)."""
    return json.loads(text, parse_constant=_refuse)


def detect(text: str | None) -> str:
    """The kind of a text: strict JSON object or array, YAML with a marker, anything with a tag, else plain."""
    t = (text or "").strip()
    if (t[:1], t[-1:]) in (("{", "}"), ("[", "]")):
        try:
            strict_json(t)
            return JSON
        except ValueError:
            pass
    if "---" in t or ": " in t:
        import yaml

        try:
            yaml.load(t, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            return YAML
        except (yaml.YAMLError, ValueError, RecursionError):
            pass
    return HTML if _TAG.search(t) else PLAIN


def with_content_type(df: DataFrame, text_col: str = "text", to: str = "content_type") -> DataFrame:
    """df and a column with detect() of its text. Texts that neither look like JSON nor hold a YAML marker are decided in the
    JVM by their tags; only the others' texts are sent to the parsers."""
    text = F.col(text_col)
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    shaped = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    asks = F.coalesce(shaped | bare.contains("---") | bare.contains(": "), F.lit(False))

    @F.pandas_udf("string")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(detect, na_action="ignore")

    return df.withColumn(to, F.when(asks, parsed(F.when(asks, text))).when(text.rlike("<[^>]+>"), HTML).otherwise(PLAIN))
