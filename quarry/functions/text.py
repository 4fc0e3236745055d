"""Text normalisation as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.operators.tokens import SPACE


def squeeze(text: Column) -> Column:
    """White space runs (Unicode) as one blank, none at the ends. Spark's trim knows only blanks, so it comes last."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_to_text(html: Column) -> Column:
    """Tags become blanks, then squeeze(); entities and script bodies stay as they are."""
    return squeeze(F.regexp_replace(html, "<[^>]*>", " "))


def sanitized(text: Column) -> Column:
    """squeeze(), null where nothing is left (the caller reports that as an error of the row)."""
    return F.nullif(squeeze(text), F.lit(""))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def is_url(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def split_words(text: str | None) -> list[str]:
    """words() of a text outside the JVM; str.split() knows four more characters as white space."""
    return [w for w in re.split(rf"[{SPACE}]+", text or "") if w]


def first_words(text: str | None, many: int) -> list[str]:
    """The first of split_words(); the rest of the text is not read."""
    return [m[0] for m in islice(re.finditer(rf"[^{SPACE}]+", text or ""), many)]


def clamp(position: Column, text: Column) -> Column:
    return F.greatest(F.lit(0), F.least(position, F.length(text)))
