"""Data model: row types, examples, errors, and the small expressions on intervals and ids."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, GREATER, LESSER, FUZZY = "match_exact", "match_greater", "match_lesser", "match_fuzzy"
STATUSES = (EXACT, GREATER, LESSER, FUZZY)
WORD, NUMBER, PUNCTUATION, ACRONYM = "Word", "Number", "Punctuation", "Acronym"
FORMATS = ("json", "yaml")

INTERVAL = "struct<start_pos:bigint,end_pos:bigint>"
TOKEN = "token_index int, token_type string, token_text string, start_pos bigint, end_pos bigint, first_token_after_newline boolean"
CHUNK = "chunk_id int, text string, char_offset bigint, char_length bigint, has_overlap boolean, overlap_start int, overlap_end int"


class QuarryError(Exception):
    """Base of all errors that the engine raises on the driver; failures of single rows go to `error` columns."""


class ConfigurationError(QuarryError):
    pass


class InvalidInputError(QuarryError):
    pass


class InferenceError(QuarryError):
    def __init__(self, message: str, transient: bool = False):
        super().__init__(message)
        self.transient = transient
        self.retries = 0


class ResolverError(QuarryError):
    pass


class TemplateError(QuarryError):
    pass


class PipelineError(QuarryError):
    pass


class ExportError(QuarryError):
    pass


def parse_format(name: str) -> str:
    if (low := name.strip().lower()) not in FORMATS:
        raise ConfigurationError(f"Invalid format: {name}")
    return low


@dataclass(frozen=True)
class Extraction:
    """A worked example's value; attributes are free JSON."""

    extraction_class: str
    extraction_text: str
    description: str | None = None
    attributes: dict[str, Any] = field(default_factory=dict)

    def attribute(self, name: str) -> Any:
        return self.attributes.get(name)

    def with_attribute(self, name: str, value: Any) -> Extraction:
        return Extraction(self.extraction_class, self.extraction_text, self.description, {**self.attributes, name: value})


@dataclass(frozen=True)
class Example:
    """A few-shot example: a text and what should come out of it."""

    text: str
    extractions: tuple[Extraction, ...] = ()


def expected_fields(examples: list[Example]) -> list[str]:
    """Distinct classes of the examples, sorted."""
    return sorted({e.extraction_class for x in examples for e in x.extractions})


#: What a JSON schema calls the kinds of values.
_JSON_KINDS = ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array"), (dict, "object"))


def json_kind(value: Any) -> str:
    return next((name for kind, name in _JSON_KINDS if isinstance(value, kind)), "null")


def answer_schema(examples: list[Example]) -> dict[str, Any]:
    """A JSON schema of answers like the examples: {data: [{class: value}]}, with the classes of all examples and no others.

    A class takes texts, and besides what all of its examples are when they are read as JSON (whole numbers, numbers, truth values),
    as models like to give these without quotes. Every class is required, as strict servers want it, but may be null.
    """
    kinds: dict[str, set[str]] = {}
    for x in examples:
        for e in x.extractions:
            try:
                kind = json_kind(json.loads(e.extraction_text))
            except ValueError:
                kind = "string"
            kinds.setdefault(e.extraction_class, set()).add(kind)
    fold = {frozenset(("integer",)): ["integer"], frozenset(("number",)): ["number"], frozenset(("integer", "number")): ["number"], frozenset(("boolean",)): ["boolean"]}
    classes = {k: {"type": ["string", *fold.get(frozenset(v), []), "null"]} for k, v in sorted(kinds.items())}
    item = {"type": "object", "properties": classes, "required": list(classes), "additionalProperties": False}
    return {"type": "object", "properties": {"data": {"type": "array", "items": item}}, "required": ["data"], "additionalProperties": False}


def violations(value: Any, schema: dict[str, Any], at: str = "answer") -> list[str]:
    """Where a value is not as the schema has it: kinds, required and unknown keys, items of arrays."""
    allowed = schema.get("type")
    kind = json_kind(value)
    allowed = [allowed] if isinstance(allowed, str) else allowed
    if allowed and kind not in allowed and not (kind == "integer" and "number" in allowed):
        return [f"{at} is {kind}, not {' or '.join(allowed)}"]
    out = []
    if kind == "object":
        known = schema.get("properties", {})
        out += [f"{at} lacks {k}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at} has the unknown key {k}" for k in value if k not in known]
        out += [v for k, x in value.items() if k in known for v in violations(x, known[k], f"{at}.{k}")]
    if kind == "array" and "items" in schema:
        out += [v for i, x in enumerate(value) for v in violations(x, schema["items"], f"{at}[{i}]")]
    return out


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Do [s1, e1) and [s2, e2) overlap? False if any end is missing."""
    return F.coalesce((s1 < e2) & (s2 < e1), F.lit(False))


def interval_length(start: Column, end: Column) -> Column:
    return F.when(end >= start, end - start)


def document_id(text: Column) -> Column:
    """An id for texts without one: doc_ and eight hex digits of the text's hash, the same on every run."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(text, 256), 1, 8))


def token_interval(start: int, end: int) -> tuple[int, int]:
    if start >= end:
        raise InvalidInputError(f"Start index {start} must be < end index {end}")
    return start, end
