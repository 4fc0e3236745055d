"""Model answers: cleaning, strict parsing, repair, and one row for each extracted value."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame

from quarry.functions.content import strict_json
from quarry.operators.arrow import explode_rows
from quarry.schema import ResolverError

#: The fences that are dropped, and the class of an answer that can't be parsed.
FENCE = r"```(json|yaml|python|javascript|rust)?"
RAW = "raw_response"
EXTRACTION = "ordinal int, extraction_class string, extraction_text string, group_index int"


def clean(response: str) -> str:
    return re.sub(FENCE, "", response).strip()


def parse(response: str, yaml: bool = False) -> Any:
    """The JSON value of an answer: the whole of it, else from its first { to its last }. With yaml, YAML is tried then."""
    text = clean(response)
    try:
        return strict_json(text)
    except ValueError:
        pass
    a, b = text.find("{"), text.rfind("}")
    if 0 <= a < b:
        try:
            return strict_json(text[a : b + 1])
        except ValueError:
            pass
    if yaml:
        import yaml as y

        try:
            if isinstance(value := y.safe_load(text), dict | list):
                return value
        except (y.YAMLError, ValueError):
            pass
    raise ResolverError("Failed to parse the response as JSON")


def _found(field: str, text: str) -> str | None:
    """The value behind `field` and a separator; the separator right behind it first, then with blanks before it."""
    name = re.escape(field)
    shapes = [re.search(p, text) for p in (rf"(?i){name}[:\-=]\s*([^\n\r,]*)", rf"(?i){name}\s*[:\-=]\s*([^\n\r,]*)")]
    if not any(shapes):
        return None
    return next((m[1].strip() for m in shapes if m and m[1].strip()), "")


def repair(value: Any, fields: list[str]) -> Any:
    """An object of one key whose text names two or more expected fields becomes an object of those fields."""
    if isinstance(value, dict) and len(value) == 1:
        text = next(iter(value.values()))
        if isinstance(text, str):
            found = {f: v for f in fields if (v := _found(f, text)) is not None}
            if len(found) > 1 and (made := {f: v for f, v in found.items() if v}):
                return made
    return value


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def explode(value: Any, unwrap: bool = False) -> list[tuple[str, str, int | None]]:
    """(class, text, group) of a parsed answer: objects give a value for each key, in key order; nulls give none.

    An array's items are groups; an object that holds an array `data`, else `results`, stands for it (with unwrap, `extractions`
    too). A text item is its own class; any other kind of item is an error; a lone scalar gives nothing.
    """
    items = value if isinstance(value, list) else None
    if isinstance(value, dict):
        items = next((value[k] for k in ("data", "results", *(["extractions"] if unwrap else [])) if isinstance(value.get(k), list)), None)
        if items is None:
            return [(k, _text(v), None) for k, v in sorted(value.items()) if v is not None]
    out: list[tuple[str, str, int | None]] = []
    for i, item in enumerate(items or []):
        if isinstance(item, dict):
            out += [(k, _text(v), i) for k, v in sorted(item.items()) if v is not None]
        elif isinstance(item, str):
            out.append((f"item_{i}", item, None))
        else:
            raise ResolverError(f"Item {i} is neither an object nor a text")
    return out


def parse_rows(response: str | None, fields: list[str], yaml: bool = False, unwrap: bool = False) -> list[tuple[int, str, str, int | None]]:
    """explode() of a response with ordinals; one raw_response row if it can't be parsed, none if it is null."""
    if response is None:
        return []
    try:
        values = explode(repair(parse(response, yaml), fields), unwrap)
    except ResolverError:
        values = [(RAW, response, None)]
    return [(n, *v) for n, v in enumerate(values)]


def extractions(responses: DataFrame, fields: list[str], yaml: bool = False, unwrap: bool = False, response_col: str = "response", keep_response: bool = False) -> DataFrame:
    """responses' columns, then (ordinal, extraction_class, extraction_text, group_index), a row for each value."""
    return explode_rows(responses, [response_col], lambda r: parse_rows(r, fields, yaml, unwrap), EXTRACTION, () if keep_response else (response_col,))


def json_leaves(value: Any, path: str = "") -> list[tuple[str, str]]:
    """(class path, text) of all non-empty texts in a JSON value, depth first: a:b:[i]:c."""
    if isinstance(value, str):
        return [(path, value)] if value else []
    if isinstance(value, dict):
        pairs = [(k, v) for k, v in sorted(value.items())]
    elif isinstance(value, list):
        pairs = [(f"[{i}]", v) for i, v in enumerate(value)]
    else:
        return []
    return [x for k, v in pairs for x in json_leaves(v, f"{path}:{k}" if path else k)]


def leaf_rows(df: DataFrame, text_col: str = "extraction_text", class_col: str = "extraction_class", whole: bool = False) -> DataFrame:
    """df's columns and (leaf_index, leaf_class, leaf_text): the leaves of values that are JSON objects or arrays, else the value
    itself (leaf_index 0). whole: the value itself in any case, before its leaves, which count from 1."""

    def make(name: str | None, text: str | None) -> list[tuple[int, str | None, str | None]]:
        try:
            value = strict_json(text or "")
        except (ValueError, RecursionError):
            value = None
        nested = isinstance(value, dict | list)
        leaves = [(i, *x) for i, x in enumerate(json_leaves(value, name or "") if nested else [], 1)]
        return [(0, name, text), *leaves] if whole or not nested else leaves

    return explode_rows(df, [class_col, text_col], make, "leaf_index int, leaf_class string, leaf_text string")
