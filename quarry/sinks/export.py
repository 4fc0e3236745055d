"""Exports: JSON and CSV as Column expressions, reports as text over nested rows, one for each document."""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import csv_escape
from quarry.operators.aggregate import ORDER, nested
from quarry.operators.arrow import slices
from quarry.operators.responses import leaf_rows
from quarry.schema import ExportError

FORMATS = ("text", "html", "markdown", "json", "csv", "yaml")


@dataclass(frozen=True)
class ExportConfig:
    format: str = "html"
    intervals: bool = True
    include_text: bool = True
    highlight: bool = True
    statistics: bool = True
    title: str | None = None
    css: str | None = None


def csv_columns(c: ExportConfig) -> list[str]:
    return ["extraction_class", "extraction_text", "description", *(["start_char", "end_char", "alignment_status"] if c.intervals else []), "group_index"]


def csv_line(c: ExportConfig = ExportConfig()) -> Column:
    """One extraction as a CSV line; columns as csv_columns(). Needs description, start_pos, end_pos, alignment_status, group_index."""
    text = lambda x: F.coalesce(csv_escape(F.col(x)), F.lit(""))
    whole = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    middle = [whole("start_pos"), whole("end_pos"), F.coalesce("alignment_status", F.lit("None"))] if c.intervals else []
    return F.concat_ws(",", text("extraction_class"), text("extraction_text"), text("description"), *middle, whole("group_index"))


def write_csv(rows: DataFrame, path: str, c: ExportConfig = ExportConfig()) -> None:
    names = {"start_pos": "start_char", "end_pos": "end_char"}
    keep = [n for n in ("extraction_class", "extraction_text", "description", "start_pos", "end_pos", "alignment_status", "group_index") if c.intervals or n not in ("start_pos", "end_pos", "alignment_status")]
    rows.select(*(F.col(n).alias(names.get(n, n)) for n in keep)).write.csv(path, header=True, escape='"', quote='"')


def json_document(docs: DataFrame, rows: DataFrame, c: ExportConfig = ExportConfig(), id_col: str = "doc_id") -> DataFrame:
    """(doc_id, json) for every document of docs, also those without extractions: options, text, extractions, statistics."""
    counts = rows.groupBy(id_col, "extraction_class").agg(F.count(F.lit(1)).alias("n")).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("extraction_class", "n"))).alias("classes"))
    fields = ("extraction_class", "extraction_text", "description", "start_pos", "end_pos", "alignment_status", "group_index")
    x = docs.select(id_col, "text").join(nested(rows, id_col, fields), id_col, "left").join(counts, id_col, "left")
    interval = lambda e: F.when(e["start_pos"].isNotNull(), F.struct(e["start_pos"].alias("start_char"), e["end_pos"].alias("end_char"), F.coalesce(e["alignment_status"], F.lit("None")).alias("alignment_status")))
    one = lambda e: F.struct(e["extraction_class"].alias("extraction_class"), e["extraction_text"].alias("extraction_text"), e["description"].alias("description"), *([interval(e).alias("char_interval")] if c.intervals else []), e["group_index"].alias("group_index"))
    listed = F.coalesce(F.transform("extractions", one), F.transform(F.array_repeat(F.get("extractions", F.lit(0)), 0), one))
    stats = F.struct(F.coalesce(F.size("extractions"), F.lit(0)).alias("total_extractions"), F.length("text").alias("text_length"), F.coalesce(F.size("classes"), F.lit(0)).alias("unique_classes"), F.map_from_entries("classes").alias("extraction_classes"))
    options = F.struct(F.lit("json").alias("format"), F.lit(c.intervals).alias("show_char_intervals"), F.lit(c.include_text).alias("include_text"), F.lit(c.statistics).alias("include_statistics"), F.lit(c.title).cast("string").alias("title"))
    parts = [F.col(id_col).cast("string").alias("document_id"), options.alias("export_config"), *([F.col("text")] if c.include_text else []), listed.alias("extractions"), *([stats.alias("statistics")] if c.statistics else [])]
    return x.select(id_col, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def pick(spans: list[dict], length: int) -> list[dict]:
    """Spans that fit and do not overlap an earlier one, by start."""
    out, last = [], 0
    for s in sorted((s for s in spans if s["start_pos"] is not None and 0 <= s["start_pos"] < s["end_pos"] <= length), key=lambda s: s["start_pos"]):
        if s["start_pos"] >= last:
            out.append(s)
            last = s["end_pos"]
    return out


def highlighted(text: str, spans: list[dict], mark: Callable[[dict, str], str], plain: Callable[[str], str]) -> str:
    out, at = [], 0
    for s in pick(spans, len(text)):
        out += [plain(text[at : s["start_pos"]]), mark(s, plain(text[s["start_pos"] : s["end_pos"]]))]
        at = s["end_pos"]
    return "".join([*out, plain(text[at:])])


def layered(text: str, spans: list[dict]) -> str:
    """HTML of a text under spans that may overlap: cut at every boundary, each piece once, in one element that names all its
    covers; one sweep over the boundaries. A span without a place in the text lies where its text first stands, if it does."""
    fit = []
    for s in spans:
        a, b = s["start_pos"], s["end_pos"]
        if a is None or b is None or not 0 <= a < b <= len(text):
            a = text.find(s["extraction_text"]) if s.get("extraction_text") else -1
            b = a + len(s.get("extraction_text") or "")
        if a >= 0:
            fit.append((a, b, s))
    opens, closes = {}, {}
    for i, (a, b, _) in enumerate(fit):
        opens.setdefault(a, []).append(i)
        closes.setdefault(b, []).append(i)
    cuts = sorted({0, len(text), *opens, *closes})
    out, over = [], set()
    for a, b in zip(cuts, cuts[1:], strict=False):
        over -= {*closes.get(a, ())}
        over |= {*opens.get(a, ())}
        piece = escaped(text[a:b])
        if over:
            names = escaped(" | ".join(f"{s.get('step_id') or ''}:{s['extraction_class']}".lstrip(":") for s in (fit[i][2] for i in sorted(over))))
            piece = f'<span class="layer layers-{len(over)}" title="{names}">{piece}</span>'
        out.append(piece)
    return "".join(out)


def escaped(text: str) -> str:
    return html.escape(text, quote=True)


def text_report(doc_id: str | None, text: str, found: list[dict], c: ExportConfig) -> str:
    """Plain text: a line for each value, its place first; the document's text and the counts around them."""
    out = [f"# {c.title or 'Extractions'} of {doc_id}"]
    if c.include_text:
        out += ["", text]
    out.append("")
    for e in found:
        place = f"{e['start_pos']}..{e['end_pos']} {e['alignment_status']}" if e["start_pos"] is not None else "not placed"
        more = f"  ({e['description']})" if e.get("description") else ""
        out.append((f"[{place}] " if c.intervals else "") + f"{e['extraction_class']} = {e['extraction_text']}{more}")
    if c.statistics:
        counts = sorted(Counter(e["extraction_class"] for e in found).items())
        out += ["", f"{len(found)} values in {len(text)} characters" + "".join(f"; {k} {n}" for k, n in counts)]
    return "\n".join(out) + "\n"


def markdown_report(doc_id: str | None, text: str, found: list[dict], c: ExportConfig) -> str:
    cell = lambda s: str("" if s is None else s).replace("|", "\\|").replace("\n", " ")
    out = [f"# {c.title or 'Extractions'}", ""]
    if c.include_text:
        out += ["## Text", "", "```", highlighted(text, found, lambda _, t: f"**{t}**", str) if c.highlight else text, "```", ""]
    head = ["Class", "Text", *(["Position", "Status"] if c.intervals else [])]
    out += ["## Extractions", "", f"| {' | '.join(head)} |", f"|{'---|' * len(head)}"]
    for e in found:
        more = [f"{e['start_pos']}-{e['end_pos']}" if e["start_pos"] is not None else "", e["alignment_status"]] if c.intervals else []
        out.append(f"| {' | '.join(map(cell, [e['extraction_class'], e['extraction_text'], *more]))} |")
    if c.statistics:
        counts = sorted(Counter(e["extraction_class"] for e in found).items())
        out += ["", "## Statistics", "", f"- Document: {doc_id}", f"- Characters: {len(text)}", f"- Extractions: {len(found)}", f"- Classes: {len(counts)}", *(f"  - {k}: {n}" for k, n in counts)]
    return "\n".join(out) + "\n"


_STYLE = "body{font-family:sans-serif;margin:2em}.text{white-space:pre-wrap}mark,.layer{background:#fe9;border-radius:3px;cursor:pointer}.card{border:1px solid #ccc;margin:.5em 0;padding:.5em}.on{outline:2px solid #c60}"
_SCRIPT = "document.querySelectorAll('mark').forEach(m=>m.onclick=()=>{const c=document.getElementById('e'+m.dataset.i);document.querySelectorAll('.on').forEach(x=>x.classList.remove('on'));if(c){c.classList.add('on');c.scrollIntoView()}})"


def html_report(doc_id: str | None, text: str, found: list[dict], c: ExportConfig, layers: bool = False) -> str:
    title = escaped(c.title or "Extractions")
    out = ["<!DOCTYPE html>", f'<html><head><meta charset="utf-8"><title>{title}</title><style>{_STYLE}{c.css or ""}</style></head><body><h1>{title}</h1>']
    if c.include_text:
        numbered = [e | {"i": i} for i, e in enumerate(found)]
        body = layered(text, found) if layers else highlighted(text, numbered, lambda s, t: f'<mark data-i="{s["i"]}" title="{escaped(s["extraction_class"])}">{t}</mark>', escaped) if c.highlight else escaped(text)
        out.append(f'<div class="text">{body}</div>')
    if layers:
        steps = sorted({e.get("step_id") or "" for e in found})
        out.append("<ul class=legend>" + "".join(f"<li>{escaped(s)}</li>" for s in steps) + "</ul>")
    for i, e in enumerate(found):
        where = f" <small>{e['start_pos']}-{e['end_pos']} {escaped(e['alignment_status'] or 'None')}</small>" if c.intervals and e["start_pos"] is not None else ""
        out.append(f'<div class="card" id="e{i}"><b>{escaped(e["extraction_class"])}</b> {escaped(e["extraction_text"])}{where}</div>')
    if c.statistics:
        counts = sorted(Counter(e["extraction_class"] for e in found).items())
        out.append(f"<h2>Statistics</h2><p>{escaped(str(doc_id))}: {len(text)} characters, {len(found)} extractions</p><ul>" + "".join(f"<li>{escaped(k)}: {n}</li>" for k, n in counts) + "</ul>")
    return "\n".join([*out, f"<script>{_SCRIPT}</script></body></html>"])


def reports(docs: DataFrame, rows: DataFrame, c: ExportConfig = ExportConfig(), id_col: str = "doc_id", layers: bool = False, expanded: bool = False) -> DataFrame:
    """(doc_id, report) for every document of docs: text, markdown or html (layers: of a pipeline, spans may overlap; expanded: with the
    leaves of JSON values)."""
    if c.format not in FORMATS:
        raise ExportError(f"Unknown export format: {c.format}")
    fields = ("extraction_class", "extraction_text", "description", "start_pos", "end_pos", "alignment_status", "group_index", "step_id")
    for f, kind in (("description", "string"), ("step_id", "string"), ("group_index", "int")):
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast(kind))
    if expanded:
        leaf = F.col("leaf_index") > 0
        rows = leaf_rows(rows, whole=True).withColumns({"extraction_class": F.col("leaf_class"), "extraction_text": F.col("leaf_text"), "start_pos": F.when(~leaf, F.col("start_pos")), "end_pos": F.when(~leaf, F.col("end_pos"))})
    if c.format == "json":
        return json_document(docs, rows, c, id_col).withColumnRenamed("json", "report")
    if c.format == "csv":
        lines = nested(rows.withColumn("line", csv_line(c)), id_col, ("line",), (*ORDER, "item"))
        x = docs.select(id_col).join(lines, id_col, "left")
        listed = F.coalesce(F.transform("extractions", lambda e: e["line"]), F.array().cast("array<string>"))
        return x.select(id_col, F.concat(F.array_join(F.concat(F.array(F.lit(",".join(csv_columns(c)))), listed), "\n"), F.lit("\n")).alias("report"))
    x = docs.select(F.col(id_col), F.coalesce("text", F.lit("")).alias("text")).join(nested(rows, id_col, fields, (*ORDER, "item", "leaf_index")), id_col, "left")
    make = {"text": text_report, "markdown": markdown_report, "html": html_report, "yaml": yaml_report}[c.format]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = {"layers": True} if layers and c.format == "html" else {}
        one = lambda i, t, f: make(None if i is None else str(i), t, f or [], c, **more)
        for b in batches:
            for part in slices(b):  # nested values take many times their size as objects
                made = [one(*row) for row in zip(*(col.to_pylist() for col in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], [id_col, "report"])

    return x.mapInArrow(run, f"`{id_col}` {dict(x.dtypes)[id_col]}, report string")


def yaml_report(doc_id: str | None, text: str, found: list[dict], c: ExportConfig) -> str:
    import yaml

    keep = [k for k in ("extraction_class", "extraction_text", "description", "start_pos", "end_pos", "alignment_status", "group_index") if c.intervals or k not in ("start_pos", "end_pos", "alignment_status")]
    out = {"document_id": doc_id} | ({"text": text} if c.include_text else {}) | {"extractions": [{k: e[k] for k in keep if e.get(k) is not None} for e in found]}
    return yaml.safe_dump(out, sort_keys=False, allow_unicode=True)


def write_raw(responses: DataFrame, path: str, run_id: str) -> None:
    """Raw answers with their keys, for later inspection or replay: one folder for each run."""
    responses.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """One column as text files, a line for each row (line breaks inside a row stay)."""
    df.select(column).write.text(path)


def flattened(rows: DataFrame, docs: DataFrame, names: dict[str, str], took_ms: int = 0, expanded: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, json): a pipeline's values as one flat list with metadata, for every document that has any.

    names: step ids in order with their names. Values without a place, and with `expanded` the leaves of JSON values (which follow
    their value), get that of their first exact occurrence in the document, if there is one. took_ms is the run's time.
    """
    x = leaf_rows(rows, whole=True) if expanded else rows.withColumns({"leaf_index": F.lit(0), "leaf_class": F.col("extraction_class"), "leaf_text": F.col("extraction_text")})
    x = x.join(docs.select(F.col(id_col).alias("_d"), F.col("text").alias("_t")), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    at = (F.nullif(F.instr("_t", F.col("leaf_text")), F.lit(0)) - 1).cast("bigint")
    own = (F.col("leaf_index") == 0) & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull()
    start, end = F.when(own, F.col("start_pos")).otherwise(at), F.when(own, F.col("end_pos")).otherwise(at + F.length("leaf_text"))
    place = F.when(start.isNotNull(), F.struct(start.alias("start_pos"), end.alias("end_pos")))
    number = F.create_map(*(F.lit(v) for i, k in enumerate(names) for v in (k, i)))
    title = F.create_map(*(F.lit(v) for k, n in names.items() for v in (k, n)))
    order = F.struct(number[F.col("step_id")].alias("s"), "item", "chunk_id", "ordinal", "leaf_index")
    one = F.struct(
        F.col("leaf_class").alias("extraction_class"), F.col("leaf_text").alias("extraction_text"), "step_id", title[F.col("step_id")].alias("step_name"), place.alias("char_interval"),
        "parent_step_id", F.when(F.col("parent_step_id").isNotNull(), F.col("parent_start")).alias("parent_start"), F.when(F.col("parent_step_id").isNotNull(), F.col("parent_end")).alias("parent_end"),
    )
    g = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), one.alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)).alias("_l"))
    meta = F.struct(F.lit(len(names)).alias("steps"), F.lit(took_ms).cast("bigint").alias("total_time_ms"), F.lit(expanded).alias("expand_nested_json"))
    return g.select("doc_id", F.to_json(F.struct(F.transform("_l", lambda x: x["v"]).alias("extractions"), meta.alias("metadata"))).alias("json"))
