"""Pipelines: extraction steps that feed on each other's values, as one graph of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import ExtractConfig, from_settings
from quarry.events import Progress, silent
from quarry.plans.engine import Spec, extract
from quarry.plans.materialise import materialised
from quarry.schema import EXACT, Example, Extraction, PipelineError
from quarry.sources.readers import read_text

LINEAGE = ("parent_step_id", "parent_class", "parent_text", "parent_start", "parent_end", "parent_status")


@dataclass(frozen=True)
class Filter:
    class_filter: str | None = None
    text_pattern: str | None = None
    max_items: int | None = None


@dataclass(frozen=True)
class Step:
    id: str
    prompt: str
    examples: tuple[Example, ...] = ()
    name: str = ""
    description: str = ""
    output_field: str = ""
    filter: Filter | None = None
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pipeline:
    name: str
    steps: tuple[Step, ...]
    description: str = ""
    version: str = "1.0.0"
    parallel: bool = False
    config: dict[str, Any] = field(default_factory=dict)

    def order(self) -> list[str]:
        """Step ids, dependencies first."""
        return [i for wave in self.waves() for i in wave]

    def waves(self) -> list[list[str]]:
        """Steps that can run side by side, wave by wave, each in the order of the file."""
        ids = [s.id for s in self.steps]
        unknown = {d for s in self.steps for d in s.depends_on} - set(ids)
        if unknown or len(set(ids)) < len(ids):
            raise PipelineError(f"Unable to resolve execution waves: {'unknown steps ' + ', '.join(sorted(unknown)) if unknown else 'repeated step ids'}")
        sorter = TopologicalSorter({s.id: s.depends_on for s in self.steps})
        try:
            sorter.prepare()
        except CycleError as e:
            raise PipelineError("Circular dependency detected") from e
        out = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=ids.index)
            out.append(ready)
            sorter.done(*ready)
        return out


def from_dict(d: dict) -> Pipeline:
    def example(x: dict) -> Example:
        return Example(x["text"], tuple(Extraction(e["extraction_class"], e["extraction_text"], e.get("description"), e.get("attributes") or {}) for e in x.get("extractions", [])))

    def step(x: dict) -> Step:
        f = x.get("filter")
        return Step(
            x["id"], x.get("prompt", ""), tuple(map(example, x.get("examples") or [])), x.get("name", x["id"]), x.get("description", ""), x.get("output_field", ""),
            Filter(f.get("class_filter"), f.get("text_pattern"), f.get("max_items")) if f else None, tuple(x.get("depends_on") or ()),
        )

    return Pipeline(d.get("name", "pipeline"), tuple(map(step, d.get("steps") or [])), d.get("description", ""), d.get("version", "1.0.0"), bool(d.get("enable_parallel_execution", False)), d.get("global_config") or {})


def load(spark: SparkSession, path: str) -> Pipeline:
    import yaml

    return from_dict(yaml.safe_load(read_text(spark, path)))


def dump(p: Pipeline) -> str:
    import yaml

    steps = []
    for s in p.steps:
        x = {k: v for k, v in asdict(s).items() if v not in (None, "", (), [])}
        x["examples"] = [{"text": e.text, "extractions": [{k: v for k, v in asdict(v).items() if v} for v in e.extractions]} for e in s.examples]
        x["depends_on"] = list(s.depends_on)
        if s.filter:
            x["filter"] = {k: v for k, v in asdict(s.filter).items() if v is not None}
        steps.append(x)
    return yaml.safe_dump({"name": p.name, "description": p.description, "version": p.version, "enable_parallel_execution": p.parallel, "global_config": p.config, "steps": steps}, sort_keys=False, allow_unicode=True)


def sample() -> Pipeline:
    """A three-step pipeline over requirement texts."""
    one = (Example("The pump shall deliver 40 litres per minute.", (Extraction("requirement", "The pump shall deliver 40 litres per minute."),)),)
    values = (Example("The pump shall deliver 40 litres per minute.", (Extraction("numeric_value", "40"), Extraction("unit", "litres per minute"))),)
    specs = (Example("All links shall use TLS 1.3.", (Extraction("encryption_spec", "TLS 1.3"),)),)
    return Pipeline(
        "requirements", (
            Step("extract_requirements", "List every requirement: a sentence with shall or must.", one, "Requirements", output_field="requirements"),
            Step("extract_values", "List numbers and their units.", values, "Values", output_field="values", filter=Filter("requirement"), depends_on=("extract_requirements",)),
            Step("extract_specifications", "List technical specifications.", specs, "Specifications", output_field="specifications", filter=Filter("requirement"), depends_on=("extract_requirements",)),
        ), "Requirements, then their values and specifications", parallel=True,
    )


def filtered(rows: DataFrame, f: Filter | None, id_col: str = "doc_id") -> DataFrame:
    """Rows of a class whose text matches a pattern, then the first max_items of each document.

    Patterns are Java's, as Spark runs them; one that Spark refuses is ignored.
    """
    if f is None:
        return rows
    if f.class_filter is not None:
        rows = rows.filter(F.col("extraction_class") == f.class_filter)
    if f.text_pattern:
        try:
            rows.sparkSession.range(1).select(F.lit("").rlike(f.text_pattern)).collect()
            rows = rows.filter(F.col("extraction_text").rlike(f.text_pattern))
        except PySparkException:
            pass
    if f.max_items is not None:
        order = [c for c in ("item", "chunk_id", "ordinal") if c in rows.columns]
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).filter(F.col("_n") <= f.max_items).drop("_n")
    return rows


def lifted(rows: DataFrame) -> DataFrame:
    """Offsets within an item become offsets in the document, where the item is known to stand in it as it is (exact); an
    unaligned value is looked for in its item first. Otherwise there are no offsets, rather than ones into something else."""
    local = F.coalesce("start_pos", F.nullif(F.instr("item_text", F.col("extraction_text")), F.lit(0)) - 1).cast("bigint")
    end = F.coalesce("end_pos", local + F.length("extraction_text")).cast("bigint")
    known = F.col("parent_start").isNotNull() & F.coalesce(F.col("parent_status") == EXACT, F.lit(True))
    return rows.withColumn("_s", local).withColumn("_e", end).withColumn("start_pos", F.when(known, F.col("_s") + F.col("parent_start"))).withColumn("end_pos", F.when(known, F.col("_e") + F.col("parent_start"))).drop("_s", "_e")


@dataclass
class PipelineResult:
    pipeline: Pipeline
    steps: dict[str, DataFrame]
    took_ms: int = 0

    def rows(self) -> DataFrame:
        """All steps' rows."""
        out = None
        for i in self.pipeline.order():
            out = self.steps[i] if out is None else out.unionByName(self.steps[i])
        return out

    @property
    def names(self) -> dict[str, str]:
        """Step ids in order with their names."""
        by = {s.id: s.name or s.id for s in self.pipeline.steps}
        return {i: by[i] for i in self.pipeline.order()}


def _items(docs: DataFrame, step: Step, done: dict[str, DataFrame], id_col: str) -> DataFrame:
    """A step's inputs with their lineage: documents, or the filtered values of the steps that it depends on.

    `key` numbers the rows once and is written with them, so null and repeated document ids never mix items up.
    """
    if step.depends_on:
        inputs = None
        for k, d in enumerate(step.depends_on):
            part = filtered(done[d], step.filter).select(
                "doc_id", F.struct(F.lit(k).alias("k"), "item", "chunk_id", "ordinal").alias("at"), F.col("extraction_text").alias("text"), F.lit(d).alias("parent_step_id"), F.col("extraction_class").alias("parent_class"),
                F.col("extraction_text").alias("parent_text"), F.col("start_pos").alias("parent_start"), F.col("end_pos").alias("parent_end"), F.col("alignment_status").alias("parent_status"),
            )
            inputs = part if inputs is None else inputs.unionByName(part)
        # parents of one document, numbered in order; a document's values are few beside its text
        inputs = inputs.withColumn("item", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).drop("at")
    else:
        none = {c: F.lit(None).cast("string") for c in ("parent_step_id", "parent_class", "parent_text", "parent_status")}
        inputs = docs.select(F.col(id_col).alias("doc_id"), "text").withColumn("item", F.lit(0)).withColumns(none).withColumn("parent_start", F.lit(0).cast("bigint")).withColumn("parent_end", F.length("text").cast("bigint"))
    return materialised(inputs.withColumn("key", F.monotonically_increasing_id()), "items")


def execute(docs: DataFrame, pipeline: Pipeline, config: ExtractConfig, id_col: str = "doc_id", on_event: Callable = silent) -> PipelineResult:
    """Runs the steps over all documents at once: an item (a document, or a value of an earlier step) is a row.

    The pipeline's own settings (global_config) go before those of `config`. With pipeline.parallel the steps of a wave run
    side by side, as Spark jobs of several threads; else one after the other. A failed answer aborts the pipeline. Rows carry
    their parent's step, class, text and place.
    """
    config, began, tell = from_settings(pipeline.config, config), time.time(), Progress(on_event)
    steps = {s.id: s for s in pipeline.steps}
    done: dict[str, DataFrame] = {}

    def run(name: str) -> DataFrame:
        s = steps[name]
        tell.emit("step_started", step=name)
        inputs = _items(docs, s, done, id_col)
        r = extract(inputs.select("key", "text"), Spec(s.prompt, s.examples), config, id_col="key", on_event=on_event)
        failed = r.responses.filter("not success").select("error").limit(1).collect()
        if failed:
            tell.emit("failed", step=name, error=failed[0][0])
            raise PipelineError(f"Step {name}: {failed[0][0]}")
        carried = inputs.select(F.col("key").alias("_key"), F.col("doc_id").alias("_doc"), "item", F.col("text").alias("item_text"), *LINEAGE)
        x = r.extractions.join(carried, F.col("doc_id") == F.col("_key")).drop("doc_id", "_key").withColumnRenamed("_doc", "doc_id")
        x = materialised(lifted(x).withColumn("step_id", F.lit(name)).drop("item_text"), "step")
        tell.emit("step_finished", step=name)
        return x

    for wave in pipeline.waves():
        if pipeline.parallel and len(wave) > 1:
            with ThreadPoolExecutor(len(wave)) as pool:
                got = list(pool.map(inheritable_thread_target(docs.sparkSession)(run), wave))
        else:
            got = [run(name) for name in wave]
        done |= dict(zip(wave, got, strict=True))
    return PipelineResult(pipeline, done, int((time.time() - began) * 1000))


def nested_output(result: PipelineResult, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, output): JSON {step: {extractions: [...], count}} of each document, steps by their output_field or id."""
    field_of = {s.id: s.output_field or s.id for s in result.pipeline.steps}
    rows = result.rows().withColumn("_at", F.struct("item", "chunk_id", "ordinal"))
    item = F.struct("_at", F.struct(F.col("extraction_class").alias("class"), F.col("extraction_text").alias("text"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).alias("x"))
    g = rows.groupBy(id_col, "step_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    g = g.select(id_col, "step_id", F.struct(F.transform("_l", lambda i: i["x"]).alias("extractions"), F.size("_l").alias("count")).alias("v"))
    names = F.create_map(*(F.lit(v) for i, f in field_of.items() for v in (i, f)))
    g = g.withColumn("step", names[F.col("step_id")])
    return g.groupBy(id_col).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "v")), lambda a, b: F.when(a["step"] < b["step"], -1).when(a["step"] > b["step"], 1).otherwise(0)))).alias("output"))
