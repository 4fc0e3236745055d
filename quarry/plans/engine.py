"""extract(): documents to grounded extractions, in one or several passes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import ExtractConfig
from quarry.events import Event, Progress, silent
from quarry.operators.aggregate import dedupe_normalized, dedupe_similar, quality_score
from quarry.operators.align import grounded
from quarry.operators.chunks import ChunkConfig, chunks
from quarry.operators.infer import infer, resumed
from quarry.operators.validate import COERCED, check_answers, coerce
from quarry.plans.materialise import materialised
from quarry.plans.prompts import PromptTemplate, prompts, refinement_context
from quarry.schema import ConfigurationError, Example, answer_schema, expected_fields
from quarry.sinks.export import write_raw
from quarry.sources.models import Model, ProviderConfig, make_model

#: Numbers the rows of documents within a run.
KEY = "doc_key"


@dataclass(frozen=True)
class Spec:
    """What to extract: a description and worked examples."""

    description: str
    examples: tuple[Example, ...]

    def __post_init__(self):
        if not self.examples:
            raise ConfigurationError("At least one example is needed")

    @property
    def fields(self) -> list[str]:
        return expected_fields(list(self.examples))


@dataclass
class Result:
    """responses: a row for each asked chunk and pass, with failures; extractions: the grounded values."""

    responses: DataFrame
    extractions: DataFrame


def _template(spec: Spec, c: ExtractConfig) -> PromptTemplate:
    if not isinstance(c.model, ProviderConfig):
        return PromptTemplate.for_provider("custom", spec.description, spec.examples, c.format)
    t = PromptTemplate.for_provider(c.model.provider, spec.description, spec.examples, c.format)
    return replace(t, fenced=c.model.expects_fence(c.format))


def _model(spec: Spec, c: ExtractConfig) -> tuple[Model, dict | None, str]:
    """The model, the schema that its answers are held to, and what an answer depends on besides its prompt."""
    held = isinstance(c.model, ProviderConfig) and c.model.constrained and c.format == "json"
    schema = answer_schema(list(spec.examples)) if held else None
    name = [c.model.provider, c.model.model, c.model.base_url, c.model.extra] if isinstance(c.model, ProviderConfig) else type(c.model).__name__
    return make_model(c.model, c.format, c.workers, schema), schema, json.dumps([name, schema, c.format], sort_keys=True)


def _ask(pieces: DataFrame, spec: Spec, c: ExtractConfig, number: int, context_col: str | None, tell: Progress) -> DataFrame:
    """One pass over chunks: prompts, answers; written, as the model must not be asked twice for one prompt.

    Rows, failures, retries and times are observed while the table is written, so that telling them costs no job.
    """
    tell.emit("pass_started", number=number)
    t = _template(spec, c)
    p = prompts(pieces, t, context_col=context_col).withColumns({"pass_number": F.lit(number), "prompt_chars": F.length("prompt")})
    if c.inference.max_tokens is None:
        inference = replace(c.inference, max_tokens=max(200 * len(spec.fields), 500))
    else:
        inference = c.inference
    if number > 1 and c.multipass:
        inference = replace(inference, temperature=inference.temperature * c.multipass.decay ** (number - 1))
    model, schema, tag = _model(spec, c)
    drop = ("prompt", *([context_col] if context_col else []))
    if c.answers:
        asked = resumed(p, model, c.answers, inference, tag + json.dumps(asdict(inference), sort_keys=True), c.batch)
    else:
        asked = infer(p, model, inference, c.batch, c.partitions, (KEY, "chunk_id"), drop)
    seen = Observation(f"answers-{uuid.uuid4().hex}")
    asked = asked.observe(
        seen, F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("success")).alias("failed"), F.sum("latency_ms").alias("latency_ms"), F.percentile_approx("latency_ms", [0.5, 0.95]).alias("quantiles"),
        F.sum("retries").alias("retries"), F.sum("prompt_chars").alias("prompt_chars"), F.sum(F.length("response")).alias("response_chars"),
    )
    asked = check_answers(asked, schema) if schema else asked.withColumn("invalid", F.lit(None).cast("string"))
    with tell.span(pieces.sparkSession, f"infer, pass {number}", number=number):
        out = materialised(asked.drop(*drop, "prompt_chars"), "responses")
    n = seen.get
    if n["retries"]:
        tell.emit("retried", number=number, retries=n["retries"])
    tell.emit("answered", number=number, chunks=n["chunks"], failed=n["failed"], latency_ms=n["latency_ms"])
    median, slow = n["quantiles"] or (None, None)
    tell.emit("debug", number=number, operator="infer", rows=n["chunks"], latency_ms_median=median, latency_ms_95=slow, prompt_chars=n["prompt_chars"], response_chars=n["response_chars"])
    if c.validation.raw_folder:
        write_raw(out.drop("text", KEY), c.validation.raw_folder, f"{uuid.uuid4().hex}-{number}")
    return out


def _grounded(responses: DataFrame, spec: Spec, c: ExtractConfig) -> DataFrame:
    """Answers to aligned, coerced, scored rows: narrow all the way, as each answer still has its chunk's text beside it."""
    x = grounded(responses.filter("success"), spec.fields, c.format == "yaml", c.unwrap, config=c.alignment)
    x = x.withColumn("coerced", coerce(F.col("extraction_text")) if c.validation.coerce_types else F.lit(None).cast(COERCED))
    x = x.withColumn("quality_score", quality_score(F.col("extraction_text"), F.col("alignment_status")))
    x = x.filter(F.col("quality_score") >= c.validation.quality) if c.validation.quality > 0 else x
    return x.withColumn("extraction_index", F.col("ordinal")).drop("score", "success", "error", "latency_ms", "retries", "invalid")


def _pieces(docs: DataFrame, c: ExtractConfig, id_col: str) -> DataFrame:
    """Chunks of whole sentences, where a text within max_char_buffer is one chunk as it is; documents in one piece are marked.

    KEY numbers the documents' rows, as ids may be null or repeated; it counts from here on, and is written with the answers.
    Key, id and context go through the chunker with their text, so nothing is joined.
    """
    context = F.coalesce("additional_context", F.lit(c.context)) if "additional_context" in docs.columns else F.lit(c.context)
    row = F.struct(F.monotonically_increasing_id().alias(KEY), F.col(id_col).alias("doc_id"), context.cast("string").alias("context"))
    d = docs.select(row.alias("row"), "text")
    fits = F.length("text") <= c.max_char_buffer
    short = d.filter(fits & (F.length("text") > 0)).select("row", F.lit(0).alias("chunk_id"), "text", F.lit(0).cast("long").alias("char_offset"), F.length("text").cast("long").alias("char_length"), F.lit(True).alias("single"))
    plan = replace(c.chunking, strategy="token", max_size=c.max_char_buffer, overlap=0) if not c.multipass else c.chunking
    long = chunks(d.filter(~fits), plan, id_col="row").select("row", "chunk_id", "text", "char_offset", "char_length", F.lit(False).alias("single"))
    return short.unionByName(long).select("row.*", "chunk_id", "text", "char_offset", "char_length", "single")


def extract(docs: DataFrame, spec: Spec, config: ExtractConfig, id_col: str = "doc_id", on_event: Callable[[Event], None] = silent) -> Result:
    """Documents (doc_id, text, perhaps additional_context) to responses and extractions.

    Chunking to scoring is narrow; only the removal of duplicates shuffles, by document. Values of several chunks are
    reduced by similarity in chunk order; a document in one chunk keeps all of its values. With config.multipass see multipass().
    on_event is called on the driver with the run's progress (events.to_log, events.to_console or any function).
    """
    tell = Progress(on_event)
    tell.emit("run_started", fields=spec.fields, multipass=bool(config.multipass))
    if config.multipass:
        return multipass(docs, spec, config, id_col, tell)
    responses = _ask(_pieces(docs, config, id_col), spec, config, 1, "context", tell)
    x = _grounded(responses, spec, config)
    if config.dedupe:
        with tell.span(docs.sparkSession, "similar values"):
            x = x.filter("single").unionByName(dedupe_similar(x.filter("not single"), KEY))
        tell.emit("aggregated")
    tell.emit("run_finished")
    return Result(responses.drop("text", KEY), x.drop("single", KEY))


def multipass(docs: DataFrame, spec: Spec, config: ExtractConfig, id_col: str = "doc_id", tell: Progress | None = None) -> Result:
    """Repeated passes. A later pass asks again about documents in one piece, and about chunks that gave less than
    min_extractions (the first max_reprocess of a document), telling what was found. Each document stops on its own: after a
    pass without a new value. Values below the quality threshold are left out; then one stays of each normalised text.
    """
    m, tell = config.multipass, tell or Progress(silent)
    pieces = materialised(_pieces(docs, config, id_col), "pieces")
    todo, answers, found = pieces, [], None
    for number in range(1, m.passes + 1):
        responses = _ask(todo, spec, config, number, "context", tell)
        answers.append(responses)
        rows = _grounded(responses, spec, config)
        new = rows.filter(F.col("quality_score") >= m.quality)
        if found is not None:
            seen = found.select(F.col(KEY).alias("_d"), F.col("extraction_text").alias("_t")).distinct()
            new = new.join(seen, (F.col(KEY) == F.col("_d")) & (F.col("extraction_text") == F.col("_t")), "left_anti")
        first = Window.partitionBy(KEY, "extraction_text").orderBy("chunk_id", "ordinal")
        kept = Observation(f"pass-{uuid.uuid4().hex}")
        new = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").observe(kept, F.count(F.lit(1)).alias("rows"))
        with tell.span(docs.sparkSession, f"ground, pass {number}", number=number):
            new = materialised(new, "pass")
        found = new if found is None else found.unionByName(new)
        tell.emit("debug", number=number, operator="pass", rows=kept.get["rows"])
        tell.emit("pass_finished", number=number)
        if number == m.passes:
            break
        parts = responses.filter("not single")
        raw = _grounded(parts, spec, config).groupBy(KEY, "chunk_id").agg(F.count(F.lit(1)).alias("_raw"))
        left = parts.select(KEY, "chunk_id").join(raw, [KEY, "chunk_id"], "left").filter(F.coalesce("_raw", F.lit(0)) < m.min_extractions)
        left = left.withColumn("_k", F.row_number().over(Window.partitionBy(KEY).orderBy("chunk_id"))).filter(F.col("_k") <= m.max_reprocess)
        again = pieces.join(new.select(KEY).distinct(), KEY, "left_semi") if not m.retry_empty else pieces
        lasting = again.filter("single").unionByName(again.filter("not single").join(left, [KEY, "chunk_id"], "left_semi") if m.targeted else again.filter("not single"))
        if m.refinement:
            said = refinement_context(found, KEY, config.context or "").withColumnRenamed("context", "_said")
            lasting = lasting.join(said, KEY, "left").withColumn("context", F.coalesce("_said", "context")).drop("_said")
        todo = materialised(lasting, "todo") if config.answers else lasting  # kept answers need the prompts more than once
        if not todo.limit(1).count():
            break
    tell.emit("run_finished")
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    return Result(every.drop("text", KEY), dedupe_normalized(found, KEY).drop("single", KEY))


def extract_text(spark: SparkSession, text: str, spec: Spec, config: ExtractConfig) -> Result:
    """extract() of one text."""
    return extract(spark.createDataFrame([("doc_0", text)], "doc_id string, text string"), spec, config)


__all__ = ["ChunkConfig", "Result", "Spec", "extract", "extract_text", "multipass"]
