"""Command line: python -m quarry COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import ExtractConfig, MultiPassConfig
from quarry.operators.aggregate import class_counts
from quarry.operators.chunks import ChunkConfig
from quarry.plans import pipeline as pipelines
from quarry.plans.engine import Spec, extract
from quarry.schema import ConfigurationError, InferenceError, QuarryError
from quarry.sinks.export import FORMATS, ExportConfig, flattened, reports
from quarry.sinks.files import write_files
from quarry.sources.models import HttpModel, InferenceConfig, Model, ProviderConfig, RuleModel, make_model
from quarry.sources.readers import annotated, annotated_rows, default_examples, load_env, load_examples, resolve

PROVIDERS = {
    "openai": "chat completions; OPENAI_API_KEY",
    "ollama": "a local server, http://localhost:11434 unless given",
    "custom": "any server of the chat-completions protocol; needs --base-url",
    "rules": "patterns instead of a model: --rule class=regex, as often as needed",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quarry")
    sub = p.add_subparsers(dest="command", required=True)

    def model_options(c: argparse.ArgumentParser) -> None:
        c.add_argument("--provider", choices=PROVIDERS, default="openai")
        c.add_argument("--model", default="")
        c.add_argument("--base-url")
        c.add_argument("--api-key")
        c.add_argument("--env")
        c.add_argument("--rule", action="append", default=[], metavar="CLASS=REGEX")
        c.add_argument("--temperature", type=float, default=0.3)
        c.add_argument("--max-tokens", type=int)
        c.add_argument("--max-chars", type=int, default=8000)
        c.add_argument("--workers", type=int, default=6)
        c.add_argument("--batch", type=int, default=16)
        c.add_argument("--passes", type=int, default=1)

    def output_options(c: argparse.ArgumentParser, default: str = "text") -> None:
        c.add_argument("--output")
        c.add_argument("--files", action="store_true", help="a file for each document under --output")
        c.add_argument("--export", choices=FORMATS, default=default)
        c.add_argument("--title")
        c.add_argument("--no-intervals", action="store_true")

    c = sub.add_parser("extract", help="values from a text, a file or an address")
    c.add_argument("input")
    c.add_argument("--prompt", required=True)
    c.add_argument("--examples")
    c.add_argument("--format", choices=("json", "yaml"), default="json")
    c.add_argument("--context")
    model_options(c)
    output_options(c)
    c = sub.add_parser("init", help="example files to start from")
    c.add_argument("--folder", default=".")
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("test", help="ask the provider once")
    model_options(c)
    sub.add_parser("providers", help="what can be asked")
    sub.add_parser("examples", help="the built-in examples")
    c = sub.add_parser("convert", help="an exported JSON document in another format")
    c.add_argument("input")
    output_options(c, "html")
    c = sub.add_parser("pipeline", help="run the steps of a YAML file")
    c.add_argument("file")
    c.add_argument("input", nargs="?")
    c.add_argument("--sample", action="store_true", help="write a sample to FILE instead")
    c.add_argument("--flatten", action="store_true")
    c.add_argument("--expand-json", action="store_true")
    model_options(c)
    output_options(c, "json")
    return p


def model_of(a: argparse.Namespace) -> Model | ProviderConfig:
    key = a.api_key or os.environ.get("OPENAI_API_KEY")
    if a.provider == "rules":
        return RuleModel(dict(r.split("=", 1) for r in a.rule))
    if a.provider == "ollama":
        return ProviderConfig.ollama(a.model, a.base_url or "http://localhost:11434")
    if a.provider == "custom":
        return ProviderConfig("custom", a.model, a.base_url or "", key)
    return ProviderConfig.openai(a.model, key, a.base_url or "https://api.openai.com/v1")


def config_of(a: argparse.Namespace) -> ExtractConfig:
    return ExtractConfig(
        model_of(a), getattr(a, "format", "json"), a.max_chars, None, a.batch, a.workers, getattr(a, "context", None), inference=InferenceConfig(a.temperature, a.max_tokens),
        chunking=ChunkConfig(max_size=max(1, a.max_chars), overlap=0), multipass=MultiPassConfig(a.passes) if a.passes > 1 else None,
    )


def put(a: argparse.Namespace, df: DataFrame, column: str) -> None:
    """To a folder by Spark, one file for each partition, or with --files for each document; else to the terminal."""
    if a.output and a.files:
        if "doc_id" not in df.columns:
            raise ConfigurationError("--files needs reports of documents")
        write_files(df.select("doc_id", F.col(column).alias("report")), a.output, f".{a.export}")
        print(f"written to {a.output}")
    elif a.output:
        df.select(column).write.text(a.output)
        print(f"written to {a.output}")
    else:
        for r in df.select(column).toLocalIterator():
            print(r[0])


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "providers":
        print("\n".join(f"{k}: {v}" for k, v in PROVIDERS.items()))
        return 0
    if a.command == "examples":
        print(json.dumps([{"text": x.text, "extractions": [{"extraction_class": e.extraction_class, "extraction_text": e.extraction_text} for e in x.extractions]} for x in default_examples()], indent=2))
        return 0
    if a.command == "init":
        return init(Path(a.folder), a.force)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    try:
        if getattr(a, "env", None):
            load_env(spark, a.env)
        return {"extract": run_extract, "test": run_test, "convert": run_convert, "pipeline": run_pipeline}[a.command](spark, a)
    except QuarryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def init(folder: Path, force: bool) -> int:
    folder.mkdir(parents=True, exist_ok=True)
    said = json.dumps([{"text": x.text, "extractions": [{"extraction_class": e.extraction_class, "extraction_text": e.extraction_text} for e in x.extractions]} for x in default_examples()], indent=2)
    for name, text in (("examples.json", said), (".env.example", "OPENAI_API_KEY=\n"), ("pipeline.yaml", pipelines.dump(pipelines.sample()))):
        if (p := folder / name).exists() and not force:
            print(f"{p} is there already; --force overwrites it", file=sys.stderr)
            return 1
        p.write_text(text)
        print(f"wrote {p}")
    return 0


def run_extract(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = resolve(spark, a.input)
    examples = load_examples(spark, a.examples) if a.examples else default_examples()
    r = extract(docs, Spec(a.prompt, tuple(examples)), config_of(a))
    failed = r.responses.filter("not success").select("error").limit(1).collect()
    if failed:
        print(f"warning: some chunks failed: {failed[0][0]}", file=sys.stderr)
    put(a, reports(docs, r.extractions, ExportConfig(a.export, not a.no_intervals, title=a.title)), "report")
    return 0


def run_test(spark: SparkSession, a: argparse.Namespace) -> int:
    model = make_model(model_of(a))
    model = HttpModel(model.config, attempts=1) if isinstance(model, HttpModel) else model
    try:
        print(model.infer(['Answer with {"ok": true}'], InferenceConfig(0.0, 20))[0][0].text)
        return 0
    except InferenceError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run_convert(spark: SparkSession, a: argparse.Namespace) -> int:
    d = annotated(spark, a.input).withColumn("document_id", F.coalesce("document_id", F.lit("document")))
    put(a, reports(d.select(F.col("document_id").alias("doc_id"), "text"), annotated_rows(d), ExportConfig(a.export, not a.no_intervals, title=a.title)), "report")
    return 0


def run_pipeline(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.sample:
        Path(a.file).write_text(pipelines.dump(pipelines.sample()))
        print(f"wrote {a.file}")
        return 0
    p, docs = pipelines.load(spark, a.file), resolve(spark, a.input or "")
    r = pipelines.execute(docs, p, config_of(a))
    if a.flatten:
        put(a, flattened(r.rows(), docs, r.names, r.took_ms, a.expand_json), "json")
    elif a.export == "html":
        put(a, reports(docs, r.rows(), ExportConfig("html", title=a.title or p.name), layers=True, expanded=a.expand_json), "report")
    else:
        put(a, pipelines.nested_output(r), "output")
    for x in class_counts(r.rows(), "step_id").orderBy("step_id", "extraction_class").collect():
        print(f"{x['step_id']} {x['extraction_class']}: {x['n']}", file=sys.stderr)
    return 0
