"""Inference over a DataFrame of prompts: a sliding window of open requests, failures in rows, and answers that outlive a run."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.schema import InferenceError
from quarry.sources.models import InferenceConfig, Model

ANSWER = "response string, score double, success boolean, error string, latency_ms bigint, retries int"
#: Prompts that are in work or wait for one before them, for each worker.
AHEAD = 4
_KINDS = (pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.int64(), pa.int32())


def _asked(model: Model, config: InferenceConfig, prompt: str | None) -> tuple:
    """One prompt's answer, whatever becomes of it."""
    began = time.monotonic()
    ms = lambda: int((time.monotonic() - began) * 1000)
    if prompt is None:
        return None, None, False, "No prompt", 0, 0
    try:
        got, retries = model.ask(prompt, config) if hasattr(model, "ask") else (model.infer([prompt], config)[0], 0)
    except InferenceError as e:
        return None, None, False, str(e), ms(), e.retries
    return (got[0].output, got[0].score, True, None, ms(), retries) if got else (None, None, False, "No output", ms(), retries)


class _Now:
    """A finished call, for models that one thread asks."""

    def __init__(self, call):
        self.result = lambda: call


def infer(prompts: DataFrame, model: Model, config: InferenceConfig = InferenceConfig(), batch: int = 16, partitions: int | None = None, keys: tuple[str, ...] = ("doc_id", "chunk_id"), drop: tuple[str, ...] = ()) -> DataFrame:
    """prompts with response, score, success, error, latency_ms, retries; the first candidate counts.

    A model with `workers` has so many requests open in a task at once, each prompt asked once: a slow answer, or a wait before a
    retry, holds up one worker alone. Rows leave in their order, `batch` at a time, and no more than AHEAD prompts for each worker are
    taken up before the first of them has left, so memory is bounded. Other models are asked one prompt after another.

    Columns in drop are not handed on. partitions deals rows out by keys first, so that long documents do not sit in one task (an explicit number is not merged by
    adaptive execution). The result depends on an outside service: materialise it (`materialised`) before using it twice.
    """
    df = prompts.repartition(partitions, *(k for k in keys if k in prompts.columns)) if partitions else prompts
    added, kept = StructType.fromDDL(ANSWER), [c for c in df.columns if c not in drop]
    one, workers = partial(_asked, model, config), getattr(model, "workers", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: deque[tuple[pa.RecordBatch, list[Future | _Now]]] = deque()

        def finished(part: pa.RecordBatch, calls: list[Future | _Now]) -> pa.RecordBatch:
            cols = zip(*(c.result() for c in calls), strict=True)
            return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))], [*part.schema.names, *added.names])

        with ThreadPoolExecutor(max(1, workers)) as pool:
            many = 0
            for b in batches:
                for lo in range(0, b.num_rows, batch):
                    part = b.slice(lo, batch)
                    texts = part.column("prompt").to_pylist()
                    open_.append((part.select(kept), [pool.submit(one, t) for t in texts] if workers > 1 else [_Now(one(t)) for t in texts]))
                    many += len(texts)
                    while open_ and (workers == 1 or many > AHEAD * workers):
                        part, calls = open_.popleft()
                        many -= len(calls)
                        yield finished(part, calls)
            while open_:
                yield finished(*open_.popleft())

    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + list(added)))


def with_keys(prompts: DataFrame, tag: str = "") -> DataFrame:
    """prompts with prompt_key, under which answers can be stored and replayed; tag names what else an answer depends on."""
    return prompts.withColumn("prompt_key", F.sha2(F.concat(F.lit(f"{tag}\n"), "prompt") if tag else F.col("prompt"), 256))


def replayed(prompts: DataFrame, stored: DataFrame, model: Model, config: InferenceConfig = InferenceConfig(), **more) -> DataFrame:
    """Answers from `stored` (prompt_key, response) where they are, else from the model."""
    p = with_keys(prompts)
    s = stored.select("prompt_key", F.col("response").alias("_r")).dropDuplicates(["prompt_key"])
    both = p.join(s, "prompt_key", "left")
    had = {"response": F.col("_r"), "score": F.lit(None), "success": F.lit(True), "error": F.lit(None), "latency_ms": F.lit(0), "retries": F.lit(0)}
    old = both.filter(F.col("_r").isNotNull()).select(*p.columns, *(had[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ANSWER)))
    new = infer(both.filter(F.col("_r").isNull()).drop("_r").select(*p.columns), model, config, **more)
    return old.unionByName(new)


def resumed(prompts: DataFrame, model: Model, folder: str, config: InferenceConfig = InferenceConfig(), tag: str = "", batch: int = 16, per_task: int = 256) -> DataFrame:
    """prompts with the columns of infer(), by way of a table of answers in `folder` (a path of any of Spark's file systems).

    Equal prompts are asked once. Answers are written as tasks of per_task prompts end, and stay whatever becomes of the job: a task
    that ends moves its file into the folder itself. A later run asks only for prompts without a successful answer; those that
    failed are asked again. tag (the model's name and settings) is part of the key. Null prompts are failures, and are not asked.
    """
    spark = prompts.sparkSession
    schema = StructType.fromDDL(f"prompt_key string, {ANSWER}")
    p = with_keys(prompts, tag)

    def stored() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(folder)
        except AnalysisException:  # no such folder yet
            return spark.createDataFrame([], schema)

    wanted = p.filter(F.col("prompt").isNotNull()).groupBy("prompt_key").agg(F.min("prompt").alias("prompt"))
    missing = wanted.join(stored().filter("success").select("prompt_key"), "prompt_key", "left_anti")
    n = missing.count()
    if n:
        dealt = missing.repartition(-(-n // per_task), "prompt_key")
        new = infer(dealt, model, config, batch).drop("prompt")
        new.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    names = [f.name for f in StructType.fromDDL(ANSWER)]
    best = stored().groupBy("prompt_key").agg(F.min_by(F.struct(*names), F.struct(~F.col("success"), F.col("error"), F.col("response"))).alias("_a"))
    out = p.join(best, "prompt_key", "left").withColumns({n: F.col(f"_a.{n}") for n in names}).drop("_a", "prompt_key")
    none = F.col("prompt").isNull()
    return out.withColumns({"success": F.coalesce("success", F.lit(False)), "error": F.when(none, F.lit("No prompt")).otherwise(F.col("error")), "latency_ms": F.coalesce("latency_ms", F.lit(0).cast("long")), "retries": F.coalesce("retries", F.lit(0))})
