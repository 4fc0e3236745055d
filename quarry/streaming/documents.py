"""The same extraction over a stream of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quarry.config import ExtractConfig
from quarry.operators.align import grounded
from quarry.operators.chunks import chunks
from quarry.operators.infer import infer
from quarry.plans.engine import Spec, extract
from quarry.plans.materialise import scratch
from quarry.plans.prompts import PromptTemplate, prompts
from quarry.sources.models import make_model


def once(stream: DataFrame, id_col: str = "doc_id", time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of repeated documents within the watermark; state for older ids is dropped."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def extract_stream(stream: DataFrame, spec: Spec, config: ExtractConfig, path: str, checkpoint: str, id_col: str = "doc_id") -> DataStreamWriter:
    """A writer that extracts from each micro-batch into `path`/batch=N; a repeated batch overwrites its own folder, so results
    appear exactly once. Start it with .start(), or .trigger(availableNow=True).start() for what is there."""

    def batch(df: DataFrame, number: int) -> None:
        with scratch(df.sparkSession):  # a stream has no end, so what a batch needed on the way goes
            extract(df.select(id_col, "text"), spec, config, id_col).extractions.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def value_stream(stream: DataFrame, spec: Spec, config: ExtractConfig, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_id, ordinal, extraction_class, extraction_text, group_index, start_pos, end_pos, alignment_status): grounded values of
    a stream of documents, narrow all the way, so that each micro-batch is one stage. Null and empty texts and failed answers give
    none. Answers are not kept: a micro-batch that is repeated asks again."""
    plan = replace(config.chunking, strategy="token", max_size=config.max_char_buffer, overlap=0)
    d = stream.select(F.col(id_col).alias("doc_id"), "text").filter(F.length("text") > 0)
    p = prompts(chunks(d, plan, id_col="doc_id"), PromptTemplate(spec.description, spec.examples, config.format))
    answers = infer(p.select("doc_id", "chunk_id", "text", "char_offset", "prompt"), make_model(config.model, config.format, config.workers), config.inference, config.batch).filter("success")
    x = grounded(answers, spec.fields, config.format == "yaml", config.unwrap, config=config.alignment)
    return x.select("doc_id", "chunk_id", "ordinal", "extraction_class", "extraction_text", "group_index", "start_pos", "end_pos", "alignment_status")


class Known(StatefulProcessor):
    """Keeps a document's values, by their text without case and outer white space, and lets through each one once."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "text string", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for x in rows:
            x = x.sort_values(["chunk_id", "ordinal"], kind="stable")
            keep = []
            for t in x["extraction_text"]:
                name = (t.strip().lower(),)
                keep.append(not self.values.containsKey(name))
                if keep[-1]:
                    self.values.updateValue(name, (True,))
            yield x[keep]

    def close(self) -> None:
        pass


def new_values(values: DataFrame, id_col: str = "doc_id", days: float | None = None) -> DataFrame:
    """Of a stream of values those that their document has not given before, in this micro-batch or an earlier one.

    State is partitioned by document and holds one short entry for each value (with `days`, until it was not renewed for so long). It
    lives in RocksDB, which this sets for the session's streaming queries. Values of documents without an id share one state.
    """
    spark = values.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ttl = int(days * 86_400_000) if days else None
    schema = StructType(values.schema.fields)
    return values.filter(F.col("extraction_text").isNotNull()).groupBy(id_col).transformWithStateInPandas(Known(ttl), schema, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")
