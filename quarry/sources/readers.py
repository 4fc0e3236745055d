"""Sources: texts from files, addresses and literals; examples; exported results. Files are read by Spark, so any store it knows will do."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schema import Example, Extraction, InvalidInputError, document_id
from quarry.sources.models import parse_env

ANNOTATED = (
    "document_id string, text string, extractions array<struct<extraction_class:string,extraction_text:string,char_interval:struct<start_pos:bigint,end_pos:bigint,start_char:bigint,end_char:bigint,alignment_status:string>,"
    "alignment_status:string,extraction_index:bigint,group_index:bigint,description:string,attributes:map<string,string>>>"
)


def is_url(text: str) -> bool:
    return text.startswith(("http://", "https://"))


def download(url: str, timeout: float = 60.0) -> str:
    if not is_url(url):
        raise InvalidInputError(f"Not a URL: {url}")
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def literal(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string").select(document_id(F.col("text")).alias("doc_id"), "text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path): one row for each file."""
    d = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    return d.select(document_id(F.concat("path", "text")).alias("doc_id"), "text", "path")


def read_text(spark: SparkSession, path: str) -> str:
    """One small file, for configuration."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise InvalidInputError(f"{path} is not one file")
    return rows[0][0]


def urls(df: DataFrame, url_col: str = "url", timeout: float = 60.0) -> DataFrame:
    """df with the columns text and error: each address fetched from an executor; bodies stay as they are."""
    place = df.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for u in b.column(place).to_pylist():
                try:
                    texts.append(download(u or "", timeout))
                    errors.append(None)
                except (InvalidInputError, OSError, ValueError) as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "text", "error"])

    return df.mapInArrow(run, df.withColumn("text", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, of any store that Spark knows, names a file or folder; what is no path (or of an unknown store) does not."""
    if not path.strip() or "\n" in path or len(path) > 4096:
        return False
    jvm = spark._jvm
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    except (Py4JJavaError, PySparkException):
        return False


def resolve(spark: SparkSession, given: str) -> DataFrame:
    """An address, else an existing path of any store that Spark reads, else the text itself."""
    if is_url(given):
        return literal(spark, download(given))
    return text_files(spark, given).select("doc_id", "text") if exists(spark, given) else literal(spark, given)


def parse_examples(text: str, yaml: bool = False) -> list[Example]:
    if yaml:
        import yaml as y

        data = y.safe_load(text)
    else:
        data = json.loads(text)
    return [Example(x["text"], tuple(Extraction(e["extraction_class"], e["extraction_text"], e.get("description"), e.get("attributes") or {}) for e in x.get("extractions", []))) for x in data]


def load_examples(spark: SparkSession, path: str) -> list[Example]:
    return parse_examples(read_text(spark, path), path.endswith((".yaml", ".yml")))


def default_examples() -> list[Example]:
    return [
        Example("Maria Lind is 41 years old and works as a surveyor", (Extraction("person", "Maria Lind"), Extraction("age", "41"), Extraction("profession", "surveyor"))),
        Example("Dr. Omar Haddad, 52, is a geologist at Northfield Institute", (Extraction("person", "Dr. Omar Haddad"), Extraction("age", "52"), Extraction("profession", "geologist"), Extraction("workplace", "Northfield Institute"))),
    ]


def annotated(spark: SparkSession, path: str) -> DataFrame:
    """Exported documents read back: (document_id, text, extractions)."""
    return spark.read.schema(ANNOTATED).json(path, multiLine=True)


def annotated_rows(docs: DataFrame) -> DataFrame:
    """annotated() as one row for each extraction, in order; intervals as start_pos and end_pos, or as json_document() writes them."""
    x = docs.select(F.col("document_id").alias("doc_id"), F.posexplode("extractions").alias("ordinal", "e"))
    return x.select("doc_id", "ordinal", "e.extraction_class", "e.extraction_text", F.coalesce("e.char_interval.start_pos", "e.char_interval.start_char").alias("start_pos"), F.coalesce("e.char_interval.end_pos", "e.char_interval.end_char").alias("end_pos"), F.nullif(F.coalesce("e.alignment_status", "e.char_interval.alignment_status"), F.lit("None")).alias("alignment_status"), "e.group_index", "e.description", "e.attributes")


def load_env(spark: SparkSession, path: str) -> dict[str, str]:
    """Sets variables of an .env file that are not set yet, and returns all of the file's."""
    found = parse_env(read_text(spark, path).splitlines())
    for k, v in found.items():
        os.environ.setdefault(k, v)
    return found
