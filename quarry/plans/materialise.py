"""Written tables where a plan must not be computed twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that setting is absent (tests on one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and neither later uses nor lost executors recompute it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables that materialised() has left, but those in keep; only when no DataFrame on them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in _WRITTEN if p not in keep]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _WRITTEN.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Within, tables are written as ever; at the end those written within are deleted, but the paths put in the yielded list."""
    before, keep = tuple(_WRITTEN), []
    try:
        yield keep
    finally:
        release(spark, (*before, *keep))


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """make() as a written table, without the tables that it needed on the way."""
    with scratch(spark) as keep:
        out = materialised(make(), name)
        keep.append(_WRITTEN[-1])
    return out
