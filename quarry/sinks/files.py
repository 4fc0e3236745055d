"""A file for each document as a Spark data source, written by executors and put in place by a commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.schema import ExportError

STAGED = "_staged-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (hdfs://, s3://, gs://, file://) or of a plain path, which all machines must share."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FileSink(DataSource):
    """Rows (name, report) to path/part-.../name + suffix. Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "quarry_files"

    def schema(self) -> str:
        return "name string, report string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ExportError("The path to write to is missing")
        return FileWriter(self.options["path"].rstrip("/"), self.options.get("suffix", ""), overwrite)


class FileWriter(DataSourceWriter):
    """Each task writes into a staged folder of its own; the commit renames the folders, one step for each task, and an abort deletes
    them. A task that fails deletes its own, and one that is tried again starts a new one, so nothing is left twice. A task that
    outlives its aborted job may leave a staged folder, but never a file in place."""

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, uuid.uuid4().hex[:12]

    @property
    def staged(self) -> str:
        return f"{self.path}/{STAGED}{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = opened(self.staged)
        folder = f"part-{uuid.uuid4().hex}"
        seen: dict[str, int] = {}
        try:
            store.create_dir(f"{root}/{folder}", recursive=True)
            for name, report in iterator:
                name = quote(name if name is not None else "none", safe="")[:200]
                seen[name] = seen.get(name, 0) + 1
                again = f"-{seen[name]}" if seen[name] > 1 else ""  # repeated ids
                with store.open_output_stream(f"{root}/{folder}/{name}{again}{self.suffix}") as f:
                    f.write((report or "").encode())
        except BaseException:
            store.delete_dir(f"{root}/{folder}")
            raise
        return Written(folder, sum(seen.values()))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        staged = f"{root}/{STAGED}{self.job}"
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    store.delete_dir(old.path)
        for m in messages:
            if m and m.files:
                store.move(f"{staged}/{m.folder}", f"{root}/{m.folder}")
        self._clear(store, staged)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        self._clear(store, f"{root}/{STAGED}{self.job}")

    @staticmethod
    def _clear(store: fs.FileSystem, staged: str) -> None:
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)


def write_files(reports: DataFrame, path: str, suffix: str = "", id_col: str = "doc_id", mode: str = "append") -> None:
    """Each row's report as a file named by its id."""
    register(reports.sparkSession)
    x = reports.select(F.col(id_col).cast("string").alias("name"), F.col("report").cast("string").alias("report"))
    x.write.format("quarry_files").mode(mode).option("suffix", suffix).save(path)
