"""Addresses as a Spark data source: spark.read.format("quarry_addresses").option("urls", "one\\nanother").load()."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quarry.schema import InvalidInputError
from quarry.sources.readers import download


@dataclass
class Addresses(InputPartition):
    first: int
    urls: tuple[str, ...]


class AddressSource(DataSource):
    """Options: urls (one on each line), per_task (addresses that one task fetches, 16), timeout (seconds, 60)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_addresses"

    def schema(self) -> str:
        return "place bigint, url string, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return AddressReader(self.options)


class AddressReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in (line.strip() for line in options.get("urls", "").splitlines()) if u]
        self.per_task, self.timeout = int(options.get("per_task", "16")), float(options.get("timeout", "60"))

    def partitions(self) -> list[InputPartition]:
        return [Addresses(k, tuple(self.urls[k : k + self.per_task])) for k in range(0, len(self.urls), self.per_task)] or [Addresses(0, ())]

    def read(self, partition: Addresses) -> Iterator[tuple]:
        """A row for each address; what could not be fetched has an error instead of a text."""
        for i, u in enumerate(partition.urls, partition.first):
            try:
                yield i, u, download(u, self.timeout), None
            except (InvalidInputError, OSError, ValueError) as e:
                yield i, u, None, str(e)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AddressSource)
