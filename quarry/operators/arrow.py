"""Row-by-row scans over Arrow batches that keep the other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

ROWS = 512
#: Bytes of a slice of a batch, which what is made of it in Python stays in proportion to; a longer row is a slice of its own.
SLICE = 1 << 20


def slices(b: pa.RecordBatch, rows: int = ROWS, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in halves of halves until each has at most so many rows and bytes."""
    if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > size):
        half = b.num_rows // 2
        yield from slices(b.slice(0, half), rows, size)
        yield from slices(b.slice(half), rows, size)
    elif b.num_rows:
        yield b


def explode_rows(df: DataFrame, inputs: list[str], make: Callable[..., list[tuple]], schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """For each row of df one output row per tuple of make(*inputs): df's columns (but `drop`), then the columns of `schema`.

    A narrow transformation. Rows for which make gives nothing disappear. Output batches stay small whatever one input
    row gives, but for what one row alone gives.
    """
    kept = [c for c in df.columns if c not in drop]
    added = StructType.fromDDL(schema)
    clash = set(kept) & set(added.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                made = [make(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                take = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
                cols = list(zip(*(x for m in made for x in m), strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*kept, *added.names])

    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + list(added)))
