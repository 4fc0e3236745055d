"""SQL names for the scalar kernels and two table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.content import strict_json
from quarry.operators import align, chunks, responses, tokens

_SPAN = "array<struct<start_pos:bigint,end_pos:bigint>>"


def register(spark: SparkSession) -> list[str]:
    """Makes quarry_* functions known to SQL and returns their names. Scalars take Arrow batches."""

    @F.arrow_udf("array<struct<token_text:string,token_type:string,start_pos:bigint,end_pos:bigint>>")
    def tokenize(text: pa.Array) -> pa.Array:
        return tokens.listed(text)

    @F.pandas_udf(_SPAN)
    def chunk_tokens(text: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([[{"start_pos": a, "end_pos": b} for a, b in chunks.spans(t or "", chunks.ChunkConfig(chunks.TOKEN, int(n), 0))] for t, n in zip(text, size, strict=True)])

    @F.pandas_udf("struct<start_pos:bigint,end_pos:bigint>")
    def align_fuzzy(value: pd.Series, text: pd.Series) -> pd.DataFrame:
        hits = [align.fuzzy((v or "").lower(), (t or "").lower()) for v, t in zip(value, text, strict=True)]
        return pd.DataFrame({"start_pos": pd.array([h[0] if h else None for h in hits], "Int64"), "end_pos": pd.array([h[1] if h else None for h in hits], "Int64")})

    @F.arrow_udf("array<struct<ordinal:int,extraction_class:string,extraction_text:string,group_index:int>>")
    def parse_response(text: pa.Array) -> pa.Array:
        one = pa.struct([("ordinal", pa.int32()), ("extraction_class", pa.string()), ("extraction_text", pa.string()), ("group_index", pa.int32())])
        return pa.array([responses.parse_rows(t.as_py(), []) for t in text], pa.list_(one))

    @F.udtf(returnType="chunk_id int, text string, char_offset bigint")
    class Chunk:
        def eval(self, text: str, size: int) -> Iterator[tuple]:
            for i, (a, b) in enumerate(chunks.spans(text or "", chunks.ChunkConfig(chunks.TOKEN, size, 0))):
                yield i, text[a:b], a

    @F.udtf(returnType="path string, leaf string")
    class JsonLeaves:
        def eval(self, text: str) -> Iterator[tuple]:
            try:
                value = strict_json(text or "")
            except ValueError:
                return
            yield from responses.json_leaves(value)

    scalars = {"quarry_tokenize": tokenize, "quarry_chunk_tokens": chunk_tokens, "quarry_align_fuzzy": align_fuzzy, "quarry_parse_response": parse_response}
    for name, f in scalars.items():
        spark.udf.register(name, f)
    for name, f in (("quarry_chunk", Chunk), ("quarry_json_leaves", JsonLeaves)):
        spark.udtf.register(name, f)
    return [*scalars, "quarry_chunk", "quarry_json_leaves"]
