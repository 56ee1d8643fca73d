"""Helpers that several operators of this folder share: batching, document keys, tables between steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.session import materialize

BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, key): the two columns an operator reads and a key of the document.

    The key is a 64-bit hash of id and text. Rows that agree in both are one document and get the same result; rows
    that share only the id stay different documents. A null text is the empty text.
    """
    doc_id = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))


def text_slices(sizes: Sequence[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about `limit` at most; a larger single entry stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(1, dtype=np.int64), memoryview(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return at - at[0], memoryview(data or b"")[at[0] : at[-1]]


def joined(column: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Join ids with a column indexed by id: all bytes in order, and where each document's end (given in ids) falls."""
    at, data = flat(column.take(pa.array(ids)))
    return data, at[ends]


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Start and end (exclusive) of each run of true values, as an array of two columns."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8) if flags.dtype == bool else flags, [0]))))
    return edges.reshape(-1, 2)


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as ascending spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


__all__ = ["BATCH_BYTES", "encoded", "flat", "joined", "keyed", "materialize", "merged", "runs_of", "table", "text_slices"]
