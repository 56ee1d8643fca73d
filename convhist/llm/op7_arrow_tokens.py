"""Token ids in Arrow files of fixed-size lists.

Documents are range-partitioned and sorted by id; each task streams its ids into an Arrow file of record batches with two
columns, `tokens` and `mask`, both fixed-size lists of `seq_len`. All rows have equal length, so row r of a mapped file is
a slice of its buffer at r * seq_len: random access without a copy. The last row is padded and its mask tells. An index
file beside it has doc_id, start and n_tokens of each document, which may span rows and batches.

Files have unique names in the folder; the manifest that Spark writes names those of successful tasks, so a repeated or
speculative task does no harm. Defined cases: null and empty texts hold the end id alone; null ids come first; repeated
rows are separate documents, next to each other; other columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.llm.common import encoded, materialize, text_slices
from convhist.llm.encoders import BareWords, encoder, vocabulary
from convhist.llm.op2_bpe import Codec
from convhist.session import scratch_path

#: Rows of a record batch.
BATCH_ROWS = 256
MANIFEST = "part int, tokens_path string, index_path string, n_ids long, n_docs long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else f"file://{path}")


class Writer:
    """One Arrow file of sequences and its index."""

    def __init__(self, folder: str, seq_len: int, dtype: str):
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        self.paths = f"{folder}/{name}.tokens.arrow", f"{folder}/{name}.docs.arrow"
        self.seq_len, self.dtype = seq_len, np.dtype(dtype)
        self.kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("tokens", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [files.open_output_stream(f"{root}/{name}.{k}.arrow") for k in ("tokens", "docs")]
        self.tokens, self.index = (pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, self.index_schema), strict=True))
        self.rest, self.n_ids, self.n_docs = np.empty(0, dtype=self.dtype), 0, 0

    def _write(self, ids: np.ndarray, padding: int = 0) -> None:
        values = np.concatenate((ids, np.zeros(padding, dtype=self.dtype)))
        mask = np.ones(len(values), dtype=bool)
        mask[len(values) - padding :] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.seq_len) for v in (values, mask)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents whose ids stand one after the other, and the number of each."""
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.n_ids += len(ids)
        self.n_docs += len(sizes)
        data = np.concatenate((self.rest, ids.astype(self.dtype)))
        size = self.seq_len * BATCH_ROWS
        whole = len(data) // size * size
        for at in range(0, whole, size):
            self._write(data[at : at + size])
        self.rest = data[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest, -len(self.rest) % self.seq_len)
        for x in (self.tokens, self.index, *self.sinks):
            x.close()


class TokenFile:
    """Random access to the ids of a file; rows are views of its buffers."""

    def __init__(self, tokens_path: str, seq_len: int, dtype: str):
        files, path = _filesystem(tokens_path)
        source = pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path)
        self.reader, self.seq_len, self.dtype = pa.ipc.open_file(source), seq_len, dtype
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0, dtype=dtype))

    def _values(self, batch: int) -> np.ndarray:
        if self.held[0] != batch:
            self.held = batch, self.reader.get_batch(batch).column(0).values.to_numpy(zero_copy_only=True)
        return self.held[1]

    def row(self, number: int) -> np.ndarray:
        at = number % BATCH_ROWS * self.seq_len
        return self._values(number // BATCH_ROWS)[at : at + self.seq_len]

    def ids(self, start: int, n: int) -> np.ndarray:
        span = BATCH_ROWS * self.seq_len
        parts = [self._values(k)[max(0, start - k * span) : start + n - k * span] for k in range(start // span, (start + n - 1) // span + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _write(folder: str, path: str, seq_len: int, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        ids_of = encoder(Codec if Codec.reads(path) else BareWords, path, dtype)
        for batch in batches:
            texts, doc_ids = encoded(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in text_slices([len(t) for t in texts]):
                writer = writer or Writer(folder, seq_len, dtype)
                ids, sizes = ids_of.encode(texts[a:b])
                writer.add(doc_ids[a:b], np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)
        if writer:
            writer.close()
            row = (TaskContext.get().partitionId(), *writer.paths, writer.n_ids, writer.n_docs)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "tokens_path", "index_path", "n_ids", "n_docs"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, seq_len: int = 1024, end_id: int = 2, dtype: str = "<u2", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the files and return their manifest, a stored table with one row per file in the order of `part`.

    dtype: `<u2` holds vocabularies of up to 65,536 ids, `<u4` any.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(_write(folder, tokenizer, seq_len, end_id, dtype), MANIFEST))


def _read(seq_len: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens_path, index_path, base in zip(*(batch.column(c).to_pylist() for c in ("tokens_path", "index_path", "base")), strict=True):
                files, path = _filesystem(index_path)
                tokens = TokenFile(tokens_path, seq_len, dtype)
                with files.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        ids = [tokens.ids(s, n).astype("<u4").tobytes() for s, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                        starts = pa.array(part.column(1).to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(2), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read_token_files(spark: SparkSession, manifest: DataFrame, seq_len: int = 1024, dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: its place among the ids of all files and its ids, unsigned 32-bit."""
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # one small row per file
        rows.append((r["tokens_path"], r["index_path"], base))
        base += r["n_ids"]
    files = spark.createDataFrame(rows, "tokens_path string, index_path string, base long")
    return files.mapInArrow(_read(seq_len, dtype), "doc_id long, start long, n_tokens long, ids binary")


def op7_arrow_tokens(spark, sf_dir: str) -> DataFrame:
    """Write all documents and read them back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, scratch_path(spark, "tokens"), vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
