"""Harmonic packing of token ids into sequences of fixed capacity.

A document of n ids (with an end id), n below the capacity C, belongs whole to the class k = C // n: lengths in
(C/(k+1), C/k]. A bin of class k takes k documents, no more and no fewer, so every worker fills its own bins without looking at
others, with at most k - 1 documents of a class waiting. The room that the k documents leave is filled with cut ids:
the rests of documents longer than C, whose full sequences are bins of their own, and else the next documents that come.
So there is no padding, and one bin at most waits for ids to be cut. What waits when a partition ends is laid end to
end: cut at the capacity, and its rest at powers of two, which need no padding.

Defined cases: null and empty texts are one piece with the end id alone; rows with null or repeated ids are packed each on
its own; other columns are ignored. Nothing is shuffled; a lost task packs its split again with the same result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm.common import encoded, text_slices
from convhist.llm.encoders import SpacedWords, encoder, vocabulary

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Bits of a sequence id below the number of the partition.
LOCAL_BITS = 36


class Bins:
    """The open bins of one worker: documents that wait by class, one bin that waits for cut ids, and ids to be cut."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.counted: list[tuple] = []
        self.room = 0
        self.loose: deque[tuple] = deque()
        self.loose_size = 0

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        offset, rows = 0, []
        for p in pieces:
            rows.append((*p, self.next_id, offset))
            offset += p[2]
        self.next_id += 1
        return rows

    def _loosen(self, piece: tuple) -> None:
        self.loose.append(piece)
        self.loose_size += piece[2]

    def _cut(self, room: int) -> list[tuple]:
        """Pieces of exactly `room` ids, which there must be."""
        self.loose_size -= room
        taken = []
        while room:
            doc_id, start, length, ids, total = self.loose.popleft()
            if length > room:
                width = len(ids) // length
                self.loose.appendleft((doc_id, start + room, length - room, ids[room * width :], total))
                length, ids = room, ids[: room * width]
            taken.append((doc_id, start, length, ids, total))
            room -= length
        return taken

    def add(self, doc_id: int | None, ids: bytes, total: int) -> list[tuple]:
        """The pieces of the bins that a document of `total` ids completes."""
        rows, at, width = [], 0, len(ids) // total
        while total - at >= self.capacity:
            rows += self._close([(doc_id, at, self.capacity, ids[at * width : (at + self.capacity) * width], total)])
            at += self.capacity
        if at == total:
            return rows
        piece = (doc_id, at, total - at, ids[at * width :], total)
        if at or self.counted:
            self._loosen(piece)
        else:
            k = self.capacity // total
            waiting = self.open.setdefault(k, [])
            waiting.append(piece)
            if len(waiting) == k:
                self.counted, self.room = self.open.pop(k), self.capacity - sum(p[2] for p in waiting)
        if self.counted and self.loose_size >= self.room:
            rows += self._close(self.counted + self._cut(self.room))
            self.counted = []
        if self.loose_size >= 2 * self.capacity:
            rows += self._close(self._cut(self.capacity))
        return rows

    def finish(self) -> list[tuple]:
        """Lay what waits end to end: full sequences, then powers of two."""
        for piece in self.counted + [p for k in sorted(self.open) for p in self.open[k]]:
            self._loosen(piece)
        self.open, self.counted, rows = {}, [], []
        while left := self.loose_size:
            rows += self._close(self._cut(self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)))
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _pack(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId() << LOCAL_BITS)
        ids_of = encoder(SpacedWords, path, "<u4")
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts, doc_ids = encoded(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in text_slices([len(t) for t in texts]):
                rows = []
                flat, sizes = ids_of.encode(texts[a:b])
                data, stops = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
                for doc_id, x, y in zip(doc_ids[a:b], [0, *stops], stops, strict=False):
                    rows += bins.add(doc_id, data[x:y] + end, (y - x) // 4 + 1)
                if rows:
                    yield _batch(rows)
        ids_of.table.clear()  # the worker may go on with other work that needs its memory
        if rows := bins.finish():
            yield _batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_pack(tokenizer, capacity, end_id), PIECE)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids): the packed sequences themselves; a sequence is bounded by the capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), whole.alias("ids"))


def op5_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
