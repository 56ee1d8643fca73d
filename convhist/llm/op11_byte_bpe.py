"""Byte-level BPE by one global shuffle of distinct words.

Each task explodes its texts into pre-tokens chunk by chunk: a chunk is whole documents of about CHUNK_BYTES, and leaves
its distinct words, numbered, and the positions, the word number of every pre-token in order. The words are shuffled by a
hash of the word, in bundles of one chunk and one hash bucket, so that every occurrence of a distinct word in the corpus
meets in one task and is encoded once; its ids go back to their chunk, where they join the positions and documents are
put together. Decoding joins the ids with the token-byte table, which has one row per vocabulary entry. The positions go
the same two ways, so nothing is written but two shuffles and each text is split once.

Skew: the hottest word is one entry per chunk, never one per occurrence, and a bucket is read bundle by bundle. Bounds: a
chunk, or one longer document, is what a task holds, besides up to WORDS encoded words. A lost task makes the same chunk
again. Bundles are compressed columns of sorted words.

Character classes are those of the tokenizer library: where Python's pattern module knows newer characters, a stand-in of
the library's class takes their place while a text is split.

Defined cases: null and empty texts have no ids and decode to nothing; whole texts, words of any length; null and repeated
ids play no part, each row is a document; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm.common import encoded, joined, table, text_slices
from convhist.llm.encoders import encoder, vocabulary

#: Text bytes of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 24 << 20
#: Encoded words a worker keeps; beyond it starts again.
WORDS = 1_000_000
#: Ids that are digested at once; a longer document stands alone.
IDS_AT_ONCE = 1 << 20
#: A bundle (bucket, and words or their ids as sizes and data), or, without a bucket, what holds a chunk's documents.
ROWS = "chunk long, bucket int, sizes binary, data binary, doc_ids array<long>, counts array<long>, places binary, positions binary"
_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
_NAMES = [column.split()[0] for column in ROWS.split(", ")]


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table of a rank file: bytes by id."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file) if token}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Splitter:
    """Pre-tokens of texts by a pattern, with the character classes of the tokenizer library."""

    classes = (r"\p{L}", r"\p{N}", r"\s")

    def __init__(self, pattern: str, _: str = ""):
        import regex
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.theirs = [tiktoken.Encoding(c, pat_str=c, mergeable_ranks=single, special_tokens={}) for c in self.classes]
        self.ours = [regex.compile(c) for c in self.classes]
        self.known: set[str] = set(map(chr, range(128)))
        self.stand_ins: dict[int, str] = {}

    def _meet(self, chars: set[str]) -> None:
        for c in chars:
            theirs = [bool(e.encode_ordinary(c)) for e in self.theirs]
            if theirs != [bool(p.match(c)) for p in self.ours]:
                self.stand_ins[ord(c)] = next((x for x, yes in zip("a1 ", theirs, strict=True) if yes), "†")
        self.known |= chars

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text)
        chars = set(text)
        if not chars <= self.known:
            self._meet(chars - self.known)
        if not any(ord(c) in self.stand_ins for c in chars if c > "ɏ"):
            return self.find(text)
        return [text[m.start() : m.end()] for m in self.iterate(text.translate(self.stand_ins))]


class RankEncoder:
    """Ids of single words: no further splitting."""

    def __init__(self, path: str, dtype: str):
        import tiktoken

        self.tokens = token_bytes(path)
        ranks = {t: i for i, t in enumerate(self.tokens) if t}
        self.encode = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.dtype = dtype

        self.known: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> list[bytes]:
        known, out = self.known, []
        if len(known) > WORDS:
            known.clear()
        for w in words:
            found = known.get(w)
            if found is None:
                found = known[w] = np.array(self.encode(w.decode()), dtype=self.dtype).tobytes()
            out.append(found)
        return out


class TokenTable:
    """The token-byte table as Arrow columns: bytes, and decimal ids with a space after each."""

    def __init__(self, path: str, _: str = ""):
        tokens = token_bytes(path)
        self.bytes = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; small numbers leave planes of zeros."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 9)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def bundled(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Byte strings as (sizes, bytes), both compressed."""
    import zstandard

    return packed(np.array([len(x) for x in parts], dtype=np.int64)), zstandard.compress(b"".join(parts), 9)


def opened(sizes: bytes, data: bytes) -> tuple[np.ndarray, bytes]:
    """Where the strings of a bundle start and end, and their bytes."""
    import zstandard

    return np.concatenate(([0], np.cumsum(unpacked(sizes)))), zstandard.decompress(data)


class _Chunk:
    """Documents of one chunk: their distinct words and positions."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, words: list[str], size: int) -> None:
        index = self.index
        self.parts.append(np.array([index.setdefault(w, len(index)) for w in words], dtype=np.uint32))
        self.doc_ids.append(doc_id)
        self.counts.append(len(words))
        self.size += size

    def batches(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        positions = np.concatenate(self.parts)
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(positions, minlength=len(self.index)), kind="stable")
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        words = [w.encode() for w in self.index]
        bucket = np.array([zlib.crc32(w) for w in words], dtype=np.int64) % buckets
        order = pc.sort_indices(pa.table({"bucket": bucket, "word": pa.array(words, pa.binary())}), [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
        places = np.empty(len(order), dtype=np.int64)
        places[number[order]] = np.arange(len(order))
        rows = [(chunk, None, None, None, self.doc_ids, self.counts, packed(places), packed(number[positions]))]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            rows.append((chunk, k, *bundled([words[i] for i in order[edges[k] : edges[k + 1]].tolist()]), None, None, None, None))
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _explode(pattern: str, chunk_bytes: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, chunk = TaskContext.get().partitionId() << 32, 0, _Chunk()
        split = encoder(Splitter, pattern, "").words
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), encoded(batch.column("text"))
            for doc_id, text in zip(doc_ids, texts, strict=True):
                if chunk.doc_ids and chunk.size + len(text) > chunk_bytes:
                    yield from chunk.batches(first + made, buckets)
                    made, chunk = made + 1, _Chunk()
                chunk.add(doc_id, split(text.decode()), len(text))
        if chunk.doc_ids:
            yield from chunk.batches(first + made, buckets)

    return run


def _encode(path: str, dtype: str):
    """Words of bundles become ids; rows of documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(RankEncoder, path, dtype).ids
        for batch in batches:
            sizes, data = [], []
            for size, words in zip(batch.column("sizes").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if size is not None:
                    at, words = opened(size, words)
                    at = at.tolist()
                    size, words = bundled(ids_of([words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]))
                sizes.append(size)
                data.append(words)
            columns = [batch.column(n) if n not in ("sizes", "data") else pa.array(sizes if n == "sizes" else data, pa.binary()) for n in _NAMES]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return run


def _assemble(path: str, dtype: str, digests: bool):
    def run(rows: pa.Table) -> pa.Table:
        tokens = encoder(TokenTable, path, "")
        width = np.dtype(dtype).itemsize
        rows = rows.sort_by("bucket")  # documents have none and come last
        *bundles, whole = rows.select(_NAMES[1:]).to_pylist()
        opened_ = [opened(r["sizes"], r["data"]) for r in bundles]
        size = np.concatenate([np.empty(0, dtype=np.int64), *(np.diff(at) for at, _ in opened_)]) // width
        begin = np.cumsum(size) - size
        values = np.frombuffer(b"".join([data for _, data in opened_]), dtype=dtype)
        positions = unpacked(whole["places"])[unpacked(whole["positions"])]
        doc_ids, counts = whole["doc_ids"], whole["counts"]
        ends = np.concatenate(([0], np.cumsum(counts)))
        n_ids = np.diff(np.concatenate(([0], np.cumsum(size[positions])))[ends])
        out = [_EMPTY[digests]]
        for a, b in text_slices(n_ids.tolist(), IDS_AT_ONCE):
            some = positions[ends[a] : ends[b]]
            sizes = size[some]
            stop = np.cumsum(sizes)
            ids = values[np.repeat(begin[some] - stop + sizes, sizes) + np.arange(sizes.sum())]
            bounds = np.concatenate(([0], np.cumsum(n_ids[a:b])))
            head = [pa.array(doc_ids[a:b], pa.int64()), pa.array(n_ids[a:b])]
            raw, edge = joined(tokens.bytes, ids, bounds)
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            if digests:
                raw_sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in spans]
                text, edge = joined(tokens.decimals, ids, bounds)  # each id with a space after it, the last of a document unread
                ids_sha = [hashlib.sha256(text[x : max(x, y - 1)]).hexdigest() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                columns = [pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())]
            else:
                columns = [pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())), pa.array([bytes(raw[x:y]) for x, y in spans], pa.binary())]
            out.append(pa.table([*head, *columns], schema=_EMPTY[digests].schema))
        return pa.concat_tables(out)

    return run


_EMPTY = {
    True: pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]).empty_table(),
    False: pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]).empty_table(),
}


def _run(docs: DataFrame, ranks: str, pattern: str, text_col: str, id_col: str, chunk_bytes: int, digests: bool, schema: str) -> DataFrame:
    dtype = "<u2" if len(token_bytes(ranks)) <= 1 << 16 else "<u4"
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = slim.mapInArrow(_explode(pattern, chunk_bytes, buckets), ROWS)
    by_word = exploded.repartition(F.coalesce("bucket", F.pmod("chunk", F.lit(buckets))))
    return by_word.mapInArrow(_encode(ranks, dtype), ROWS).groupBy("chunk").applyInArrow(_assemble(ranks, dtype, digests), schema)


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document. ranks: a rank file; pattern: what splits texts into words."""
    return _run(docs, ranks, pattern, text_col, id_col, chunk_bytes, False, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encode` without moving the ids out of the task."""
    return _run(docs, ranks, pattern, text_col, id_col, chunk_bytes, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(TokenTable, path, "")
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            for a, b in text_slices((sizes * 8).tolist()):
                ids = batch.column("ids").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                raw, edge = joined(tokens.bytes, ids, np.concatenate(([0], np.cumsum(sizes[a:b]))))
                raws = [bytes(raw[x:y]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(raws, pa.binary())], names=["doc_id", "decoded"])

    return run


def decode(rows: DataFrame, ranks: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, decoded) of any table of id lists. A null list decodes to nothing; unknown ids raise."""
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return slim.mapInArrow(_decode(ranks), "doc_id long, decoded binary")


def op11_word_shuffle_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all documents."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
