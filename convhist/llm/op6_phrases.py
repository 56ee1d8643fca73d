"""Substring dedup on words by repeated-phrase automata.

Words are maximal runs of bytes other than space and tab to carriage return. Anchors (see `grams`) on words find where a
window of `window` words may stand in two documents. Shards of contexts confirm the windows that do, compile them, with
the smallest document of each, into an Aho-Corasick automaton over word numbers, and stream every context of the shard
through it: each occurrence in a later document is removed. All documents are covered, as every place of a recurring
anchor belongs to a context, and equal contexts share the result.

Skew: equal contexts are streamed once. A hash with more than HOT_CLASSES different contexts isn't gathered: its windows
are hashed and their smallest documents found by an aggregation that combines before the shuffle.

Defined cases: null text has no words; texts shorter than a window lose nothing; a repeated row is the same document and
never makes its own words go; rows with a null id are last in order and don't remove from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm import grams
from convhist.llm.common import encoded, keyed, materialize, merged, text_slices
from convhist.llm.op4_suffix import CONTEXT, FLAGGED, by_shards, context_batch, packed_texts, unpacked
from convhist.llm.recurring import ANCHOR, classes, marked_spans, recurring, wanted_places

HOT_CLASSES = 1024
GRAM = 20
_LAST = (1 << 63) - 1


def word_anchors(blobs: list[bytes], windows: grams.Windows):
    """Anchors of a few documents: (document number, word, hash, context hash, words before, words from it on)."""
    flat = np.frombuffer(b" ".join((*blobs, b"")), dtype=np.uint8)  # a space ends each document
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    first, last = edges[::2], edges[1::2]
    if len(first) < windows.length:
        return None
    words = grams.Prefix(grams.BYTE_SYMBOLS[0][flat]).ranges(first, last)
    stops = np.searchsorted(first, np.cumsum([len(b) + 1 for b in blobs]))
    sizes = np.diff(np.concatenate(([0], stops)))
    ends, begins = np.repeat(stops, sizes), np.repeat(stops - sizes, sizes)
    at, hashes = grams.anchors(grams.Prefix(words), ends, windows)
    if not len(at):
        return None
    back, ahead = grams.contexts(at, begins, ends, windows)
    ctx = grams.Prefix(grams.mix(words ^ np.uint64(0x5851F42D4C957F2D)), 1).ranges(at - back, at + ahead) ^ back.astype(np.uint64)
    return np.searchsorted(stops, at, side="right"), at - begins[at], hashes, ctx, back, ahead


def _anchor_rows(windows: grams.Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, ids, keys = encoded(batch.column("text")), batch.column("doc_id").fill_null(_LAST).to_numpy(), batch.column("key").to_numpy()
            keep = [i for i, b in enumerate(blobs) if len(b) >= 2 * windows.length - 1]
            for a, b in text_slices([len(blobs[i]) for i in keep]):
                part = np.array(keep[a:b])
                if (found := word_anchors([blobs[i] for i in part], windows)) is None:
                    continue
                doc, pos, h, ctx, back, ahead = found
                doc = part[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h.view(np.int64), ctx.view(np.int64), ids[doc], keys[doc], pos.astype(np.int32), back.astype(np.int32), ahead.astype(np.int32))],
                    names=["h", "ctx", "ord", "key", "pos", "back", "ahead"],
                )

    return run


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for key, text, places in zip(batch.column("key").to_pylist(), unpacked(batch.column("packed")), batch.column("places").to_pylist(), strict=True):
            words = text.split()
            for p in places:
                rows.append((p["h"], p["ctx"], p["kinds"], p["ord"], key, p["pos"], p["back"], b" ".join(words[p["pos"] - p["back"] : p["pos"] + p["ahead"]])))
                held += len(rows[-1][-1])
            if held > 1 << 20:
                yield context_batch(rows)
                rows, held = [], 0
        if rows:
            yield context_batch(rows)


def shard_flags(rows: list[tuple], window: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Removable window starts, as spans relative to the anchor, of each (h, ctx, ord, key, pos, back, context)."""
    numbers: dict[bytes, int] = {}
    texts = [tuple(numbers.setdefault(w, len(numbers) + 1) for w in row[6].split()) for row in rows]
    least: dict[tuple, int] = {}
    several: set[tuple] = set()
    for row, words in zip(rows, texts, strict=True):
        for i in range(len(words) - window + 1):
            have = least.setdefault(w := words[i : i + window], row[2])
            if have != row[2]:
                several.add(w)
                least[w] = min(have, row[2])
    if not several:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    order = sorted({least[w] for w in several})  # numbers of documents small enough for the automaton
    rank = {d: i for i, d in enumerate(order)}
    for w in several:
        automaton.add_word(w, rank[least[w]])
    automaton.make_automaton()
    out = []
    for row, words in zip(rows, texts, strict=True):
        hits = [end - window + 1 - row[5] for end, r in automaton.iter(words) if order[r] < row[2]]
        if hits:
            out.append((row[0], row[1], merged([(i, i + 1) for i in hits])))
    return out


def _window_rows(window: int):
    """Every window of hot contexts by its hash: the exact way for hashes with too many contexts for one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "ord", "back", "context")), strict=True))
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                texts = [r[4].split() for r in part]
                sizes = [max(0, len(words) - window + 1) for words in texts]
                lanes = [xxhash.xxh3_128_digest(b" ".join(words[j : j + window])) for words, n in zip(texts, sizes, strict=True) for j in range(n)]
                halves = np.frombuffer(b"".join(lanes), dtype="<i8").reshape(-1, 2)
                step = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                each = [np.repeat(np.array([r[c] for r in part], dtype=np.int64), sizes) for c in range(3)]
                back = np.repeat(np.array([r[3] for r in part], dtype=np.int32), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), *each, step - back)],
                    names=["w1", "w2", "h", "ctx", "ord", "rel"],
                )

    return run


def hot_flags(hot: DataFrame, window: int) -> DataFrame:
    rows = materialize(hot.mapInArrow(_window_rows(window), "w1 long, w2 long, h long, ctx long, ord long, rel int"))
    ends = rows.groupBy("w1", "w2").agg(F.min("ord").alias("_min"), F.max("ord").alias("_max")).filter("_min <> _max").select("w1", "w2", "_min")
    hit = rows.join(ends.hint("merge"), ["w1", "w2"]).filter("ord > _min")
    return hit.groupBy("h", "ctx").agg(F.collect_set(F.struct(F.col("rel").alias("a"), (F.col("rel") + 1).alias("b"))).alias("spans"))


def removable_words(docs: DataFrame, packed: DataFrame, window: int = 50) -> DataFrame:
    """(key, spans): for each document the words that go, as unmerged half-open spans. docs: see `keyed`."""
    windows = grams.Windows(window, max(1, min(GRAM, window // 2)))
    found = recurring(docs.mapInArrow(_anchor_rows(windows), ANCHOR), F.col("ord"))
    kinds = classes(found, F.col("ord"))
    texts = materialize(packed.join(wanted_places(kinds).hint("merge"), "key").mapInArrow(_cut_contexts, CONTEXT))
    cool, hot = texts.filter(F.col("kinds") <= HOT_CLASSES), texts.filter(F.col("kinds") > HOT_CLASSES)
    flags = cool.repartition("h").sortWithinPartitions("h").mapInArrow(by_shards(lambda rows: shard_flags(rows, window)), FLAGGED)
    if not hot.isEmpty():
        flags = flags.union(hot_flags(hot, window))
    return marked_spans(found, kinds, flags, F.col("ord") > F.col("first.ord"), window, windows.starts)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, key, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), unpacked(batch.column("packed")), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            gone = merged([(s["a"], s["b"]) for s in spans or ()])
            rest, at = [], 0
            for a, b in gone:
                rest += words[at:a]
                at = b
            rest += words[at:]
            out.append((doc_id, key, len(words), len(words) - len(rest), [{"a": a, "b": b} for a, b in gone], b" ".join(rest)))
        for a, b in text_slices([len(x[5]) for x in out]):
            columns = list(zip(*out[a:b], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "n_words", "n_removed", "spans", "kept"])


def dedup_phrases(docs: DataFrame, window: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, key, n_words, n_removed, spans, kept): documents without passages that a smaller doc_id has.

    A word goes if a window of `window` consecutive words that covers it also starts in a document with a smaller id.
    Windows are judged on the input. kept: the other words, joined by one space, in UTF-8.
    """
    base = keyed(docs, text_col, id_col)
    packed = packed_texts(base)
    spans = removable_words(base, packed, window)
    return packed.join(spans.hint("merge"), "key", "left").mapInArrow(_kept, "doc_id long, key long, n_words long, n_removed long, spans array<struct<a:long,b:long>>, kept binary")


def brute_force(texts: dict[int, bytes], window: int) -> dict[int, list[tuple[int, int]]]:
    """Removed spans of words by a table of all windows; for tests."""
    least: dict[tuple, int] = {}
    words = {d: texts[d].split() for d in texts}
    for d in sorted(texts):
        for i in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][i : i + window]), d)
    return {d: merged([(i, i + window) for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d]) for d, w in words.items()}


def op6_phrase_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents without 50-word passages that an earlier document has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_phrases(docs, 50).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in SQL, over whole tables.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
win AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)
),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM hit, range(50) AS r(k) GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, words, CASE WHEN places IS NULL THEN words ELSE
    list_transform(list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i))), lambda i: words[i]) END AS rest
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(rest) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(rest, ' '), '')) AS kept_sha256
FROM kept
"""
