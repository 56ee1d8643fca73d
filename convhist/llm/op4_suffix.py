"""Suffix-array dedup by longest-previous-factor arrays.

Texts are bytes. Anchors (see `grams`) find where a string of `min_len` bytes may stand twice. The contexts of anchors
that recur meet in shards; each shard sorts its suffixes by multiplying prefixes, up to `min_len` bytes, and reads from the
suffix order whether a smaller (or larger) position precedes or follows within a run of common prefixes of that length:
the longest previous (or next) factor reaches `min_len` exactly there. A later copy goes, the first stays (`keep="first"`),
or all copies go (`keep="none"`).

Skew: equal contexts are compared by one member, so copies of whole passages cost one row. A hash with more than
HOT_CLASSES different contexts isn't gathered: its windows are hashed and counted, which combines before the shuffle. Before
that, bins of neighbouring windows are counted by the bytes they share and cover (see `hot_flags`).

Defined cases: null text is empty; texts shorter than `min_len` lose nothing; rows equal in id and text are one
document; rows with a null id are documents of their own, last in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm import grams
from convhist.llm.common import encoded, keyed, merged, runs_of, text_slices
from convhist.llm.recurring import ANCHOR, classes, marked_spans, recurring, wanted_places
from convhist.session import materialize

HOT_CLASSES = 1024
CORES = 8
SHARD_BYTES = 1 << 16
_LAST = (1 << 63) - 1
CONTEXT = "h long, ctx long, kinds long, ord long, key long, pos int, back int, context binary"
FLAGGED = "h long, ctx long, spans array<struct<a:int,b:int>>"


def byte_anchors(blobs: list[bytes], windows: grams.Windows):
    """Anchors of a few documents: (document number, place, hash, context hash, bytes before, bytes from it on)."""
    sizes = np.array([len(b) for b in blobs], dtype=np.int64)
    flat = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    stops = np.cumsum(sizes)
    ends, begins = np.repeat(stops, sizes), np.repeat(stops - sizes, sizes)
    at, hashes = grams.anchors(grams.Prefix(grams.BYTE_SYMBOLS[0][flat]), ends, windows)
    if not len(at):
        return None
    back, ahead = grams.contexts(at, begins, ends, windows)
    ctx = grams.Prefix(grams.BYTE_SYMBOLS[1][flat], 1).ranges(at - back, at + ahead) ^ back.astype(np.uint64)
    return np.searchsorted(stops, at, side="right"), at - begins[at], hashes, ctx, back, ahead


def _anchor_rows(windows: grams.Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, ids, keys = encoded(batch.column("text")), batch.column("doc_id").fill_null(_LAST).to_numpy(), batch.column("key").to_numpy()
            keep = [i for i, b in enumerate(blobs) if len(b) >= windows.length]
            for a, b in text_slices([len(blobs[i]) for i in keep]):
                part = np.array(keep[a:b])
                if (found := byte_anchors([blobs[i] for i in part], windows)) is None:
                    continue
                doc, pos, h, ctx, back, ahead = found
                doc = part[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h.view(np.int64), ctx.view(np.int64), ids[doc], keys[doc], pos.astype(np.int32), back.astype(np.int32), ahead.astype(np.int32))],
                    names=["h", "ctx", "ord", "key", "pos", "back", "ahead"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array([press.compress(b) for b in encoded(batch.column("text"))], pa.binary())], names=["key", "doc_id", "packed"])


def packed_texts(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_packed, "key long, doc_id long, packed binary")


def unpacked(column) -> Iterator[bytes]:
    unpress = zstandard.ZstdDecompressor()
    return (unpress.decompress(x) if x is not None else b"" for x in column.to_pylist())


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for key, text, places in zip(batch.column("key").to_pylist(), unpacked(batch.column("packed")), batch.column("places").to_pylist(), strict=True):
            for p in places:
                rows.append((p["h"], p["ctx"], p["kinds"], p["ord"], key, p["pos"], p["back"], text[p["pos"] - p["back"] : p["pos"] + p["ahead"]]))
                held += len(rows[-1][-1])
            if held > 1 << 20:
                yield context_batch(rows)
                rows, held = [], 0
        if rows:
            yield context_batch(rows)


def context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ("h", "ctx", "kinds", "ord", "key", "pos", "back", "context")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def dense_ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each value among the different values, and how many there are."""
    order = np.argsort(values)
    ascending = values[order]
    ranks = np.empty(len(values), dtype=np.uint64)
    ranks[order] = np.cumsum(np.concatenate(([False], ascending[1:] != ascending[:-1]))[: len(values)])
    return ranks, int(ranks[order[-1]]) + 1 if len(order) else 0


def suffix_ranks(flat: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks) of the suffixes with at least `length` bytes in their context, by their first `length` bytes.

    Prefix multiplying: the rank by k * m bytes is the rank of the k ranks by m bytes, side by side in one number, as many
    as fit. Equal ranks: equal prefixes.
    """
    n = len(flat)
    room = ends - np.arange(n)
    width = min(8, length)
    padded = np.concatenate((flat, np.zeros(8, dtype=np.uint8)))
    values = np.ndarray(n, dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * width)
    at = np.flatnonzero(room >= width)
    ranks = np.zeros(n, dtype=np.uint64)
    ranks[at], kinds = dense_ranks(values[at])
    while width < length:
        bits = max(1, (kinds - 1).bit_length())
        wider = min(width * (64 // bits), length)
        at = np.flatnonzero(room >= wider)
        spots = max(0, n - wider + 1)
        key = ranks[:spots].copy()
        for piece in range(1, -(-wider // width)):
            skip = min(piece * width, wider - width)
            key = key << np.uint64(bits) | ranks[skip : skip + spots]
        ranks[at], kinds = dense_ranks(key[at])
        width = wider
    return at, ranks[at].astype(np.int64)


def factor_flags(at: np.ndarray, ranks: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): whether the longest previous and next factor of each suffix reach the ranked length.

    `place` is the position in the corpus. A run of equal ranks in suffix order holds the places of one prefix: a smaller
    one is there if a place isn't the least of its run, a larger one if it isn't the largest. A place that the shard holds
    twice is one.
    """
    if not len(at):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    order = np.argsort(ranks)
    r, p = ranks[order], place[order]
    fresh = np.concatenate(([True], r[1:] != r[:-1]))
    head, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    previous, following = np.empty(len(at), dtype=bool), np.empty(len(at), dtype=bool)
    previous[order] = p > np.minimum.reduceat(p, head)[run]
    following[order] = p < np.maximum.reduceat(p, head)[run]
    return previous, following


def shard_flags(rows: list[tuple], windows: grams.Windows, keep: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Repeated starts, as spans relative to the anchor, of each (h, ctx, ord, key, pos, back, context) of a shard."""
    rows = sorted(rows, key=lambda x: (x[2], x[3], x[4]))
    sizes = np.array([len(x[6]) for x in rows], dtype=np.int64)
    stops = np.cumsum(sizes)
    number = np.repeat(np.arange(len(rows)), sizes)
    at, ranks = suffix_ranks(np.frombuffer(b"".join(x[6] for x in rows), dtype=np.uint8), stops[number], windows.length)
    owners = {d: i for i, d in enumerate(dict.fromkeys((x[2], x[3]) for x in rows))}
    base = np.array([(owners[x[2], x[3]] << 40) + x[4] - x[5] for x in rows], dtype=np.int64)
    begin = stops - sizes
    own = number[at]
    previous, following = factor_flags(at, ranks, base[own] + at - begin[own])
    flags = previous if keep == "first" else previous | following
    hits = np.flatnonzero(flags)
    if not len(hits):
        return []
    starts, whose = at[hits], own[hits]
    offsets = starts - (begin + np.array([x[5] for x in rows], dtype=np.int64))[whose]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > 1) | (np.diff(whose) > 0))))
    last = np.concatenate((head[1:], [len(hits)])) - 1
    spans = list(zip(offsets[head].tolist(), (offsets[last] + 1).tolist(), strict=True))
    bounds = np.searchsorted(whose[head], np.arange(len(rows) + 1)).tolist()
    return [(row[0], row[1], spans[a:b]) for row, a, b in zip(rows, bounds, bounds[1:], strict=False) if a < b]


def flagged_batch(found: list[tuple]) -> pa.RecordBatch:
    spans = pa.array([[{"a": a, "b": b} for a, b in x[2]] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), spans], names=["h", "ctx", "spans"])


def by_shards(kernel, limit: int = SHARD_BYTES):
    """Feed rows that arrive sorted by h to `kernel` in shards of whole hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, cut = 0, 0  # cut: where the last hash begins
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "ord", "key", "pos", "back", "context")), strict=True):
                if rows and row[0] != rows[-1][0]:
                    cut = len(rows)
                    if held >= limit:
                        if found := kernel(rows):
                            yield flagged_batch(found)
                        rows, held, cut = [], 0, 0
                rows.append(row)
                held += len(row[6])
        if rows and (found := kernel(rows)):
            yield flagged_batch(found)

    return run


def core_bins(back: int, size: int, windows: grams.Windows) -> Iterator[tuple[int, int, int]]:
    """(bin, first, last) for the window starts in a context of `size` bytes, dealt into CORES bins by their distance from the anchor."""
    wide = -(-windows.starts // CORES)
    shift = back - windows.starts + 1
    for b in range(CORES):
        first, last = max(0, b * wide + shift), min(size - windows.length, min((b + 1) * wide, windows.starts) - 1 + shift)
        if first <= last:
            yield b, first, last


def _bin_rows(windows: grams.Windows):
    """For each bin of a hot context the hash of its core, the bytes that all its windows hold, and of all the bytes they cover."""
    wide = -(-windows.starts // CORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cores: list[int] = []
            covers: list[bytes] = []
            for *own, back, text in zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "ord", "key", "pos", "back", "context")), strict=True):
                for b, first, last in core_bins(back, len(text), windows):
                    low = b * wide + back - windows.starts + 1  # the bin's first start, which may lie before the context
                    high = min(low + wide - 1, back)
                    rows.append((*own, b, first - back, last - back + 1))
                    cores.append(xxhash.xxh3_64_intdigest(text[high : low + windows.length], seed=b))
                    covers.append(xxhash.xxh3_128_digest(text[first : last + windows.length], seed=(first - low) * wide + last - low))
            table = np.array(rows, dtype=np.int64).reshape(-1, 8).T
            halves = np.frombuffer(b"".join(covers), dtype="<i8").reshape(-1, 2).T
            lanes = (*table[:5], *table[5:].astype(np.int32), np.array(cores, dtype=np.uint64).view(np.int64), *halves)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in lanes], names=["h", "ctx", "ord", "key", "pos", "bin", "a", "b", "core", "c1", "c2"])

    return run


def _window_rows(windows: grams.Windows):
    """The windows of hot contexts in their `bins` by hash: the exact way for hashes with too many contexts for one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "ord", "key", "pos", "back", "context", "bins")), strict=True))
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                starts = [[j for b, first, last in core_bins(r[5], len(r[6]), windows) if b in r[7] for j in range(first, last + 1)] for r in part]
                sizes = [len(x) for x in starts]
                lanes = [xxhash.xxh3_128_digest(r[6][j : j + windows.length]) for r, x in zip(part, starts, strict=True) for j in x]
                halves = np.frombuffer(b"".join(lanes), dtype="<i8").reshape(-1, 2)
                step = np.array([j for x in starts for j in x], dtype=np.int32)
                each = [np.repeat(np.array([r[c] for r in part], dtype=np.int64), sizes) for c in range(4)]
                pos, back = (np.repeat(np.array([r[c] for r in part], dtype=np.int32), sizes) for c in (4, 5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), *each, step + pos - back, step - back)],
                    names=["w1", "w2", "h", "ctx", "ord", "key", "place", "rel"],
                )

    return run


def hot_flags(hot: DataFrame, windows: grams.Windows, keep: str) -> DataFrame:
    """Flags of hashes with too many contexts for one shard.

    Two equal windows share an anchor, hence a hash, a distance from it, a bin and its core. Bins that cover equal bytes are
    one class: all their windows repeat. Different classes of one core are compared by one member each, window by window.
    """
    bins = materialize(hot.mapInArrow(_bin_rows(windows), "h long, ctx long, ord long, key long, pos long, bin int, a int, b int, core long, c1 long, c2 long"))
    cover = ["h", "core", "c1", "c2"]
    lead = F.min(F.struct("ord", "key", "pos", "ctx"))
    alike = materialize(bins.groupBy(*cover).agg(F.min("bin").alias("bin"), lead.alias("lead"), (F.min("ctx") != F.max("ctx")).alias("several")))
    mixed = materialize(alike.groupBy("h", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "core"))
    wanted = alike.join(mixed.hint("merge"), ["h", "core"], "left_semi").groupBy("h", F.col("lead.ctx").alias("ctx")).agg(F.collect_set("bin").alias("bins"))
    whole = bins.join(materialize(alike.filter("several").select(*cover, F.col("lead.ctx").alias("_lead"))).hint("merge"), cover)
    near = hot.join(wanted.hint("merge"), ["h", "ctx"])
    rows = near.mapInArrow(_window_rows(windows), "w1 long, w2 long, h long, ctx long, ord long, key long, place int, rel int")
    where = F.struct("ord", "key", "place") if keep == "first" else F.xxhash64("key", "place")
    rows = materialize(rows.select("w1", "w2", "h", "ctx", "rel", where.alias("at")))
    ends = materialize(rows.groupBy("w1", "w2").agg(F.min("at").alias("_min"), F.max("at").alias("_max")).filter("_min <> _max").select("w1", "w2", "_min"))
    hit = rows.join(ends.hint("merge"), ["w1", "w2"])
    if keep == "first":
        hit, whole = hit.filter(F.col("at") != F.col("_min")), whole.filter(F.col("ctx") != F.col("_lead"))
    both = hit.select("h", "ctx", F.col("rel").alias("a"), (F.col("rel") + 1).alias("b")).union(whole.select("h", "ctx", "a", "b"))
    return both.groupBy("h", "ctx").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def repeated_spans(docs: DataFrame, packed: DataFrame, min_len: int = 400, keep: str = "none", gram: int | None = None) -> DataFrame:
    """(key, spans): for each document with repeats the bytes that go, as unmerged half-open spans. docs: see `keyed`."""
    windows = grams.Windows(min_len, gram or max(1, min_len // 2))
    place = F.xxhash64("key", "pos")
    found = recurring(docs.mapInArrow(_anchor_rows(windows), ANCHOR), place)
    kinds = classes(found, place)
    texts = materialize(packed.join(wanted_places(kinds).hint("merge"), "key").mapInArrow(cut_contexts, CONTEXT))
    cool, hot = texts.filter(F.col("kinds") <= HOT_CLASSES), texts.filter(F.col("kinds") > HOT_CLASSES)
    flags = cool.repartition("h").sortWithinPartitions("h").mapInArrow(by_shards(lambda rows: shard_flags(rows, windows, keep)), FLAGGED)
    if not hot.isEmpty():
        flags = flags.union(hot_flags(hot, windows, keep))
    # With keep="first" the first member of a class is judged against other classes only.
    lead = (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))
    copied = F.col("several") if keep == "none" else ~lead
    return marked_spans(found, kinds, flags, copied, min_len, windows.starts)


def merged_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, starts, ends) of the union of each row's spans, as `merged` gives them; row i has those from bounds[i] to bounds[i + 1]."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    each = column.flatten()
    a, b = (each.field(i).to_numpy().astype(np.int64) for i in range(2))
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(a):
        return np.zeros(len(counts) + 1, dtype=np.int64), a, b
    stride = int(b.max()) + 1  # rows side by side on one line, so that spans of two rows never touch
    order = np.argsort(a + rows * stride)
    low, high = (a + rows * stride)[order], np.maximum.accumulate((b + rows * stride)[order])
    head = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
    last = np.concatenate((head[1:], [len(low)])) - 1
    base = rows[order][head] * stride
    return np.searchsorted(rows[order][head], np.arange(len(counts) + 1)), low[head] - base, high[last] - base


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, starts, ends = merged_column(batch.column("spans"))
        gone = list(zip(starts.tolist(), ends.tolist(), strict=True))
        sizes, out = [], []
        for text, low, high in zip(unpacked(batch.column("packed")), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            pieces, at = [], 0
            for a, b in gone[low:high]:
                pieces.append(text[at:a])
                at = b
            sizes.append(len(text))
            out.append(b"".join((*pieces, text[at:])) if at else text)
        spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], names=["a", "b"])
        lost = np.concatenate(([0], np.cumsum(ends - starts)))[bounds]
        n_bytes, n_removed = np.array(sizes, dtype=np.int64), np.diff(lost)
        for a, b in text_slices([len(x) for x in out]):
            low, high = bounds[a], bounds[b]
            offsets = pa.array((bounds[a : b + 1] - low).astype(np.int32))
            columns = [batch.column("doc_id")[a:b], batch.column("key")[a:b], pa.array(n_bytes[a:b]), pa.array(n_removed[a:b]), pa.ListArray.from_arrays(offsets, spans[low:high]), pa.array(out[a:b], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_bytes", "n_removed", "spans", "kept"])


def dedup_substrings(docs: DataFrame, min_len: int = 400, keep: str = "first", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, key, n_bytes, n_removed, spans, kept): each document without strings of `min_len` bytes that repeat.

    keep="first": a byte goes if a string of `min_len` bytes that covers it also starts earlier in the corpus (smaller
    doc_id, or before it in the same document). keep="none": if it also starts anywhere else. Strings are judged on the
    input. spans: the maximal removed runs. kept: the remaining bytes.
    """
    base = keyed(docs, text_col, id_col)
    spans = repeated_spans(base, packed_texts(base), min_len, keep)
    return packed_texts(base).join(spans.hint("merge"), "key", "left").mapInArrow(_kept, "doc_id long, key long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept binary")


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a changed text: their key and the text that is left, in valid UTF-8."""
    for batch in batches:
        keys, texts = [], []
        for key, text, spans in zip(batch.column("key").to_pylist(), unpacked(batch.column("packed")), batch.column("spans").to_pylist(), strict=True):
            pieces, at = [], 0
            for a, b in merged([(s["a"], s["b"]) for s in spans]):
                pieces.append(text[at:a].decode(errors="ignore"))  # a span may end inside a character
                at = b
            keys.append(key)
            texts.append("".join((*pieces, text[at:].decode(errors="ignore"))))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["_cut_key", "_cut_text"])


def _short_passages(words: int, min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["w1", "w2", "ord", "key", "size", "places"])

        for batch in batches:
            rows: list[tuple] = []
            for ord_, key, text in zip(batch.column("doc_id").fill_null(_LAST).to_pylist(), batch.column("key").to_pylist(), encoded(batch.column("text")), strict=True):
                flat = np.frombuffer(text, dtype=np.uint8)
                bounds = runs_of((flat != 32) & ((flat < 9) | (flat > 13)))
                if len(bounds) < words:
                    continue
                first, last = bounds[: len(bounds) - words + 1, 0], bounds[words - 1 :, 1]
                short = np.flatnonzero(last - first < min_len)
                places: dict[bytes, tuple[int, list[int]]] = {}
                for a, b in zip(first[short].tolist(), last[short].tolist(), strict=True):
                    places.setdefault(xxhash.xxh3_128_digest(text[a:b]), (b - a, []))[1].append(a)
                rows += [(*np.frombuffer(h, dtype="<i8").tolist(), ord_, key, *found) for h, found in places.items()]
                if len(rows) > 10_000:
                    yield block(rows)
                    rows = []
            yield block(rows)

    return run


def short_repeats(docs: DataFrame, words: int, min_len: int) -> DataFrame:
    """(key, spans): later copies of passages of `words` words that are shorter than `min_len` bytes. docs: see `keyed`.

    Such passages are few, so each is hashed with 128 bits; a document has one row per different passage, the first copy
    is a minimum that combines before the shuffle.
    """
    found = materialize(docs.mapInArrow(_short_passages(words, min_len), "w1 long, w2 long, ord long, key long, size int, places array<int>"))
    owner = F.struct("ord", "key")
    seen = found.groupBy("w1", "w2").agg(F.min(owner).alias("first"), F.max(owner).alias("last"), F.max(F.size("places")).alias("times"))
    several = materialize(seen.filter("first <> last or times > 1").select("w1", "w2", F.col("first.key").alias("_key")))
    later = found.join(several.hint("merge"), ["w1", "w2"]).select("key", "size", F.when(F.col("key") == F.col("_key"), F.expr("slice(places, 2, size(places))")).otherwise(F.col("places")).alias("places"))
    spans = later.filter(F.size("places") > 0).select("key", F.transform("places", lambda p: F.struct(p.alias("a"), (p + F.col("size")).alias("b"))).alias("spans"))
    return spans.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def without_repeats(docs: DataFrame, min_len: int = 400, text_col: str = "text", id_col: str = "doc_id", min_words: int | None = None) -> DataFrame:
    """All columns of the documents, texts without later copies of strings of `min_len` bytes, or of `min_words` words.

    Characters that a removed run cuts in half go as a whole. Documents of which only white space is left go if something
    was removed from them; all others stay.
    """
    base = keyed(docs, text_col, id_col)
    packed = packed_texts(base)
    spans = repeated_spans(base, packed, min_len, "first")
    if min_words:  # longer ones hold a string of min_len bytes that repeats
        both = spans.union(short_repeats(base, min_words, min_len))
        spans = both.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = packed.join(spans.hint("merge"), "key").dropDuplicates(["key"]).mapInArrow(_cut_rows, "_cut_key long, _cut_text string")
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = docs.withColumn("_cut_key", F.xxhash64(doc_id, doc_id.isNull(), text)).join(cut.hint("merge"), "_cut_key", "left")
    left = marked.filter(F.col("_cut_text").isNull() | F.col("_cut_text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.coalesce("_cut_text", F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def brute_force(texts: dict[int, bytes], min_len: int, keep: str) -> dict[int, list[tuple[int, int]]]:
    """Removed runs by counting every string; for tests."""
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - min_len + 1):
            seen.setdefault(texts[d][i : i + min_len], []).append((d, i))
    out: dict[int, list[tuple[int, int]]] = {d: [] for d in texts}
    for places in seen.values():
        for d, i in places[1 if keep == "first" else 0 :] if len(places) > 1 else []:
            out[d].append((i, i + min_len))
    return {d: merged(s) for d, s in out.items()}


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents without any string of 400 bytes that stands more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dedup_substrings(docs, 400, "none")
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
