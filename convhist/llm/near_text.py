"""Near copies by word shingles: SimHash fingerprints, the segment-popcount join, and an exact check.

A fingerprint of the whole text finds copies within two bits; a similarity of 0.8 moves about ten. So each text also has
VIEWS fingerprints, each the SimHash of three of its shingles, those with the least hashes in three of 3 * VIEWS bins: texts
of similarity s agree in one with probability s^3 (some view: over 0.99 at 0.8). They go through the same grid at radius
0. Candidates are checked by the exact Jaccard similarity of their shingle sets; groups are the components of what passes.

Skew: texts with equal words are one node. A class of more than SMALL_CLASS nodes makes no rows of pairs: its nodes are dealt
by a hash into blocks of about BLOCK, every two blocks meet in one group, and a group compares all its pairs at once. So
every pair of every class is compared; a task holds two blocks at most, and a text travels once per block of its class.

Defined cases: null text is empty, and texts without words are copies of each other; rows equal in id and text are one
document of which one row stays; of equal ids the smaller key goes first, null ids last; all columns are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm.common import encoded, keyed, materialize
from convhist.llm.grams import mix
from convhist.llm.op4_suffix import packed_texts, unpacked
from convhist.llm.op10_simhash import majority, near_links, segment_counts, shingle_hashes
from convhist.operators.graphs import components

VIEWS = 8
SMALL_CLASS = 16
BLOCK = 256
_LAST = (1 << 63) - 1


def view_prints(hashes: np.ndarray, views: int = VIEWS) -> list[int]:
    """For each view the SimHash of the least hashes of its three bins; an empty bin borrows from the next one."""
    bins = 3 * views
    spread = mix(hashes)
    least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, (spread % np.uint64(bins)).astype(np.int64), spread)
    held = np.flatnonzero(least != np.iinfo(np.uint64).max)
    if not len(held):
        return [0] * views
    at = np.arange(bins)
    source = held[np.searchsorted(held, at) % len(held)]
    values = mix(least[source] + ((at - source) % bins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(views, 3)
    return [majority(v) for v in values]


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in encoded(batch.column("text")):
                words = text.lower().split()
                hashes = shingle_hashes(words, shingle)
                digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype="<i8").tolist()
                rows.append((*digest, majority(hashes), len(np.unique(hashes)), view_prints(hashes)))
            w1, w2, fp, n, views = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").fill_null(_LAST), batch.column("key"), pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(views, pa.list_(pa.int64()))],
                names=["ord", "key", "w1", "w2", "fp", "n", "views"],
            )

    return run


def jaccard(a: bytes, b: bytes, shingle: int) -> float:
    x, y = (set(shingle_hashes(t.lower().split(), shingle).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _similar(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set] = {}
        for batch in batches:
            passed = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), unpacked(batch.column("x")), unpacked(batch.column("y")), strict=True):
                if len(sets) > 512:
                    sets.clear()
                for key, text in ((a, x), (b, y)):
                    if key not in sets:
                        sets[key] = set(shingle_hashes(text.lower().split(), shingle).tolist())
                both = len(sets[a] & sets[b])
                passed.append(both >= similarity * (len(sets[a]) + len(sets[b]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(passed)), batch.column("b").filter(pa.array(passed))], names=["a", "b"])

    return run


def verified(pairs: DataFrame, packed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar, as a table."""
    pairs = materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    texts = materialize(packed.join(wanted.hint("merge"), "key").select("key", "packed").dropDuplicates(["key"]))
    left, right = (texts.select(F.col("key").alias(k), F.col("packed").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return materialize(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(_similar(shingle, similarity), "a long, b long"))


def _block_links(shingle: int, similarity: float):
    def run(table: pa.Table) -> pa.Table:
        keys, own = table.column("key").to_pylist(), table.column("own").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sets = [np.unique(shingle_hashes(t.lower().split(), shingle)) for t in unpacked(table.column("packed"))]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        ends = np.cumsum(sizes)
        distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
        root = list(range(len(keys)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        order = np.argsort(own, kind="stable")  # texts of the lower block first
        codes = np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in order.tolist()])
        sizes, keys = sizes[order], [keys[i] for i in order.tolist()]
        ends = np.cumsum(sizes)
        held = int((own == low).sum())
        links = []  # a spanning forest of what is similar joins as much as all of it
        for i in range(held):
            first = i + 1 if low == high else held
            if first == len(keys):
                break
            marks = np.zeros(len(distinct), dtype=bool)
            marks[codes[ends[i] - sizes[i] : ends[i]]] = True
            start = ends[first] - sizes[first]
            shared = np.concatenate(([0], np.cumsum(marks[codes[start:]])))
            both = shared[ends[first:] - start] - shared[ends[first:] - sizes[first:] - start]
            for j in (first + np.flatnonzero(both >= similarity * (sizes[i] + sizes[first:] - both))).tolist():
                x, y = find(i), find(j)
                if x != y:
                    root[x] = y
                    links.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
        left, right = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def block_links(large: DataFrame, packed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links (a, b) whose closure joins all similar texts of each class. large: (class, key, members)."""
    texts = materialize(packed.join(large.select("key").distinct().hint("merge"), "key").select("key", "packed").dropDuplicates(["key"]))
    dealt = large.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    met = dealt.select("class", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("class", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key")
    return materialize(met.join(texts.hint("merge"), "key").groupBy("class", "low", "high").applyInArrow(_block_links(shingle, similarity), "a long, b long").distinct())


def similar_links(nodes: DataFrame, packed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links (a, b) between nodes (ord, key, fp, n, views)."""
    sized = (F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")) & (F.col("a") != F.col("b"))
    least = nodes.groupBy("fp").agg(F.min_by(F.struct("key", "n"), F.struct("ord", "key")).alias("lead"))
    near = near_links(least.select("fp"))
    ends = least.select("fp", F.col("lead.key").alias("key"), F.col("lead.n").alias("n"))
    by_print = near.join(ends.select(F.col("fp").alias("a"), F.col("key").alias("_a"), "n").hint("merge"), "a").join(ends.select(F.col("fp").alias("b"), F.col("key").alias("_b"), F.col("n").alias("m")).hint("merge"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n", "m")
    cells = F.transform(F.concat(F.array("fp"), F.col("views")), lambda v, i: F.struct(i.alias("view"), v.alias("print"), segment_counts(v).alias("cell")))
    placed = materialize(nodes.select("ord", "key", "n", F.explode(cells).alias("c")).select("ord", "key", "n", "c.*"))
    cell = ["view", "cell", "print"]  # radius 0: equal vectors, checked by the bits themselves
    sizes = materialize(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    shared = materialize(placed.join(sizes.hint("merge"), cell).withColumn("class", F.xxhash64(*cell)).select("class", "ord", "key", "n", "members"))
    small = shared.filter(F.col("members") <= SMALL_CLASS)
    pairs = small.select("class", F.col("key").alias("a"), "n").join(small.select("class", F.col("key").alias("b"), F.col("n").alias("m")).hint("merge"), "class").filter("a < b").select("a", "b", "n", "m")
    large = shared.filter(F.col("members") > SMALL_CLASS).select("class", "key", "members")
    found = verified(pairs.union(by_print).filter(sized).select("a", "b"), packed, shingle, similarity)
    return found.union(block_links(large, packed, shingle, similarity))


def dropped_keys(base: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(keys of documents that are later copies, keys of documents that stand in several rows). base: see `keyed`."""
    sketches = materialize(base.mapInArrow(_sketches(shingle), "ord long, key long, w1 long, w2 long, fp long, n int, views array<long>"))
    lead = F.min(F.struct("ord", "key")).alias("lead")
    nodes = materialize(sketches.groupBy("w1", "w2").agg(lead, F.max("fp").alias("fp"), F.max("n").alias("n"), F.max("views").alias("views")).select("w1", "w2", "lead.*", "fp", "n", "views"))
    copies = sketches.select("w1", "w2", "key").join(nodes.select("w1", "w2", F.col("key").alias("_key")).hint("merge"), ["w1", "w2"]).filter("key <> _key").select("key")
    links = similar_links(nodes.select("ord", "key", "fp", "n", "views"), packed_texts(base), shingle, similarity)
    ends = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    labels = materialize(components(ends, links, "key", "a", "b").join(nodes.select("key", "ord").hint("merge"), "key"))
    leads = labels.groupBy("component_ref").agg(F.min(F.struct("ord", "key")).alias("lead")).select("component_ref", F.col("lead.key").alias("_key"))
    near = labels.join(leads.hint("merge"), "component_ref").filter("key <> _key").select("key")
    twins = sketches.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key")
    return materialize(copies.union(near).distinct()), materialize(twins)


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without later near copies; of each group the one with the smallest id stays, unchanged."""
    base = keyed(docs, text_col, id_col)
    gone, twins = dropped_keys(base, shingle, similarity)
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = docs.withColumn("_near_key", F.xxhash64(doc_id, doc_id.isNull(), text))
    kept = marked.join(gone.withColumnRenamed("key", "_near_key").hint("merge"), "_near_key", "left_anti")
    if not twins.isEmpty():
        repeated = twins.withColumnRenamed("key", "_near_key").hint("merge")
        kept = kept.join(repeated, "_near_key", "left_anti").union(kept.join(repeated, "_near_key", "left_semi").dropDuplicates(["_near_key"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
