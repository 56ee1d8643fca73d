"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 16 segments of four bits. One differing bit moves one count by
one, so the Manhattan distance of two count vectors is at most the Hamming distance of the fingerprints. The grid join
under distance 2: each fingerprint goes to the cell of its vector and to those one step away; vectors within distance 2
share such a cell (the point halfway). Pairs in a cell are then checked exactly by their differing bits.

Skew: equal fingerprints are one node. A cell with more than HOT_CELL fingerprints makes no pairs: its fingerprints go to
themselves and their 64 one-bit changes; those that meet are within distance 2 of each other and link to the least.

Defined cases: null text has no words and fingerprint zero, linked like any other; a repeated row gets the same result; a
component of null ids alone has a null id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.llm.common import encoded, materialize, text_slices
from convhist.operators.graphs import components

HOT_CELL = 200
SEED = 42


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by a space; of all words if there are fewer; none without words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    text = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
    widths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(widths) - 1
    first = (ends - widths + 1)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(text.lower().split(), size)) for text in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 16 segments of four bits, each in the four bits of its segment."""
    ones = F.lit(0x1111111111111111)
    return fp.bitwiseAND(ones) + sum((F.shiftrightunsigned(fp, i).bitwiseAND(ones) for i in (2, 3)), F.shiftrightunsigned(fp, 1).bitwiseAND(ones))


def _cells(counts: Column) -> Column:
    """The cell of a count vector and the cells one step away; counts stay within 0 to 4."""
    steps = []
    for i in range(16):
        one = F.lit(1 << 4 * i)
        at = F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15))
        steps += [F.when(at > 0, counts - one), F.when(at < 4, counts + one)]
    return F.filter(F.array(counts, *steps), lambda c: c.isNotNull())


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: links whose closure joins all distinct fingerprints `fp` within two bits of each other.

    Below HOT_CELL every such pair is a row; in hot cells a pair may be joined through their least neighbour instead.
    """
    cells = materialize(prints.select("fp", F.explode(_cells(segment_counts(F.col("fp")))).alias("cell")))
    sizes = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = materialize(cells.join(sizes.hint("merge"), "cell"))
    cool = shared.filter(F.col("n") <= HOT_CELL).select("cell", "fp")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = cool.withColumnRenamed("fp", "a").join(cool.withColumnRenamed("fp", "b").hint("merge"), "cell").filter(F.col("a") < F.col("b")).filter(close).select("a", "b")
    hot = shared.filter(F.col("n") > HOT_CELL).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    balls = materialize(hot.select("fp", F.explode(flips).alias("ball")))
    least = materialize(balls.groupBy("ball").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("ball", "a"))
    stars = balls.join(least.hint("merge"), "ball").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp): the smallest id reachable over links of at most two bits."""
    stored = materialize(prints)
    nodes = materialize(stored.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_links(nodes.select("fp"))
    joined = materialize(components(nodes.select("fp"), links, "fp", "a", "b").join(nodes.hint("merge"), "fp"))
    ids = materialize(joined.groupBy("component_ref").agg(F.min("least").alias("component_id")))
    labels = joined.select("fp", "component_ref").join(ids.hint("merge"), "component_ref").select("fp", "component_id")
    return stored.join(labels.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def brute_force(prints: dict[int, int]) -> dict[int, int]:
    """Component ids by comparing all pairs; for tests."""
    root = {d: d for d in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if ((prints[a] ^ prints[b]) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in prints}


def op10_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(fingerprints(docs)).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
