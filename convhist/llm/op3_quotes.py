"""Quotation linking: quote levels, hashed quoted passages joined to the messages they come from, reading order.

A line's level is the number of > marks it starts with. Consecutive lines of one level are one passage; blank lines do not
end it. A passage is compared by its shingles of SHINGLE words without marks, case and line breaks, so a quote may be wrapped
anew or begin inside a line; a passage of fewer words is one shingle, and so is a quoted line of fewer words. A shingle
points to the first turn of its conversation that has it at level 0, if that turn is earlier; a level points to the turn
with most quoted words, of equals the later one. The lowest level that points anywhere decides the reply; deeper levels are
links to ancestors (`quoted_links`). Only conversations with quotes are shingled, in the sizes that their quotes need. The
lookup has one row per conversation and shingle, so a passage that is quoted very often makes no pairs.

`reading_order` numbers the turns of each conversation: a turn, then its replies by turn, each with its own replies.

Defined cases: null text is empty; blank lines are neither quotes nor originals; rows with a null conversation or turn are
kept and never linked or numbered; repeated rows are kept, each with the same link; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm.common import materialize
from convhist.operators.graphs import forest_depth
from convhist.operators.ordered import previous_row, range_chunks, scan

SHINGLE = 5
_MARKS = r"^((?:[ \t]*>)*)"
_NO_PARENT = -(1 << 63)


def passages(text: str) -> Iterator[tuple[int, list[list[str]]]]:
    """(level, words of each line) of the runs of lines of one level."""
    run: list[list[str]] = []
    at = 0
    for line in text.split("\n"):
        marks = re.match(_MARKS, line)[1]
        level, words = marks.count(">"), line[len(marks) :].lower().split()
        if not words:
            continue
        if level != at and run:
            yield at, run
            run = []
        at = level
        run.append(words)
    if run:
        yield at, run


def _hash(words: list[str]) -> int:
    value = xxhash.xxh64_intdigest(" ".join(words))
    return value - (1 << 64) if value >> 63 else value


def quoted_shingles(text: str) -> set[tuple[int, int, int]]:
    """(level, words, hash) of the quoted passages of a text."""
    out = set()
    for level, run in passages(text):
        if level:
            words = [w for line in run for w in line]
            size = min(SHINGLE, len(words))
            pieces = [words[i : i + size] for i in range(len(words) - size + 1)] + [line for line in run if len(line) < size]
            out |= {(level, len(p), _hash(p)) for p in pieces}
    return out


def own_shingles(text: str, sizes: list[int]) -> set[int]:
    """Hashes of the runs of so many words outside quotes."""
    out = set()
    for level, run in passages(text):
        if not level:
            words = [w for line in run for w in line]
            out |= {_hash(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}
    return out


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = quoted_shingles(text)
            at += [i] * len(found)
            rows += found
        level, size, h = zip(*rows, strict=True) if rows else ((),) * 3
        keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("conv_id", "turn")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(level, pa.int32()), pa.array(size, pa.int32()), pa.array(h, pa.int64())], names=["conv_id", "turn", "level", "size", "h"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, (text, sizes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("sizes").to_pylist(), strict=True)):
            found = own_shingles(text, sizes)
            at += [i] * len(found)
            rows += found
        keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("conv_id", "turn")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(rows, pa.int64())], names=["conv_id", "turn", "h"])


def quoted_links(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, level, origin): for each quote level of a turn the earlier turn it comes from."""
    known = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null and turn is not null")
    ids = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    marked = known.filter(F.col("text").rlike(r"(^|\n)[ \t]*>"))
    quoted = materialize(marked.mapInArrow(_quoted, f"{ids}, level int, size int, h long").distinct())
    sizes = materialize(quoted.groupBy("conv_id").agg(F.collect_set("size").alias("sizes")))
    own = known.join(sizes.hint("merge"), "conv_id").select("conv_id", "turn", "text", "sizes").mapInArrow(_own, f"{ids}, h long")
    first = materialize(own.groupBy("conv_id", "h").agg(F.min("turn").alias("origin")))
    found = quoted.join(first.hint("merge"), ["conv_id", "h"]).filter(F.col("origin") < F.col("turn"))
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("n"))
    return materialize(votes.groupBy("conv_id", "turn", "level").agg(F.max_by("origin", F.struct("n", "origin")).alias("origin")))


def link_quotations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, n_quoted, max_level, text): see `conversations` for the order of replies."""
    base = turns.select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[ \t]", ""))
    links = quoted_links(turns).groupBy("conv_id", "turn").agg(F.min_by("origin", "level").alias("reply_to"))
    own = F.array_join(F.filter("lines", lambda x: level(x) == 0), "\n")
    levels = F.transform("lines", level)
    out = base.select("conv_id", "turn", "role", F.size(F.filter(levels, lambda x: x > 0)).cast("long").alias("n_quoted"), F.array_max(levels).cast("long").alias("max_level"), own.alias("text"))
    return out.join(materialize(links).hint("merge"), ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "reply_to", "n_quoted", "max_level", "text")


def reading_order(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, position): turns from 0 on in the order of replies. linked: (conv_id, turn, reply_to).

    The turn before another one is the turn it answers or, if an earlier turn answers that too, the last one below that
    earlier turn. Both are found by pointer doubling, so no list of a conversation or of a reply path is built.
    """
    nodes = linked.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to"))
    nodes = materialize(nodes.withColumn("_parent", F.coalesce(F.col("reply_to").cast("long"), F.lit(_NO_PARENT))))
    keys = ["conv_id", "_parent"]
    beside = scan(range_chunks(nodes, keys, ["turn"]), keys, ["turn"], {"_before": previous_row(F.col("turn"))}, chunk="_range")
    beside = materialize(beside.select("conv_id", "turn", "reply_to", F.col("_before.v").alias("before")))
    newest = nodes.filter("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.max("turn").alias("newest"))
    down = nodes.select("conv_id", "turn").join(newest.hint("merge"), ["conv_id", "turn"], "left")
    ends = forest_depth(down, ["conv_id"], "turn", "newest").select("conv_id", F.col("node").alias("before"), F.col("root").alias("end"))
    placed = beside.join(ends.hint("merge"), ["conv_id", "before"], "left").select("conv_id", "turn", F.when(F.col("before").isNull(), F.col("reply_to")).otherwise(F.col("end")).alias("after"))
    return forest_depth(placed, ["conv_id"], "turn", "after").select("conv_id", F.col("node").alias("turn"), F.col("depth").alias("position"))


def conversations(turns: DataFrame) -> DataFrame:
    """`link_quotations` with the position of each turn, null where a turn is not numbered: sort by it to read a conversation."""
    linked = materialize(link_quotations(turns))
    order = materialize(reading_order(linked))
    return linked.join(order.hint("merge"), ["conv_id", "turn"], "left").select("conv_id", "position", *linked.columns[1:])


def op3_quotation_links(spark, sf_dir: str) -> DataFrame:
    """Every turn with the turn it quotes, its text without quotes and its place in the order of replies."""
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
