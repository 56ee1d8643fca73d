"""Tables of recurring anchors: which recur, their classes, and the texts of one member of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.session import materialize

ANCHOR = "h long, ctx long, ord long, key long, pos int, back int, ahead int"


def recurring(anchors: DataFrame, place: Column) -> DataFrame:
    """Anchors whose hash stands at more than one `place` (a long), as a table.

    Least and largest places combine before the shuffle. They are stored, so that the join that keeps the rows reads plain
    exchanges and Spark can split a hot hash; so do the other joins here.
    """
    stored = materialize(anchors)
    spread = materialize(stored.groupBy("h").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).filter("_a <> _b").select("h"))
    return materialize(stored.join(spread.hint("merge"), "h", "left_semi"))


def classes(found: DataFrame, place: Column) -> DataFrame:
    """One row per (h, ctx): whether it has several places, its first member, and the number of classes of h."""
    each = found.groupBy("h", "ctx").agg(
        (F.min(place) != F.max(place)).alias("several"),
        F.min(F.struct("ord", "key", "pos")).alias("first"),
        F.max("back").alias("back"),
        F.max("ahead").alias("ahead"),
    )
    each = materialize(each)
    kinds = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")))
    return materialize(each.join(kinds.hint("merge"), "h"))


def wanted_places(kinds: DataFrame) -> DataFrame:
    """For each document the places whose contexts are needed: classes of hashes that have several."""
    return (
        kinds.filter("kinds > 1")
        .select("h", "ctx", "kinds", "back", "ahead", F.col("first.ord").alias("ord"), F.col("first.key").alias("key"), F.col("first.pos").alias("pos"))
        .groupBy("key")
        .agg(F.collect_list(F.struct("h", "ctx", "kinds", "ord", "pos", "back", "ahead")).alias("places"))
    )


def marked_spans(found: DataFrame, kinds: DataFrame, flags: DataFrame, copied: Column, length: int, starts: int) -> DataFrame:
    """(key, spans): the symbols that repeated windows cover, as unmerged half-open spans of each document.

    flags: (h, ctx, spans of window starts relative to the anchor) of first members. `copied` tells, from the columns of
    an anchor, `several` and `first`, which anchors repeat as a whole, with every window that holds them.
    """
    low, high = F.greatest(-F.col("back"), F.lit(1 - starts)), F.least(F.col("ahead") - length, F.lit(0))
    whole = F.array(F.struct(low.cast("int").alias("a"), (high + 1).cast("int").alias("b")))
    marks = materialize(kinds.join(flags.hint("merge"), ["h", "ctx"], "left").select("h", "ctx", "several", "first", "spans").filter("several or spans is not null"))
    hit = found.join(marks.hint("merge"), ["h", "ctx"]).select("key", "pos", F.when(copied, whole).otherwise(F.col("spans")).alias("spans")).filter("spans is not null")
    cover = lambda m: F.transform(m["spans"], lambda s: F.struct((m["pos"] + s["a"]).alias("a"), (m["pos"] + s["b"] - 1 + length).alias("b")))
    return hit.groupBy("key").agg(F.collect_set(F.struct("pos", "spans")).alias("marks")).select("key", F.flatten(F.transform("marks", cover)).alias("spans"))
