"""Fingerprints, snapshot diffs and incremental rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.ids import framed_digest, multiset_digest
from convhist.operators.skew import lookup_join


def source_key(kind: str, roots: list[str]) -> str:
    """Identity of a scan: earlier results are reusable only under the same roots."""
    return f"{kind}/1:" + "\0".join(roots)


def fingerprint_sources(files: DataFrame) -> DataFrame:
    """Per session: hash of the set of (path, role, size, mtime), combined map-side."""
    row = framed_digest(*[F.col(c).cast("string") for c in ("path", "role", "size", "modified")])
    return files.groupBy("session_ref").agg(multiset_digest("files1_", row).alias("fingerprint"), F.count(F.lit(1)).alias("files"))


def table_fingerprint(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Per key: order-independent hash of the rows of one table."""
    row = framed_digest(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return rows.groupBy(key).agg(multiset_digest("rows1_", row).alias(name))


def fingerprint_rows(sessions: DataFrame, own_columns: list[str], children: dict[str, tuple[DataFrame, list[str]]], component: DataFrame) -> DataFrame:
    """Session fingerprint over its row, its child tables and its component.

    ``children``: name -> (rows with session_ref, columns). ``component``: session_ref,
    component_ref. A session is rebuilt when any member of its component changes, so the own
    fingerprints are combined once more per component.
    """
    head = sessions.select("session_ref", framed_digest(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in own_columns]).alias("_own"))
    parts = ["_own"]
    for name, (rows, columns) in children.items():
        head = head.join(table_fingerprint(rows, "session_ref", columns, f"_{name}"), "session_ref", "left")
        parts.append(f"_{name}")
    own = head.select("session_ref", framed_digest(*[F.coalesce(F.col(p), F.lit("")) for p in parts]).alias("_fp"))
    members = own.join(component, "session_ref")
    shared = members.groupBy("component_ref").agg(multiset_digest("component1_", framed_digest(F.col("session_ref"), F.col("_fp"))).alias("_shared"))
    both = lookup_join(members, shared, ["component_ref"], "inner", ["session_ref"])
    return both.select("session_ref", framed_digest(F.col("_fp"), F.col("_shared")).alias("fingerprint"))


def classify_snapshot(previous: DataFrame, current: DataFrame, same_source: bool = True) -> DataFrame:
    """(session_ref, change): reused, rebuilt or removed, by a full outer join of fingerprints."""
    joined = current.select("session_ref", F.col("fingerprint").alias("_now"), F.lit(True).alias("_c")).join(
        previous.select("session_ref", F.col("fingerprint").alias("_was"), F.lit(True).alias("_p")), "session_ref", "full"
    )
    reusable = F.lit(same_source) & F.col("_p").isNotNull() & F.col("_now").eqNullSafe(F.col("_was"))
    return joined.select(
        "session_ref",
        F.when(F.col("_c").isNull(), "removed").when(reusable, "reused").otherwise("rebuilt").alias("change"),
    )


def diff_snapshots(previous: DataFrame, current: DataFrame, same_source: bool = True) -> DataFrame:
    changes = classify_snapshot(previous, current, same_source)
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("reused", "rebuilt", "removed")])


def rebuild_changed(
    current: DataFrame, cached: DataFrame, version: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Reuse results whose (session, revision, version) match; run ``build`` on the rest only.

    ``current``: session_ref, revision. ``cached``: the result rows with revision and version.
    """
    valid = cached.filter(F.col("version") == version)
    reused = valid.join(current.select("session_ref", "revision"), ["session_ref", "revision"], "left_semi")
    pending = current.join(valid.select("session_ref", "revision").distinct(), ["session_ref", "revision"], "left_anti")
    return reused.unionByName(build(pending).withColumn("version", F.lit(version)))


def removed_rows(index: DataFrame, current: DataFrame, scanned_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows removed): only rows of scanned kinds can disappear."""
    scanned = F.col("agent").isin(*scanned_kinds)
    removed = index.filter(scanned).join(current.select("session_ref"), "session_ref", "left_anti")
    kept = index.join(removed.select("session_ref").distinct(), "session_ref", "left_anti")
    return kept, removed


def source_revision(sessions: DataFrame, item_digest: DataFrame) -> DataFrame:
    """Revision over identity, context, model, provider, times, archive flag and conversation.

    Title, tags and scan state are left out on purpose: renaming a session must not rebuild it.
    """
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    named = [
        F.col("session_ref"), F.col("agent"), F.col("native_id"), F.col("context"), F.col("model"), F.col("provider"),
        at("created_at"), at("updated_at"), F.col("archived").cast("string"), F.col("item_digest"),
    ]
    joined = sessions.join(item_digest, "session_ref", "left")
    return joined.select("session_ref", F.concat(F.lit("revision1_"), framed_digest(*named)).alias("revision"))


def item_digest(items: DataFrame) -> DataFrame:
    """Digest of the raw conversation of each session; the ordinal keeps it order-sensitive."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    row = framed_digest(F.col("ordinal"), F.col("kind"), F.col("role"), F.col("text"), at, F.col("model"), F.col("code"))
    return items.groupBy("session_ref").agg(multiset_digest("items1_", row).alias("item_digest"))


def change_flag(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)
