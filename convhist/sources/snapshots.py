"""Snapshots (append-only, one head per source kind) and self-describing bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.ids import SOURCE_KINDS


def write_snapshot(sessions: DataFrame, root: str, snapshot_id: str, published_at: str) -> None:
    """Append an immutable snapshot, then advance the heads of the source kinds it contains.

    The data is complete before the head rows appear, so a reader never sees half a snapshot.
    """
    known = F.coalesce(F.col("agent").isin(*SOURCE_KINDS), F.lit(False))
    agent = F.when(known, F.col("agent")).otherwise(F.raise_error(F.concat(F.lit("unknown source kind "), F.coalesce("agent", F.lit("null")))).cast("string"))
    rows = sessions.withColumn("agent", agent).withColumn("snapshot_id", F.lit(snapshot_id))
    rows.write.mode("append").partitionBy("agent", "snapshot_id").parquet(f"{root}/sessions")
    # The kinds are read from the folders just written; the sessions are not computed again.
    written = sessions.sparkSession.read.parquet(f"{root}/sessions").filter(F.col("snapshot_id") == snapshot_id)
    heads = written.select("agent", F.lit(snapshot_id).alias("snapshot_id")).distinct().withColumn("published_at", F.lit(published_at).cast("timestamp_ntz"))
    heads.write.mode("append").parquet(f"{root}/heads")


def current_heads(spark: SparkSession, root: str) -> DataFrame:
    heads = spark.read.parquet(f"{root}/heads")
    return heads.groupBy("agent").agg(F.max_by("snapshot_id", F.struct("published_at", "snapshot_id")).alias("snapshot_id"))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of the current heads. At most one head per source kind exists, so the broadcast is
    bounded by the number of kinds, and the join prunes the other partitions at run time."""
    heads = current_heads(spark, root).filter(F.col("agent").isin(*SOURCE_KINDS))
    return spark.read.parquet(f"{root}/sessions").join(F.broadcast(heads), ["agent", "snapshot_id"])


def prunable_snapshots(spark: SparkSession, root: str, pinned: DataFrame) -> DataFrame:
    """Snapshots that are neither a head nor pinned (agent, snapshot_id); deleting is up to the caller."""
    every = spark.read.parquet(f"{root}/heads").select("agent", "snapshot_id").distinct()
    kept = current_heads(spark, root).select("agent", "snapshot_id").unionByName(pinned.select("agent", "snapshot_id"))
    return every.join(kept, ["agent", "snapshot_id"], "left_anti")


def export_bundle(entries: DataFrame, objects: DataFrame, bindings: DataFrame, path: str) -> None:
    """Write entries, objects (object_id, content) and bindings as one bundle with stored digests."""
    described = objects.withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    for name, rows in (("entries", entries), ("objects", described), ("bindings", bindings)):
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("entries", "objects", "bindings"))


def damaged_objects(objects: DataFrame) -> DataFrame:
    """Objects whose content no longer has the stored digest or size."""
    same = (F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size_bytes"))
    return objects.filter(~F.coalesce(same, F.lit(False))).select("object_id")


def verify_files(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of bound files: ok, missing or different. ``files``: path, content (binaryFile)."""
    found = files.select("path", F.sha2("content", 256).alias("_sha"), F.octet_length("content").alias("_size"))
    joined = bindings.select("path", "sha256", "size_bytes").join(found, "path", "left")
    status = F.when(F.col("_sha").isNull(), "missing").when((F.col("_sha") == F.col("sha256")) & (F.col("_size") == F.col("size_bytes")), "ok").otherwise("different")
    return joined.select("path", status.alias("status"))
