"""Continuous ingestion: records, de-duplication, activity, tool pairing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from convhist.operators.tools import pair_tools
from convhist.session import materialize

CALL_COLUMNS = ["session_ref", "ordinal", "phase", "call_id", "name", "namespace", "status", "input", "output", "error", "ts"]


def read_records(spark: SparkSession, path: str, schema: StructType | str, file_format: str = "json", glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream of new files below a folder. The schema is fixed; streams never infer one."""
    reader = spark.readStream.format(file_format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def append_records(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a Parquet table exactly once: file sink log plus query checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedupe_records(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop re-delivered records; state is bounded by the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def activity_windows(stream: DataFrame, keys: list[str], time: str = "ts", length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding window, emitted once the watermark has passed its end."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = stream.withWatermark(time, delay).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("records"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "records")


def activity_sessions(stream: DataFrame, keys: list[str], time: str = "ts", gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Bursts of activity per key: records with pauses shorter than ``gap``."""
    counted = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("records"))
    return counted.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "records")


def with_open(emitted: DataFrame, rows: DataFrame, windows: Callable[[DataFrame], DataFrame], end: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """What a finished stream has emitted, and the windows that its watermark had not passed yet.

    ``rows`` are the records it has read, as a table; ``windows`` is the function that made the windows and ``end`` their
    end column. A stream that goes on emits those windows itself later.
    """
    newest = rows.agg(F.max(time)).head()[0]  # one value
    if newest is None:
        return emitted
    # Watermarks count whole milliseconds.
    mark = F.date_trunc("millisecond", F.lit(newest)) - F.expr(f"INTERVAL {delay}")
    # Stored first: a filter on the end must not reach the rows from which session windows are merged.
    return emitted.unionByName(materialize(windows(rows)).filter(F.col(end) > mark))


def pair_tools_stream(stream: DataFrame, root: str, checkpoint: str, timeout: str = "INTERVAL 1 DAY", available_now: bool = True) -> StreamingQuery:
    """Pair tool calls across micro-batches; results in ``root/paired``, expired calls in ``root/unanswered``.

    Each batch joins the calls left open by the batch before with the batch version of the pairing
    (chunked scans, so a hot call id is no problem) and writes the calls still open as the next
    version of the state table. All three outputs are keyed by the batch id and overwritten on a
    retry, so every result appears exactly once. Events of one call id must not arrive in an
    earlier batch than events they follow. Calls older than ``timeout`` behind the newest event
    count as unanswered.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*CALL_COLUMNS)
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{root}/open/batch={batch_id - 1}").select(*CALL_COLUMNS))
        paired = pair_tools(rows, ["session_ref"])
        paired.write.mode("overwrite").parquet(f"{root}/paired/batch={batch_id}")
        others = [c for c in CALL_COLUMNS if c not in ("session_ref", "call_id")]
        last = rows.filter("phase <> 'exchange'").groupBy("session_ref", "call_id").agg(F.max_by(F.struct(*others), "ordinal").alias("_l"))
        waiting = last.select("session_ref", "call_id", "_l.*").filter("phase = 'call'")
        newest = rows.agg(F.max("ts")).head()[0]  # one value
        aged = waiting.withColumn("_old", F.coalesce(F.col("ts") < F.lit(newest) - F.expr(timeout), F.lit(False)))
        aged.filter("_old").drop("_old").select(*CALL_COLUMNS).write.mode("overwrite").parquet(f"{root}/unanswered/batch={batch_id}")
        aged.filter("NOT _old").drop("_old").select(*CALL_COLUMNS).write.mode("overwrite").parquet(f"{root}/open/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
