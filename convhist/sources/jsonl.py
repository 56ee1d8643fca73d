"""Line-delimited JSON sources: record order, bad-line policy, path roles, side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convhist.functions.text import trim_space
from convhist.session import materialize

MAX_RECORD_BYTES = 64 * 1024 * 1024
POLICIES = ("fail", "note")


def scan_jsonl(spark: SparkSession, paths: str | list[str], policy: str = "fail", blank: str = "skip") -> DataFrame:
    """One row per record: file_path, record_no (1-based line order), line, issue (null, bad_json,
    too_large or blank).

    Files are read in splits. A row's place in its split comes from the row id of its task; what is aggregated, stored
    and summed up is one small row per split, so texts are neither copied nor shuffled unless there are too many splits
    to broadcast under Spark's own size limit. ``policy='fail'`` raises on the first bad line when the
    rows are used, ``'note'`` keeps it with its issue. ``blank``: skip, note or fail.
    """
    if policy not in POLICIES or blank not in ("skip", "note", "fail"):
        raise ValueError("unsupported policy")
    # Both reads of one listing have the same splits, so a row has the same id in both.
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )
    splits = materialize(raw.groupBy("file_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file_path", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rows = raw.join(starts, ["file_path", "_block"]).select("file_path", (F.col("_id") - F.col("_first") + F.col("_base") + 1).alias("record_no"), "line")
    parsed = F.try_parse_json(F.col("line"))
    issue = (
        F.when(trim_space(F.col("line")) == "", "blank").when(F.octet_length("line") > MAX_RECORD_BYTES, "too_large")
        .when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "bad_json")
    )
    rows = rows.withColumn("issue", issue)
    if blank == "skip":
        rows = rows.filter("issue IS NULL OR issue <> 'blank'")
    fatal = F.lit(False)
    if policy == "fail":
        fatal = fatal | F.col("issue").isin("bad_json", "too_large")
    if blank == "fail":
        fatal = fatal | (F.col("issue") == "blank")
    message = F.concat_ws(" ", F.lit("invalid record in"), "file_path", F.lit("line"), "record_no")
    return rows.withColumn("issue", F.when(F.coalesce(fatal, F.lit(False)), F.raise_error(message).cast("string")).otherwise(F.col("issue")))


_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_NAME = "[A-Za-z0-9][A-Za-z0-9_-]{0,127}"
# Path patterns by role, most specific first.
PATH_ROLES = (
    ("main", rf"^projects/[^/]+/{_UUID}\.jsonl$"),
    ("tool-result", rf"^projects/[^/]+/{_UUID}/tool-results/{_NAME}\.(?:txt|json)$"),
    ("subagent-transcript", rf"^projects/[^/]+/{_UUID}/subagents/agent-{_NAME}\.jsonl$"),
    ("subagent-metadata", rf"^projects/[^/]+/{_UUID}/subagents/agent-{_NAME}\.meta\.json$"),
    ("session-sidecar", rf"^projects/[^/]+/{_UUID}(?:/.*)?$"),
    ("checkpoint-backup", rf"^file-history/{_UUID}/[0-9a-f]{{16}}@v[0-9]+$"),
    ("checkpoint", rf"^file-history/{_UUID}/.+$"),
    ("task-highwatermark", rf"^tasks/{_UUID}/\.highwatermark$"),
    ("task-entry", rf"^tasks/{_UUID}/[0-9]+\.json$"),
    ("auxiliary", r"^(?:history\.jsonl|projects/(?!(?:[^/]+/memory)(?:/|$)).+|daemon/roster\.json|jobs/[^/]+/state\.json)$"),
    ("auxiliary", r"^(?:file-history|paste-cache|image-cache|tasks|session-env|plans|teams)/.+$"),
)
PROJECT_ROLES = ("session-sidecar", "subagent-transcript", "subagent-metadata", "tool-result")


def classify_paths(files: DataFrame, column: str = "relative_path") -> DataFrame:
    """Add role, project and session candidate; files without a role are dropped.

    The patterns are literals in one CASE expression: no join and nothing to broadcast.
    """
    path = F.col(column)
    role = F.when(F.lit(False), "")
    for name, pattern in PATH_ROLES:
        role = role.when(path.rlike(pattern), name)
    rows = files.withColumn("role", role).filter("role IS NOT NULL")
    session = F.lower(F.regexp_extract(path, rf"^(?:projects/[^/]+|file-history|tasks)/({_UUID})(?:[./]|$)", 1))
    project = F.regexp_extract(path, r"^projects/([^/]+)/", 1)
    return rows.select(
        "*", F.nullif(project, F.lit("")).alias("project"),
        F.when(F.col("role") != "auxiliary", F.nullif(session, F.lit(""))).alias("session_candidate"),
    )


def assign_sidecars(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(side files with the main file they belong to, leftovers without one).

    All side files follow their session; four roles must also lie in the project of the main file.
    """
    main = classified.filter("role = 'main'").select("session_candidate", F.col("project").alias("main_project"), F.col("relative_path").alias("main_path"))
    side = classified.filter("role NOT IN ('main', 'auxiliary')")
    joined = side.join(main, "session_candidate")
    fits = ~F.col("role").isin(*PROJECT_ROLES) | (F.col("project") == F.col("main_project"))
    owned = joined.filter(fits).drop("main_project")
    return owned, side.join(owned.select("relative_path"), "relative_path", "left_anti")


def file_listing(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files below a folder with size and modification time; contents only if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return rows.select(*columns, "content") if content else rows.select(*columns)


def record_field(line: Column, path: str, kind: str = "string") -> Column:
    """Typed field of a JSON record by variant path, null if absent or of another type."""
    return F.try_variant_get(F.try_parse_json(line), path, kind)
