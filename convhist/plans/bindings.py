"""Canonical tables derived from the given parquet tables, with the same derivation as SQL text.

The given tables carry no source kind, workspace or per-turn time, so these are derived from the
ids by fixed rules. Every derivation is row-wise or a map-side combined aggregate over the whole
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.ids import SOURCE_KINDS
from convhist.functions.text import compact_title
from convhist.operators.ordered import last_value, running_sum, scan

# Gap codes and annotation codes used by the derived rows.
GAP_CODES = ("response.reasoning", "record.opaque", "compaction.marker")
NOTE_CODES = ("reasoning.omitted", "tool.partial", "citation.unresolved", "image.retained", "model.unknown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _ref(conv: Column) -> Column:
    return F.concat(pick(SOURCE_KINDS, conv % 4), F.lit(":"), F.lpad(conv.cast("string"), 12, "0"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation items: messages and gaps in order."""
    raw = table(spark, sf_dir, "conversations")
    gap = (F.col("conv_id") + F.col("turn")) % 9 == 8
    code = pick(GAP_CODES, F.col("conv_id") % 3)
    extra = (F.col("conv_id") * 7 + F.col("turn")) % 5
    return raw.select(
        "conv_id",
        _ref(F.col("conv_id")).alias("session_ref"),
        F.col("turn").alias("ordinal"),
        F.when(gap, "gap").otherwise("message").alias("kind"),
        F.when(gap, "").otherwise(F.col("role")).alias("role"),
        F.when(gap, "").otherwise(F.col("text")).alias("text"),
        # Some times are unknown, the others differ below a millisecond.
        F.when((F.col("conv_id") * 5 + F.col("turn")) % 29 != 3, F.expr(
            "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), cast(turn * 1001 as decimal(18, 6)) / 1000000)"
        )).alias("ts"),
        F.when(~gap & (F.col("role") == "assistant"), F.concat(F.lit("m"), (F.col("conv_id") + F.col("turn")) % 3))
        .otherwise("")
        .alias("model"),
        F.when(gap, code).otherwise("").alias("code"),
        F.when(gap, F.concat(F.lit("retained "), code)).otherwise("").alias("label"),
        F.when(gap | (extra == 0), F.array().cast("array<string>"))
        .when(extra < 3, F.array(pick(NOTE_CODES, extra)))
        .otherwise(F.array(pick(NOTE_CODES, extra), pick(NOTE_CODES, F.col("turn") % 5)))
        .alias("notes"),
        F.when(gap, F.array().cast("array<string>"))
        .when(extra == 1, F.array(F.lit("text"), F.lit("thinking")))
        .when(extra == 2, F.array(F.lit("text"), F.lit("tool_use"), F.lit("image")))
        .when(extra == 3, F.array(F.lit("text"), F.lit("document"), F.lit("hologram")))
        .otherwise(F.array(F.lit("text")))
        .alias("content_kinds"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session: a map-side combined aggregate of the items, then derived columns."""
    c = F.col("conv_id")
    first_user = F.min_by(
        F.when((F.col("role") == "user") & (F.col("kind") == "message"), F.col("text")),
        F.when((F.col("role") == "user") & (F.col("kind") == "message"), F.col("ordinal")),
    )
    model = F.max_by("model", F.when(F.col("model") != "", F.col("ordinal")))
    return (
        items(spark, sf_dir)
        .groupBy("conv_id", "session_ref")
        .agg(
            F.coalesce(compact_title(first_user), F.lit("")).alias("title"),
            F.coalesce(model, F.lit("")).alias("model"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
            F.count(F.lit(1)).alias("n_items"),
        )
        .select(
            "*",
            pick(SOURCE_KINDS, c % 4).alias("agent"),
            c.cast("string").alias("native_id"),
            F.concat(F.lit("/work/p"), c % 7, F.when(c % 3 == 0, "/pkg").otherwise("")).alias("context"),
            F.concat(F.lit("provider"), c % 3).alias("provider"),
            F.when(c % 6 == 0, F.concat(F.lit("Pinned "), c)).otherwise("").alias("name"),
            F.array_compact(
                F.array(F.when(c % 2 == 0, F.lit("even")), F.when(c % 3 == 0, F.lit("third")))
            ).alias("tags"),
            (c % 10 == 3).alias("archived"),
            (c % 10 == 7).alias("deleted"),
        )
    )


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child to parent edges; every thirteenth session names a parent that does not exist."""
    c = F.col("conv_id")
    parent = F.when(c % 13 == 0, F.lit(-1)).when((c % 5).isin(1, 2), c - 1)
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id")
        .distinct()
        .select(_ref(c).alias("session_ref"), parent.alias("p"))
        .filter("p IS NOT NULL")
        .select("session_ref", F.when(F.col("p") < 0, F.lit("event_log:missing")).otherwise(_ref(F.col("p"))).alias("parent_ref"))
    )


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls, results and exchanges of each session; a beat starts at each signup event."""
    raw = (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id"),
            F.col("event_id").alias("ordinal"),
            "event_type",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )
    )
    beat = scan(raw, ["user_id"], "ordinal", {"beat": running_sum((F.col("event_type") == "signup").cast("bigint"))})
    phase = F.col("phase")
    return (
        beat.filter("event_type <> 'signup'")
        .select(
            F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("session_ref"),
            "ordinal",
            "beat",
            F.when(F.col("event_type") == "view", "call")
            .when(F.col("event_type").isin("click", "error"), "result")
            .otherwise("exchange")
            .alias("phase"),
            F.concat(F.lit("c"), F.col("k") % 10).alias("call_id"),
            "k",
            "event_type",
        )
        .select(
            "session_ref", "ordinal", "beat", "phase", "call_id",
            F.when(phase != "result", F.concat(F.lit("tool"), F.col("k") % 4)).otherwise("").alias("name"),
            F.when(phase == "call", F.concat(F.lit("ns"), F.col("k") % 2)).otherwise("").alias("namespace"),
            F.when((phase == "exchange") & (F.col("k") % 5 == 0), "denied").otherwise("").alias("status"),
            F.when(phase == "call", F.concat(F.lit('{"k": '), F.col("k"), F.lit("}"))).otherwise("").alias("input"),
            F.when(phase != "call", F.concat(F.lit('{"ok": '), F.col("ordinal"), F.lit("}"))).otherwise("").alias("output"),
            F.when((F.col("event_type") == "error") | ((phase == "result") & (F.col("k") % 7 == 0)), F.lit('{"message": "failed"}')).otherwise("").alias("error"),
        )
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record forest per session: each record hangs below the last or the last even record before it."""
    raw = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("session_ref"),
        F.col("event_id").alias("record_no"),
        F.col("event_type").alias("type"),
        "ts",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    no = F.col("record_no")
    linked = scan(
        raw, ["session_ref"], "record_no",
        {"_p1": last_value(no, strict=True), "_p2": last_value(F.when(no % 2 == 0, no), strict=True)},
    )
    parent = F.when(no % 3 == 0, F.col("_p1")).otherwise(F.coalesce("_p2", "_p1"))
    return linked.select(
        "session_ref", "record_no", "type", "ts", "value", "k",
        F.concat(F.lit("r"), F.col("record_no")).alias("record_id"),
        F.when(parent.isNotNull(), F.concat(F.lit("r"), parent)).alias("parent_id"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---------------------------------------------------------------------------------------------
# The same derivations as SQL, one CTE each, for the side-by-side check.
# ---------------------------------------------------------------------------------------------


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _ref_sql(column: str) -> str:
    return f"({_list(SOURCE_KINDS)})[({column}) % 4 + 1] || ':' || lpad(({column})::VARCHAR, 12, '0')"


_NOTE = _list(NOTE_CODES)
_X = "((conv_id * 7 + turn) % 5)"
_GAP = "((conv_id + turn) % 9 = 8)"

ITEMS = f"""items AS (
  SELECT conv_id, {_ref_sql("conv_id")} AS session_ref, turn AS ordinal,
    CASE WHEN {_GAP} THEN 'gap' ELSE 'message' END AS kind,
    CASE WHEN {_GAP} THEN '' ELSE role END AS role,
    CASE WHEN {_GAP} THEN '' ELSE text END AS text,
    CASE WHEN (conv_id * 5 + turn) % 29 <> 3 THEN TIMESTAMP '2026-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) + to_microseconds(turn * 1001) END AS ts,
    CASE WHEN NOT {_GAP} AND role = 'assistant' THEN 'm' || ((conv_id + turn) % 3) ELSE '' END AS model,
    CASE WHEN {_GAP} THEN ({_list(GAP_CODES)})[conv_id % 3 + 1] ELSE '' END AS code,
    CASE WHEN {_GAP} THEN 'retained ' || ({_list(GAP_CODES)})[conv_id % 3 + 1] ELSE '' END AS label,
    CASE WHEN {_GAP} OR {_X} = 0 THEN []::VARCHAR[]
         WHEN {_X} < 3 THEN [({_NOTE})[{_X} + 1]]
         ELSE [({_NOTE})[{_X} + 1], ({_NOTE})[turn % 5 + 1]] END AS notes,
    CASE WHEN {_GAP} THEN []::VARCHAR[] WHEN {_X} = 1 THEN ['text', 'thinking']
         WHEN {_X} = 2 THEN ['text', 'tool_use', 'image'] WHEN {_X} = 3 THEN ['text', 'document', 'hologram']
         ELSE ['text'] END AS content_kinds
  FROM conversations)"""

_FLAT = "trim(regexp_replace(ut, '\\s+', ' ', 'g'))"

SESSIONS = f"""{ITEMS}, session_base AS (
  SELECT conv_id, session_ref,
    min_by(CASE WHEN role = 'user' AND kind = 'message' THEN text END,
           CASE WHEN role = 'user' AND kind = 'message' THEN ordinal END) AS ut,
    coalesce(max_by(model, CASE WHEN model <> '' THEN ordinal END), '') AS model,
    min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_items
  FROM items GROUP BY conv_id, session_ref),
sessions AS (
  SELECT conv_id, session_ref, model, created_at, updated_at, n_items,
    coalesce(CASE WHEN length({_FLAT}) <= 200 THEN {_FLAT} ELSE substr({_FLAT}, 1, 197) || '...' END, '') AS title,
    ({_list(SOURCE_KINDS)})[conv_id % 4 + 1] AS agent, conv_id::VARCHAR AS native_id,
    '/work/p' || (conv_id % 7) || CASE WHEN conv_id % 3 = 0 THEN '/pkg' ELSE '' END AS context,
    'provider' || (conv_id % 3) AS provider,
    CASE WHEN conv_id % 6 = 0 THEN 'Pinned ' || conv_id ELSE '' END AS name,
    list_filter([CASE WHEN conv_id % 2 = 0 THEN 'even' END, CASE WHEN conv_id % 3 = 0 THEN 'third' END],
                lambda t: t IS NOT NULL) AS tags,
    conv_id % 10 = 3 AS archived, conv_id % 10 = 7 AS deleted
  FROM session_base)"""

EDGES = f"""session_edges AS (
  SELECT {_ref_sql("conv_id")} AS session_ref,
    CASE WHEN conv_id % 13 = 0 THEN 'event_log:missing' ELSE {_ref_sql("conv_id - 1")} END AS parent_ref
  FROM (SELECT DISTINCT conv_id FROM conversations)
  WHERE conv_id % 13 = 0 OR conv_id % 5 IN (1, 2))"""

TOOLS = """tool_raw AS (
  SELECT 'user:' || lpad(user_id::VARCHAR, 12, '0') AS session_ref, event_id AS ordinal, event_type,
    json_extract_string(props, '$.k')::BIGINT AS k,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS beat
  FROM events),
tool_phase AS (
  SELECT *, CASE WHEN event_type = 'view' THEN 'call' WHEN event_type IN ('click', 'error') THEN 'result' ELSE 'exchange' END AS phase
  FROM tool_raw WHERE event_type <> 'signup'),
tool_events AS (
  SELECT session_ref, ordinal, beat, phase, 'c' || (k % 10) AS call_id,
    CASE WHEN phase <> 'result' THEN 'tool' || (k % 4) ELSE '' END AS name,
    CASE WHEN phase = 'call' THEN 'ns' || (k % 2) ELSE '' END AS namespace,
    CASE WHEN phase = 'exchange' AND k % 5 = 0 THEN 'denied' ELSE '' END AS status,
    CASE WHEN phase = 'call' THEN '{"k": ' || k || '}' ELSE '' END AS input,
    CASE WHEN phase <> 'call' THEN '{"ok": ' || ordinal || '}' ELSE '' END AS output,
    CASE WHEN event_type = 'error' OR (phase = 'result' AND k % 7 = 0) THEN '{"message": "failed"}' ELSE '' END AS error
  FROM tool_phase)"""

RECORDS = """record_raw AS (
  SELECT 'user:' || lpad(user_id::VARCHAR, 12, '0') AS session_ref, event_id AS record_no, event_type AS type,
    ts, value, json_extract_string(props, '$.k')::BIGINT AS k,
    lag(event_id, 1) OVER w AS p1,
    last_value(CASE WHEN event_id % 2 = 0 THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
records AS (
  SELECT session_ref, record_no, type, ts, value, k, 'r' || record_no AS record_id,
    'r' || (CASE WHEN record_no % 3 = 0 THEN p1 ELSE coalesce(p2, p1) END) AS parent_id
  FROM record_raw)"""
