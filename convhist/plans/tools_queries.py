"""Queries: tool calls, work items, side files, ledger events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.operators import tools as G
from convhist.plans.bindings import TOOLS, documents, pick, table, tool_events
from convhist.plans.registry import query

BEAT = ["session_ref", "beat"]

_PAIRED = f"""{TOOLS}, turns AS (
  SELECT *, lag(phase) OVER w AS cp, lag(name) OVER w AS cn, lag(namespace) OVER w AS cs, lag(input) OVER w AS ci
  FROM tool_events WHERE phase <> 'exchange' WINDOW w AS (PARTITION BY session_ref, beat, call_id ORDER BY ordinal)),
closed AS (
  SELECT session_ref, beat, ordinal, call_id, name, namespace, status, input, output, error, cn, cs, ci FROM turns WHERE phase = 'result' AND cp = 'call'
  UNION ALL SELECT session_ref, beat, ordinal, call_id, name, namespace, status, input, output, error, NULL, NULL, NULL FROM tool_events WHERE phase = 'exchange'),
paired AS (
  SELECT session_ref, beat, ordinal, call_id, coalesce(nullif(name, ''), nullif(cn, ''), 'unknown') AS name,
    coalesce(nullif(namespace, ''), cs, '') AS namespace,
    coalesce(nullif(status, ''), CASE WHEN error = '' THEN 'completed' ELSE 'error' END) AS status,
    coalesce(nullif(input, ''), ci, '') AS input, output, error FROM closed)"""


@query("pair_tools", f"WITH {_PAIRED} SELECT * FROM paired")
def pair_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_tools(tool_events(spark, sf_dir), BEAT)


_BUDGET = f"""{_PAIRED}, sized AS (SELECT *, strlen(to_json(struct_pack(name := name, namespace := namespace, status := status,
  input := input, output := output, error := error))::VARCHAR)::BIGINT AS tool_bytes FROM paired),
running AS (SELECT *, sum(tool_bytes) OVER (PARTITION BY session_ref ORDER BY ordinal)::BIGINT AS running_bytes FROM sized)"""


@query(
    "tool_budget",
    f"""WITH {_BUDGET} SELECT session_ref, ordinal, tool_bytes, running_bytes, running_bytes <= 4096 AS kept,
    count(*) FILTER (running_bytes > 4096) OVER (PARTITION BY session_ref) AS omitted_tools FROM running""",
)
def tool_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.tool_budget(G.pair_tools(tool_events(spark, sf_dir), BEAT), ["session_ref"])
    return rows.select("session_ref", "ordinal", "tool_bytes", "running_bytes", "kept", "omitted_tools")


@query(
    "beat_tools",
    f"""WITH {_BUDGET} SELECT session_ref, to_json(coalesce(list(struct_pack(name := name, namespace := namespace, status := status,
      input := input, output := output, error := error) ORDER BY ordinal) FILTER (running_bytes <= 4096), []))::VARCHAR AS tools,
      count(*) FILTER (running_bytes > 4096) AS omitted_tools FROM running GROUP BY session_ref""",
)
def beat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.tool_budget(G.pair_tools(tool_events(spark, sf_dir), BEAT), ["session_ref"])
    return G.beat_tools(rows, ["session_ref"])


@query(
    "tool_summary",
    """SELECT doc_id, '' AS name, source AS namespace, CASE WHEN lang = 'en' THEN 'error' ELSE '' END AS status,
    CASE WHEN strlen(text) <= 1024 THEN text ELSE left(text, (SELECT max(n) FROM generate_series(0, 1024) g(n) WHERE strlen(left(text, n::INT)) <= 1024)::INT) END AS input,
    '' AS output, CASE WHEN lang = 'en' THEN lang ELSE '' END AS error FROM documents""",
)
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(
        "doc_id", F.lit(None).cast("string").alias("name"), F.col("source").alias("namespace"), F.lit("").alias("status"),
        F.col("text").alias("input"), F.lit(None).cast("string").alias("output"), F.when(F.col("lang") == "en", F.col("lang")).alias("error"),
    )
    return G.tool_summary(rows)


_PER_CALL = """per_call AS (SELECT session_ref, beat, call_id, count(*) AS n, count(*) FILTER (phase = 'exchange') AS x,
  count(*) FILTER (phase = 'call') AS c, count(*) FILTER (phase = 'result') AS r, min(ordinal) FILTER (phase = 'call') AS ac,
  min(ordinal) FILTER (phase = 'result') AS ar, max(family) FILTER (phase = 'call') AS cf, max(family) FILTER (phase = 'result') AS rf,
  max(turn_id) FILTER (phase = 'call') AS ct, max(turn_id) FILTER (phase = 'result') AS rt,
  max(nname) FILTER (phase = 'call') AS cn, max(nname) FILTER (phase = 'result') AS rn FROM live GROUP BY ALL)"""
_LIVE = f"""{TOOLS}, live AS (SELECT *, ['local_shell', 'function'][ordinal % 2 + 1] AS family,
  CASE WHEN ordinal % 3 = 0 THEN NULL ELSE 'turn' || (ordinal % 2) END AS turn_id, nullif(name, '') AS nname FROM tool_events)"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ordinal")
    return tool_events(spark, sf_dir).withColumn("family", pick(("local_shell", "function"), o % 2)).withColumn(
        "turn_id", F.when(o % 3 != 0, F.concat(F.lit("turn"), o % 2))
    ).withColumn("name", F.nullif(F.col("name"), F.lit("")))


@query(
    "tools_closed",
    f"""WITH {_LIVE}, {_PER_CALL} SELECT session_ref, beat, bool_and((n = 1 AND x = 1) OR coalesce(n = 2 AND c = 1 AND r = 1 AND ac < ar, false)) AS closed
    FROM per_call GROUP BY ALL""",
)
def tools_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tools_closed(tool_events(spark, sf_dir), BEAT)


@query(
    "tool_batches_valid",
    f"""WITH {_LIVE}, {_PER_CALL} SELECT session_ref, beat, count(*) AS calls, bool_and((n = 1 AND x = 1) OR coalesce(n = 2 AND c = 1 AND r = 1 AND ac < ar
      AND (cf = rf OR (cf = 'local_shell' AND rf = 'function')) AND (ct IS NULL OR rt IS NULL OR ct = rt) AND (rn IS NULL OR rn = cn), false)) AS valid
    FROM per_call GROUP BY ALL""",
)
def tool_batches_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tool_batches_valid(_live(spark, sf_dir), BEAT)


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task graph per conversation: turns 0-1, 2-3, ... block each other; some mirrors are missing."""
    t, c = F.col("turn"), F.col("conv_id")
    none = F.array().cast("array<string>")
    defect = (c % 4 == 0) & (t == 3)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("g"), c).alias("graph_ref"), F.concat(F.lit("w"), t).alias("id"),
        F.when(t % 2 == 0, F.array(F.concat(F.lit("w"), t + 1))).otherwise(none).alias("blocks"),
        F.when((t % 2 == 1) & ~defect, F.array(F.concat(F.lit("w"), t - 1))).otherwise(none).alias("blocked_by"),
        pick(("completed", "pending", "in_progress"), (t + c) % 3).alias("status"), (t % 4 == 1).alias("has_metadata"),
    )


_WORK = """work AS (SELECT 'g' || conv_id AS graph_ref, 'w' || turn AS id, CASE WHEN turn % 2 = 0 THEN ['w' || (turn + 1)] ELSE [] END AS blocks,
  CASE WHEN turn % 2 = 1 AND NOT (conv_id % 4 = 0 AND turn = 3) THEN ['w' || (turn - 1)] ELSE [] END AS blocked_by,
  ['completed', 'pending', 'in_progress'][(turn + conv_id) % 3 + 1] AS status, turn % 4 = 1 AS has_metadata FROM conversations),
outs AS (SELECT graph_ref, id AS src, unnest(blocks) AS dst FROM work), ins AS (SELECT graph_ref, unnest(blocked_by) AS src, id AS dst FROM work)"""


@query(
    "work_graph_valid",
    f"""WITH {_WORK}, odd AS ((SELECT * FROM outs EXCEPT SELECT * FROM ins) UNION ALL (SELECT * FROM ins EXCEPT SELECT * FROM outs))
    SELECT DISTINCT graph_ref, graph_ref NOT IN (SELECT graph_ref FROM odd) AS valid FROM work""",
)
def work_graph_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.work_graph_valid(work_items(spark, sf_dir))


@query(
    "active_work",
    f"""WITH {_WORK}, act AS (SELECT * FROM work WHERE status <> 'completed') SELECT graph_ref, id, status,
      array_to_string(list_filter(blocks, lambda b: EXISTS_IN(b)), ',') AS blocks, '' AS blocked_by FROM act""".replace(
        "array_to_string(list_filter(blocks, lambda b: EXISTS_IN(b)), ',') AS blocks, '' AS blocked_by",
        """coalesce((SELECT string_agg(dst, ',') FROM outs o WHERE o.graph_ref = act.graph_ref AND o.src = act.id
             AND EXISTS (SELECT 1 FROM work a WHERE a.graph_ref = o.graph_ref AND a.id = o.dst AND a.status <> 'completed')), '') AS blocks,
           coalesce((SELECT string_agg(src, ',') FROM ins o WHERE o.graph_ref = act.graph_ref AND o.dst = act.id
             AND EXISTS (SELECT 1 FROM work a WHERE a.graph_ref = o.graph_ref AND a.id = o.src AND a.status <> 'completed')), '') AS blocked_by""",
    ),
)
def active_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.active_work(work_items(spark, sf_dir))[0]
    return rows.select(
        "graph_ref", "id", "status", F.array_join("blocks", ",").alias("blocks"), F.array_join("blocked_by", ",").alias("blocked_by")
    )


@query(
    "active_work_counts",
    f"WITH {_WORK} SELECT graph_ref, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (has_metadata) AS with_metadata FROM work GROUP BY 1",
)
def active_work_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.active_work(work_items(spark, sf_dir))[1]


@query(
    "todo_state",
    """WITH todos AS (SELECT conv_id, turn, turn + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS position,
      CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'later' ELSE ['pending', 'in_progress', 'completed', 'cancelled'][turn % 4 + 1] END AS status FROM conversations),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM todos)
    SELECT 's' || conv_id AS session_ref, CASE WHEN bool_and(position = i AND status <> 'later') THEN 'verified' ELSE 'unverified' END AS state, count(*) AS items
    FROM numbered GROUP BY conv_id""",
)
def todo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), c).alias("session_ref"), t.alias("row_no"), (t + F.when(c % 5 == 0, 1).otherwise(0)).alias("position"),
        F.col("text").alias("content"), F.when((c % 7 == 0) & (t == 1), "later").otherwise(pick(G.TODO_STATUSES, t % 4)).alias("status"),
        pick(G.TODO_PRIORITIES, t % 3).alias("priority"),
    )
    return G.todo_state(rows)


_KINDS = {
    "view": "background_started", "click": "background_updated", "purchase": "foreground_completed",
    "signup": "foreground_resumed", "error": "notification",
}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_TASKS = f"""tasks AS (SELECT 'u' || user_id AS session_ref, 'k' || json_extract_string(props, '$.k') AS child_id, event_id AS ordinal, {_KIND_SQL} AS kind FROM events)"""


_CHILDREN = f"""{_TASKS}, started AS (SELECT *, min(CASE WHEN kind LIKE 'background%' THEN ordinal END) OVER (PARTITION BY session_ref, child_id) AS st FROM tasks),
    facts AS (SELECT session_ref, child_id, count(*) FILTER (kind LIKE 'foreground%') AS fg, count(*) FILTER (kind LIKE 'background%') AS bg,
      min_by(kind, ordinal) FILTER (kind LIKE 'foreground%') AS ff, min_by(kind, ordinal) FILTER (kind LIKE 'background%') AS fb,
      count(*) FILTER (kind = 'foreground_completed') AS done, count(*) FILTER (kind = 'background_started') AS sts,
      count(*) FILTER (kind = 'notification' AND ordinal > st) AS notes, min(ordinal) FILTER (kind = 'notification' AND ordinal > st) AS na,
      max(ordinal) FILTER (kind LIKE 'background%') AS lb FROM started GROUP BY ALL),
kids AS (SELECT session_ref, child_id, (fg = 0 OR (ff = 'foreground_completed' AND done = 1)) AND (bg = 0 OR coalesce(fb = 'background_started' AND sts = 1 AND notes = 1 AND na > lb, false))
      AND (fg = 0 OR bg = 0) AS closed FROM facts WHERE fg + bg > 0)"""


@query(
    "task_children_closed",
    f"WITH {_CHILDREN} SELECT * FROM kids",
)
def task_children_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("child_id"),
        F.col("event_id").alias("ordinal"), mapping[F.col("event_type")].alias("kind"),
    )
    return G.task_children_closed(rows)


@query("task_sessions_closed", f"WITH {_CHILDREN} SELECT session_ref, bool_and(closed) AS closed, count(*) AS children FROM kids GROUP BY 1")
def task_sessions_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.task_sessions_closed(task_children_closed(spark, sf_dir))


@query(
    "tool_output_owner",
    """WITH refs AS (SELECT CASE WHEN event_type = 'error' THEN '/tmp/out/' ELSE '/store/out/' END || (event_id % 6000) AS path, 'u' || (user_id % 50) AS s, event_id FROM events),
    files AS (SELECT DISTINCT '/store/out/' || (event_id % 6000) AS path FROM events WHERE (event_id % 6000) % 4 <> 0)
    SELECT path, CASE WHEN NOT starts_with(path, '/store/out/') THEN 'unclassified' WHEN min(s) <> max(s) THEN 'ambiguous'
      WHEN path NOT IN (SELECT path FROM files) THEN 'unavailable' ELSE 'owned' END AS status,
      CASE WHEN starts_with(path, '/store/out/') AND min(s) = max(s) THEN min(s) ELSE '' END AS owner FROM refs GROUP BY path""",
)
def tool_output_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 6000
    base = table(spark, sf_dir, "events")
    refs = base.select(
        F.concat(F.when(F.col("event_type") == "error", "/tmp/out/").otherwise("/store/out/"), e).alias("path"),
        F.concat(F.lit("u"), F.col("user_id") % 50).alias("session_ref"),
    )
    files = base.filter(e % 4 != 0).select(F.concat(F.lit("/store/out/"), e).alias("path"))
    rows = G.tool_output_owner(refs, files, "/store/out")
    return rows.withColumn("owner", F.coalesce("owner", F.lit("")))


@query(
    "result_file_binding",
    """WITH calls AS (SELECT 'c' || (event_id // 11) AS call_id, 't' || (user_id % 4) AS transcript FROM events WHERE event_type IN ('view', 'signup')),
    refs AS (SELECT 'c' || (event_id // 11) AS call_id, 't' || (user_id % 4) AS transcript, 'f' || (event_id // 13) AS file FROM events WHERE event_type IN ('click', 'error')),
    files AS (SELECT DISTINCT 'f' || (event_id // 13) AS file FROM events WHERE event_type = 'purchase')
    SELECT 'call_repeated' AS violation, call_id AS subject FROM calls GROUP BY call_id HAVING count(*) > 1
    UNION ALL SELECT 'result_repeated', call_id FROM refs GROUP BY call_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'result_without_call', call_id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.call_id = r.call_id AND c.transcript = r.transcript)
    UNION ALL SELECT 'file_shared', file FROM refs GROUP BY file HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'file_missing', file FROM refs WHERE file NOT IN (SELECT file FROM files)
    UNION ALL SELECT DISTINCT 'file_unreferenced', file FROM files WHERE file NOT IN (SELECT file FROM refs)""",
)
def result_file_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events")
    call = F.concat(F.lit("c"), F.expr("event_id div 11")).alias("call_id")
    side = F.concat(F.lit("t"), F.col("user_id") % 4).alias("transcript")
    file = F.concat(F.lit("f"), F.expr("event_id div 13")).alias("file")
    return G.result_file_binding(
        base.filter("event_type IN ('view', 'signup')").select(call, side), base.filter("event_type IN ('click', 'error')").select(call, side, file),
        base.filter("event_type = 'purchase'").select(file).distinct(),
    )


@query(
    "subagent_bundle",
    """WITH t AS (SELECT DISTINCT 's' || (user_id % 20) AS session_ref, 'a' || (event_id // 9) AS agent_id FROM events WHERE event_type = 'view'),
    m AS (SELECT 's' || (user_id % 20) AS session_ref, 'a' || (event_id // 9) AS agent_id, min('u' || (event_id // 7)) AS tool_use_id, min('/w/' || (event_id % 5)) AS cwd
      FROM events WHERE event_type = 'click' GROUP BY 1, 2),
    uses AS (SELECT 's' || (user_id % 20) AS session_ref, 'u' || (event_id // 7) AS tool_use_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
    SELECT coalesce(t.session_ref, m.session_ref) AS session_ref, coalesce(t.agent_id, m.agent_id) AS agent_id,
      CASE WHEN t.agent_id IS NULL THEN 'transcript_missing' WHEN m.agent_id IS NULL THEN 'metadata_missing' WHEN coalesce(u.n, 0) <> 1 THEN 'tool_use_not_unique'
        WHEN m.cwd NOT IN ('/w/0', '/w/1', '/w/2') THEN 'directory_not_allowed' ELSE 'ok' END AS status
    FROM t FULL JOIN m USING (session_ref, agent_id) LEFT JOIN uses u ON u.session_ref = m.session_ref AND u.tool_use_id = m.tool_use_id""",
)
def subagent_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").select(
        "event_type", F.concat(F.lit("s"), F.col("user_id") % 20).alias("session_ref"), F.concat(F.lit("a"), F.expr("event_id div 9")).alias("agent_id"),
        F.concat(F.lit("u"), F.expr("event_id div 7")).alias("tool_use_id"), F.concat(F.lit("/w/"), F.col("event_id") % 5).alias("cwd"),
    )
    transcripts = base.filter("event_type = 'view'").select("session_ref", "agent_id").distinct()
    metadata = base.filter("event_type = 'click'").groupBy("session_ref", "agent_id").agg(F.min("tool_use_id").alias("tool_use_id"), F.min("cwd").alias("cwd"))
    allowed = base.filter("cwd IN ('/w/0', '/w/1', '/w/2')").select("session_ref", "cwd").distinct()
    return G.subagent_bundle(transcripts, metadata, base.filter("event_type <> 'error'").select("session_ref", "tool_use_id"), allowed)


@query(
    "event_closed",
    """WITH m AS (SELECT 'u' || user_id AS session_ref, 'm' || event_id AS message_id, event_id AS seq, event_id * 10 AS "at", 'text' || (event_id % 5) AS text FROM events WHERE event_type = 'view'),
    l AS (SELECT 'u' || user_id AS session_ref, 'm' || event_id AS message_id, 'start' AS kind, event_id - 1 AS seq, event_id * 10 - event_id % 3 AS "at", 'auto' AS reason FROM events WHERE event_id % 7 <> 0),
    e AS (SELECT 'u' || user_id AS session_ref, 'm' || event_id AS message_id, event_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS seq, event_id * 10 AS "at",
      CASE WHEN event_id % 11 = 0 THEN 'manual' ELSE 'auto' END AS reason, 'text' || (event_id % 5) AS text FROM events WHERE event_id % 13 <> 0)
    SELECT m.session_ref, m.message_id, coalesce(l.seq < e.seq AND l."at" <= e."at" AND l.reason = e.reason AND e.seq = m.seq AND e."at" = m."at" AND e.text = m.text, false) AS closed
    FROM m LEFT JOIN l USING (session_ref, message_id) LEFT JOIN e USING (session_ref, message_id)""",
)
def event_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    base = table(spark, sf_dir, "events").withColumn("session_ref", F.concat(F.lit("u"), "user_id")).withColumn("message_id", F.concat(F.lit("m"), i))
    text = F.concat(F.lit("text"), i % 5).alias("text")
    messages = base.filter("event_type = 'view'").select("session_ref", "message_id", i.alias("seq"), (i * 10).alias("at"), text)
    starts = base.filter(i % 7 != 0).select(
        "session_ref", "message_id", F.lit("start").alias("kind"), (i - 1).alias("seq"), (i * 10 - i % 3).alias("at"), F.lit("auto").alias("reason"), F.lit(None).cast("string").alias("text")
    )
    ends = base.filter(i % 13 != 0).select(
        "session_ref", "message_id", F.lit("end").alias("kind"), (i + F.when(i % 10 == 0, 1).otherwise(0)).alias("seq"), (i * 10).alias("at"),
        F.when(i % 11 == 0, "manual").otherwise("auto").alias("reason"), text,
    )
    return G.event_closed(messages, starts.unionByName(ends))


@query(
    "status_rollup",
    """SELECT 'u' || user_id AS session_ref, CASE max(CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 31 = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'present' WHEN 1 THEN 'unknown' ELSE 'empty' END AS status
    FROM events GROUP BY user_id""",
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), F.when(i % 97 == 0, "present").when(i % 31 == 0, "unknown").otherwise("empty").alias("status")
    )
    return G.status_rollup(rows)


@query(
    "attach_results",
    """WITH b AS (SELECT 'u' || (user_id % 30) AS session_ref, 'c' || (event_id // 40) AS call_id, event_type, user_id, event_id FROM events),
    main AS (SELECT session_ref, call_id, count(*) AS n FROM b WHERE event_type IN ('view', 'signup') AND event_id % 6 <> 0 GROUP BY ALL),
    live AS (SELECT session_ref, call_id, count(*) AS n, bool_or(event_id % 9 = 0) AS taken FROM b WHERE event_type IN ('click', 'error') GROUP BY ALL),
    known AS (SELECT session_ref, call_id, count(*) AS n FROM b WHERE event_type IN ('click', 'error', 'purchase') GROUP BY ALL)
    SELECT m.session_ref, CASE WHEN m.n <> 1 THEN 'unmaterialised' WHEN coalesce(l.n, 0) = 0 AND m.session_ref IN (SELECT session_ref FROM b WHERE user_id % 3 = 0) AND coalesce(k.n, 0) = 1 THEN 'inactive'
      WHEN coalesce(l.n, 0) <> 1 OR l.taken THEN 'unmaterialised' ELSE 'materialised' END AS outcome, sum(m.n)::BIGINT AS n
    FROM main m LEFT JOIN live l USING (session_ref, call_id) LEFT JOIN known k USING (session_ref, call_id) GROUP BY 1, 2
    UNION ALL SELECT session_ref, 'private', count(*) FROM b WHERE event_type IN ('view', 'signup') AND event_id % 6 = 0 GROUP BY 1""",
)
def attach_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 30).alias("session_ref"), F.concat(F.lit("c"), F.expr("event_id div 40")).alias("call_id"),
        "event_type", "user_id", (F.col("event_id") % 6 != 0).alias("in_main"), (F.col("event_id") % 9 == 0).alias("has_resources"),
    )
    return G.attach_results(
        base.filter("event_type IN ('view', 'signup')"), base.filter("event_type IN ('click', 'error')"), base.filter("event_type IN ('click', 'error', 'purchase')"),
        base.filter("user_id % 3 = 0"),
    )
