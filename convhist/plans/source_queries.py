"""Queries: sources, sinks, scalar functions, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions import ids, paths, text
from convhist.plans.bindings import ITEMS, SESSIONS, documents, items, sessions, table
from convhist.plans.registry import query
from convhist.session import materialize, scratch_path
from convhist.sources import jsonl, snapshots, tables
from convhist.streaming import calls, streams


@query(
    "scan_jsonl",
    """SELECT event_id, CASE WHEN event_id % 100 = 7 THEN 'bad_json' ELSE '' END AS issue, true AS in_order FROM events""",
)
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON lines (every hundredth one broken), written, scanned and numbered."""
    line = F.concat(F.lpad("event_id", 12, "0"), F.lit(" "), F.to_json(F.struct("event_id", "event_type", "props")))
    body = F.substring(line, 14, 1 << 20)
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 100 == 7, F.concat(F.lit("{"), body)).otherwise(body))
    path = scratch_path(spark, "jsonl")
    rows.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    found = jsonl.scan_jsonl(spark, path, policy="note")
    number = F.regexp_extract("line", r'"event_id":(\d+)', 1).cast("bigint")
    from convhist.operators.ordered import previous_row, scan

    ordered = scan(found.withColumn("event_id", number), ["file_path"], "record_no", {"_p": previous_row(F.col("event_id"))})
    good = F.col("_p").isNull() | (F.col("event_id") == F.col("_p.v") + 1)
    return ordered.select("event_id", F.coalesce("issue", F.lit("")).alias("issue"), good.alias("in_order"))


@query(
    "scan_tables",
    """SELECT conv_id::VARCHAR AS session_id, turn AS message_no, row_number() OVER (PARTITION BY conv_id ORDER BY (turn % 3), turn) - 1 AS ordinal FROM conversations""",
)
def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "extract")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("id"), (F.col("turn") % 3).alias("time_created"), F.col("text").alias("data")
    )
    rows.write.parquet(f"{path}/message")
    read = tables.scan_tables(spark, path, ["message"])["message"]
    return tables.ordered_rows(read, "time_created", "id").select("session_id", F.col("id").alias("message_no"), "ordinal")


_U = "'00000000-0000-4000-8000-' || lpad((event_id // 8)::VARCHAR, 12, '0')"
_FILES = f"""files AS (SELECT event_id, 'p' || (user_id % 3) AS project, {_U} AS u, event_id % 12 AS k FROM events),
roles AS (SELECT *, CASE k WHEN 0 THEN 'projects/p0/' || u || '.jsonl' WHEN 1 THEN 'projects/' || project || '/' || u || '/tool-results/r' || event_id || '.txt' WHEN 2 THEN 'projects/' || project || '/' || u || '/subagents/agent-a' || event_id || '.jsonl'
    WHEN 3 THEN 'projects/' || project || '/' || u || '/subagents/agent-a' || event_id || '.meta.json' WHEN 4 THEN 'projects/' || project || '/' || u || '/other/f' || event_id WHEN 5 THEN 'file-history/' || u || '/0123456789abcdef@v' || event_id
    WHEN 6 THEN 'file-history/' || u || '/note' || event_id WHEN 7 THEN 'tasks/' || u || '/' || event_id || '.json' WHEN 8 THEN 'projects/' || project || '/memory/m' || event_id WHEN 9 THEN 'jobs/j' || event_id || '/state.json'
    WHEN 10 THEN 'projects/' || project || '/readme' || event_id ELSE 'tmp/' || event_id END AS relative_path,
  ['main', 'tool-result', 'subagent-transcript', 'subagent-metadata', 'session-sidecar', 'checkpoint-backup', 'checkpoint', 'task-entry', '', 'auxiliary', 'auxiliary', ''][k + 1] AS role FROM files),
classified AS (SELECT relative_path, role, CASE WHEN k IN (0) THEN 'p0' WHEN k BETWEEN 1 AND 4 OR k = 10 THEN project ELSE '' END AS project, CASE WHEN k <= 7 THEN u ELSE '' END AS session_candidate FROM roles WHERE role <> '')"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 12
    u = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.expr("event_id div 8").cast("string"), 12, "0"))
    p = F.concat(F.lit("projects/p"), F.col("user_id") % 3, F.lit("/"))
    c = F.concat
    shapes = [
        c(F.lit("projects/p0/"), u, F.lit(".jsonl")), c(p, u, F.lit("/tool-results/r"), e, F.lit(".txt")), c(p, u, F.lit("/subagents/agent-a"), e, F.lit(".jsonl")),
        c(p, u, F.lit("/subagents/agent-a"), e, F.lit(".meta.json")), c(p, u, F.lit("/other/f"), e), c(F.lit("file-history/"), u, F.lit("/0123456789abcdef@v"), e),
        c(F.lit("file-history/"), u, F.lit("/note"), e), c(F.lit("tasks/"), u, F.lit("/"), e, F.lit(".json")), c(p, F.lit("memory/m"), e),
        c(F.lit("jobs/j"), e, F.lit("/state.json")), c(p, F.lit("readme"), e),
    ]
    path = F.when(F.lit(False), "")
    for index, shape in enumerate(shapes):
        path = path.when(k == index, shape)
    # A listing is a stored table; inlined into every pattern test the derivation would only bloat the plan.
    return materialize(table(spark, sf_dir, "events").select(path.otherwise(c(F.lit("tmp/"), e)).alias("relative_path")))


@query("classify_paths", f"WITH {_FILES} SELECT * FROM classified")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jsonl.classify_paths(_files(spark, sf_dir))
    return rows.select("relative_path", "role", F.coalesce("project", F.lit("")).alias("project"), F.coalesce("session_candidate", F.lit("")).alias("session_candidate"))


@query(
    "assign_sidecars",
    f"""WITH {_FILES}, m AS (SELECT * FROM classified WHERE role = 'main'), s AS (SELECT c.*, m.relative_path AS main_path FROM classified c LEFT JOIN m ON m.session_candidate = c.session_candidate
      AND (c.role IN ('checkpoint', 'checkpoint-backup', 'task-entry') OR c.project = m.project) WHERE c.role NOT IN ('main', 'auxiliary'))
    SELECT relative_path, coalesce(main_path, 'leftover') AS owner FROM s""",
)
def assign_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned, rest = jsonl.assign_sidecars(jsonl.classify_paths(_files(spark, sf_dir)))
    return owned.select("relative_path", F.col("main_path").alias("owner")).unionByName(rest.select("relative_path", F.lit("leftover").alias("owner")))


def _snapshot_root(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "snapshots")
    rows = sessions(spark, sf_dir).select("session_ref", "agent", "title", "conv_id")
    snapshots.write_snapshot(rows.filter("conv_id % 3 <> 0"), root, "snap1", "2026-01-01 00:00:00")
    snapshots.write_snapshot(rows.filter("agent <> 'table_store'"), root, "snap2", "2026-01-02 00:00:00")
    return root


@query(
    "read_current",
    f"WITH {SESSIONS} SELECT session_ref, agent, CASE WHEN agent = 'table_store' THEN 'snap1' ELSE 'snap2' END AS snapshot_id, title FROM sessions WHERE agent <> 'table_store' OR conv_id % 3 <> 0",
)
def read_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.read_current(spark, _snapshot_root(spark, sf_dir)).select("session_ref", "agent", "snapshot_id", "title")


@query("prunable_snapshots", f"WITH {SESSIONS} SELECT DISTINCT agent, 'snap1' AS snapshot_id FROM sessions WHERE agent NOT IN ('table_store', 'event_log')")
def prunable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _snapshot_root(spark, sf_dir)
    pinned = sessions(spark, sf_dir).filter("agent = 'event_log'").select("agent", F.lit("snap1").alias("snapshot_id")).distinct()
    return snapshots.prunable_snapshots(spark, root, pinned)


@query(
    "bundle_roundtrip",
    """SELECT 'o' || doc_id AS object_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, doc_id % 10 = 3 AS damaged FROM documents""",
)
def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bundle")
    docs = documents(spark, sf_dir)
    key = F.concat(F.lit("o"), "doc_id").alias("object_id")
    snapshots.export_bundle(
        sessions(spark, sf_dir).select("session_ref", "agent"), docs.select(key, F.col("text").cast("binary").alias("content")),
        docs.select(F.concat(F.lit("s"), "doc_id").alias("session_ref"), key), path,
    )
    _, objects, _ = snapshots.read_bundle(spark, path)
    number = F.substring("object_id", 2, 20).cast("bigint")
    broken = objects.withColumn("content", F.when(number % 10 == 3, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content")))
    damaged = snapshots.damaged_objects(broken).withColumn("_d", F.lit(True))
    return objects.join(damaged, "object_id", "left").select("object_id", "sha256", "size_bytes", F.coalesce("_d", F.lit(False)).alias("damaged"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Relational extract derived from conversations: sound rows plus planted defects."""
    raw, c, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    s = lambda x: F.concat(F.lit("s"), x)
    heads = raw.select("conv_id").distinct()
    session = heads.select(
        s(c).alias("id"), F.concat(F.lit("p"), c % 8).alias("project_id"),
        F.when(c % 10 == 1, s(c + 1)).when(c % 10 == 2, s(c - 1)).when(c % 10 == 3, s(c)).when(c % 10 == 4, F.lit("none")).when(c % 10 == 5, s(c - 5)).alias("parent_id"),
    )
    message = raw.select(F.concat(s(c), F.lit("m"), t).alias("id"), F.when(c % 17 == 3, F.lit("lost")).otherwise(s(c)).alias("session_id"))
    part = raw.select(
        F.concat(s(c), F.lit("p"), t % 5).alias("id"), F.concat(s(c), F.lit("m"), F.when(t == 2, 99).otherwise(t)).alias("message_id"), F.when(c % 17 == 3, F.lit("lost")).otherwise(s(c)).alias("session_id")
    )
    project = heads.select(F.concat(F.lit("p"), c % 7).alias("id")).distinct()
    return {"project": project, "session": session, "message": message, "part": part}


_TABLES = """heads AS (SELECT DISTINCT conv_id AS c FROM conversations), project AS (SELECT DISTINCT 'p' || (c % 7) AS id FROM heads),
session AS (SELECT 's' || c AS id, 'p' || (c % 8) AS project_id, CASE c % 10 WHEN 1 THEN 's' || (c + 1) WHEN 2 THEN 's' || (c - 1) WHEN 3 THEN 's' || c WHEN 4 THEN 'none' WHEN 5 THEN 's' || (c - 5) END AS parent_id FROM heads),
message AS (SELECT 's' || conv_id || 'm' || turn AS id, CASE WHEN conv_id % 17 = 3 THEN 'lost' ELSE 's' || conv_id END AS session_id FROM conversations),
part AS (SELECT 's' || conv_id || 'p' || (turn % 5) AS id, 's' || conv_id || 'm' || CASE WHEN turn = 2 THEN 99 ELSE turn END AS message_id, CASE WHEN conv_id % 17 = 3 THEN 'lost' ELSE 's' || conv_id END AS session_id FROM conversations)"""


@query(
    "referential_integrity",
    f"""WITH RECURSIVE {_TABLES}, ok AS (SELECT id FROM session WHERE parent_id IS NULL OR parent_id = id OR parent_id NOT IN (SELECT id FROM session) UNION ALL SELECT s.id FROM session s JOIN ok ON s.parent_id = ok.id AND s.id <> ok.id)
    SELECT DISTINCT * FROM (SELECT 'part_id' AS violation, id AS subject FROM part GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'session_project', id FROM session WHERE project_id NOT IN (SELECT id FROM project)
      UNION ALL SELECT 'session_parent', id FROM session WHERE parent_id = id OR (parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM session)) UNION ALL SELECT 'session_parent_cycle', id FROM session WHERE id NOT IN (SELECT id FROM ok)
      UNION ALL SELECT 'message_session', id FROM message WHERE session_id NOT IN (SELECT id FROM session)
      UNION ALL SELECT 'part_message', id FROM part p WHERE NOT EXISTS (SELECT 1 FROM message m WHERE m.id = p.message_id AND m.session_id = p.session_id))""",
)
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.referential_integrity(_tables(spark, sf_dir))


@query(
    "copy_filtered",
    f"""WITH {_TABLES}, sel AS (SELECT id, project_id FROM session WHERE substr(id, 2)::BIGINT % 4 = 1), msg AS (SELECT * FROM message WHERE session_id IN (SELECT id FROM sel))
    SELECT 'session' AS "table", id FROM sel UNION ALL SELECT 'message', id FROM msg UNION ALL SELECT 'part', id FROM (SELECT DISTINCT id FROM part WHERE session_id IN (SELECT id FROM sel) OR message_id IN (SELECT id FROM msg))
    UNION ALL SELECT 'project', id FROM project WHERE id IN (SELECT project_id FROM sel)""",
)
def copy_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _tables(spark, sf_dir)
    wanted = source["session"].filter(F.substring("id", 2, 20).cast("bigint") % 4 == 1)
    copies = tables.copy_filtered(source, wanted)
    parts = [rows.select(F.lit(name).alias("table"), "id") for name, rows in copies.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "merge_datasets",
    """WITH a AS (SELECT doc_id AS id, lang, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'xx' ELSE lang END, source FROM documents WHERE doc_id % 3 = 0),
    k AS (SELECT id, count(DISTINCT (lang, source)) AS n, min(lang) AS lang, min(source) AS source FROM a GROUP BY id)
    SELECT id, CASE WHEN n > 1 THEN 'conflict' ELSE lang END AS lang, CASE WHEN n > 1 THEN '' ELSE source END AS source FROM k""",
)
def merge_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = documents(spark, sf_dir)
    one = docs.filter(d % 2 == 0).select(d.alias("id"), "lang", "source")
    two = docs.filter(d % 3 == 0).select(d.alias("id"), F.when((d % 5 == 0) & (d % 2 == 0), "xx").otherwise(F.col("lang")).alias("lang"), "source")
    merged, clash = tables.merge_datasets([one, two], ["id"])
    return merged.unionByName(clash.select("id", F.lit("conflict").alias("lang"), F.lit("").alias("source")))


@query(
    "align_schema",
    """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'target' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN 7 ELSE 0 END::BIGINT AS version, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE '' END AS note FROM documents""",
)
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    target = docs.filter("id % 4 = 0").select("id", F.lit("target").alias("lang"), F.lit(7).cast("bigint").alias("version"), F.nullif(F.lit("kept"), F.lit("")).alias("note"))
    rows = tables.align_schema(docs, target, "id", {"version": F.lit(0)})
    return rows.withColumn("note", F.coalesce("note", F.lit("")))


# -- scalar functions -----------------------------------------------------------------------------


@query(
    "canonical_digest",
    f"""WITH {ITEMS} SELECT session_ref, ordinal, 'digest1_' || sha256(to_json(struct_pack(code := nullif(code, ''), kind := kind, ordinal := ordinal, text := text))::VARCHAR) AS digest FROM items""",
)
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = dict(text=F.col("text"), kind=F.col("kind"), ordinal=F.col("ordinal"), code=F.nullif(F.col("code"), F.lit("")))
    return items(spark, sf_dir).select("session_ref", "ordinal", ids.canonical_digest("digest1_", **fields).alias("digest"))


def _frame(value: str) -> str:
    return f"unhex(lpad(printf('%x', strlen({value})), 16, '0')) || encode({value})"


@query(
    "session_reference",
    f"""WITH {SESSIONS} SELECT conv_id, agent || ':' || sha256({_frame("'session/1'")} || {_frame("agent")} || {_frame("native_id")}) AS reference FROM sessions""",
)
def session_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("conv_id", ids.session_reference(F.col("agent"), F.col("native_id")).alias("reference"))


@query(
    "reference_kind",
    f"""WITH {SESSIONS}, r AS (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN session_ref WHEN 1 THEN upper(session_ref) WHEN 2 THEN session_ref || '!' ELSE replace(session_ref, ':', '::') END AS ref FROM sessions)
    SELECT conv_id, conv_id % 4 = 0 AS valid, CASE WHEN conv_id % 4 = 0 THEN split_part(ref, ':', 1) ELSE '' END AS kind FROM r""",
)
def reference_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = F.col("conv_id"), F.col("session_ref")
    ref = F.when(c % 4 == 0, r).when(c % 4 == 1, F.upper(r)).when(c % 4 == 2, F.concat(r, F.lit("!"))).otherwise(F.replace(r, F.lit(":"), F.lit("::")))
    return sessions(spark, sf_dir).select("conv_id", ids.valid_reference(ref).alias("valid"), F.coalesce(ids.reference_kind(ref), F.lit("")).alias("kind"))


@query(
    "token_estimate",
    """SELECT doc_id, ceil((length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / 4 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::DOUBLE) * 1.2::DOUBLE)::BIGINT + 16 AS tokens,
    strlen(text)::BIGINT AS bytes FROM documents""",
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.utf8_bytes(F.col("text")).alias("bytes"))


@query(
    "utf8_prefix",
    """SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, (SELECT max(n) FROM generate_series(0, 100) g(n) WHERE strlen(left(text, n::INT)) <= 100)::INT) END AS head, strlen(text) > 100 AS truncated FROM documents""",
)
def utf8_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.utf8_prefix(F.col("text"), 100).alias("head"), text.exceeds(F.col("text"), 100).alias("truncated"))


@query("strip_envelopes", """SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '<<<CONVHIST_HISTORICAL_EVENT_V1>>>{"notice":"other"}<<<END_CONVHIST_HISTORICAL_EVENT_V1>>>' ELSE '' END AS visible FROM documents""")
def strip_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = '<<<CONVHIST_HISTORICAL_EVENT_V1>>>{"notice":"Historical event","source_agent":"event_log"}<<<END_CONVHIST_HISTORICAL_EVENT_V1>>>'
    other = '<<<CONVHIST_HISTORICAL_EVENT_V1>>>{"notice":"other"}<<<END_CONVHIST_HISTORICAL_EVENT_V1>>>'
    body = F.concat(F.lit(valid), F.col("text"), F.lit(valid), F.when(F.col("doc_id") % 3 == 0, F.lit("\n" + other)).otherwise(""))
    # White space before the closing envelope is inner white space only where something follows it.
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(valid), text.trim_space(F.col("text")), F.lit(valid + "\n" + other))).otherwise(body)
    return documents(spark, sf_dir).select("doc_id", text.strip_envelopes(body).alias("visible"))


@query(
    "content_text",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'said ' || event_id WHEN 'click' THEN 'mused' || chr(10) || '[Tool call: grep]' WHEN 'purchase' THEN '[Image: image/png]' WHEN 'signup' THEN 'said ' || event_id || chr(10) || 'mused' ELSE '' END AS content,
    CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'thinking,toolCall' WHEN 'purchase' THEN 'image' WHEN 'signup' THEN 'text,thinking' ELSE 'video' END AS kinds FROM events""",
)
def content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    said = F.concat(F.lit('{"type":"text","text":"said '), "event_id", F.lit('"}'))
    mused, tool, image = F.lit('{"type":"thinking","thinking":"mused"}'), F.lit('{"type":"toolCall","name":"grep"}'), F.lit('{"type":"image","mimeType":"image/png"}')
    parts = F.when(t == "view", F.array(said)).when(t == "click", F.array(mused, tool)).when(t == "purchase", F.array(image, image)).when(t == "signup", F.array(said, mused)).otherwise(F.array(F.lit('{"type":"video"}')))
    parts = F.when(t == "purchase", F.array(image)).otherwise(parts)
    blocks = F.from_json(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")), text.CONTENT_BLOCKS)
    return table(spark, sf_dir, "events").select("event_id", text.content_text(blocks).alias("content"), F.array_join(text.content_kinds(blocks), ",").alias("kinds"))


@query("epoch_time", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ts ELSE make_timestamp((1700000000 + event_id) * 1000000) END AS from_seconds, make_timestamp((1700000000123 + event_id) * 1000) AS from_millis FROM events")
def epoch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    seconds = F.when(e % 9 != 0, e + 1_700_000_000)
    return table(spark, sf_dir, "events").select(
        "event_id", ids.epoch_time(seconds, False, F.col("ts")).alias("from_seconds"), ids.epoch_time(e + 1_700_000_000_123, True, F.col("ts")).alias("from_millis")
    )


@query(
    "path_identity",
    """SELECT event_id, '/home/u' || user_id || '/w' || (event_id % 5) AS posix, 'c:\\home\\u' || user_id || '\\w' || (event_id % 5) AS windows,
    CASE WHEN event_id % 5 = 2 THEN '' WHEN event_id % 5 = 1 THEN 'w1' ELSE 'none' END AS below FROM events""",
)
def path_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    user = F.concat(F.lit("u"), "user_id")
    posix = F.concat(F.lit("//home/./x/../"), user, F.lit("/w"), e % 5)
    windows = F.concat(F.when(e % 2 == 0, "\\\\?\\C:\\").otherwise("C:/"), F.lit("Home\\.\\"), F.upper(user), F.lit("/W"), e % 5)
    clean = paths.path_identity(posix)
    root = F.when(e % 5 == 2, clean).when(e % 5 == 1, F.concat(F.lit("/home/"), user)).otherwise("/home/u")
    below = F.coalesce(F.array_join(paths.relative_segments(clean, root), "/"), F.lit("none"))
    return table(spark, sf_dir, "events").select("event_id", clean.alias("posix"), paths.path_identity(windows, True).alias("windows"), below.alias("below"))


@query(
    "cursor_roundtrip",
    f"""WITH {SESSIONS}, r AS (SELECT conv_id, session_ref || '/é' || conv_id AS v FROM sessions) SELECT conv_id, 'cursor1_' || translate(replace(base64(encode(v)), '=', ''), '+/', '-_') AS cursor, v AS decoded, '' AS broken FROM r""",
)
def cursor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat("session_ref", F.lit("/é"), "conv_id")
    cursor = ids.encode_cursor(value)
    return sessions(spark, sf_dir).select(
        "conv_id", cursor.alias("cursor"), ids.decode_cursor(cursor).alias("decoded"), F.coalesce(ids.decode_cursor(F.concat(cursor, F.lit("*"))), F.lit("")).alias("broken")
    )


@query(
    "resource_checks",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pic' || page_id || '.png' WHEN 1 THEN 'attachment.jpg' WHEN 2 THEN 'b' || page_id ELSE 'attachment.bin' END AS name, page_id % 5 <> 0 AS media_ok,
    page_id % 3 <> 0 AS valid FROM pages""",
)
def resource_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    filename = F.when(p % 4 == 0, F.concat(F.lit("C:\\dir\\pic"), p, F.lit(".png"))).when(p % 4 == 1, "..").when(p % 4 == 2, F.concat(F.lit("a/b"), p)).otherwise("bad\u0007name")
    media = F.when(p % 4 == 1, "image/jpeg").otherwise("application/x-thing")
    name = paths.resource_name(filename, media)
    sha = F.sha2("html", 256)
    valid = paths.valid_resource(
        F.when(p % 6 == 0, F.upper(sha)).otherwise(sha), F.octet_length("html"), media, name, F.when(p % 6 == 3, "").otherwise(F.col("url")), paths.resource_path(sha, name)
    )
    declared = F.when(p % 5 == 0, "text plain").otherwise("text/plain; charset=utf-8")
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), paths.valid_media_type(declared).alias("media_ok"), valid.alias("valid"))


@query(
    "canonical_base64",
    """SELECT page_id, page_id % 4 = 0 AS plain_ok, page_id % 4 <> 3 AS uri_ok, CASE WHEN page_id % 4 <> 3 THEN strlen(html) ELSE -1 END::BIGINT AS size FROM pages""",
)
def canonical_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    encoded = F.regexp_replace(F.base64(F.col("html").cast("binary")), r"[\r\n]", "")
    broken = F.when(p % 4 == 0, encoded).when(p % 4 == 1, F.concat(encoded, F.lit("\n"))).when(p % 4 == 2, "").otherwise("@@@@")
    uri = F.concat(F.lit("data:text/html;base64,"), F.when(p % 4 == 3, F.lit("@@")).otherwise(encoded))
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.canonical_base64(broken).isNotNull().alias("plain_ok"), paths.data_uri(uri).isNotNull().alias("uri_ok"),
        F.coalesce(F.octet_length(paths.data_uri(uri)["bytes"]), F.lit(-1)).cast("bigint").alias("size"),
    )


@query(
    "evidence_references",
    """SELECT page_id, page_id % 4 <> 3 AND page_id % 5 <> 0 AND NOT (page_id % 4 = 0 AND page_id % 7 = 0) AS valid FROM pages""",
)
def evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    kind = F.when(p % 4 == 0, "file").when(p % 4 == 1, "document").when(p % 4 == 2, "image").otherwise("link")
    kind = F.when((p % 4 == 2) & (p % 7 == 0), "document").otherwise(kind)
    space = F.when(p % 5 == 0, "Web").otherwise("web")
    return table(spark, sf_dir, "pages").select("page_id", paths.valid_evidence_reference(kind, space, F.col("url"), p % 7 == 0).alias("valid"))


@query("quote_lines", "SELECT doc_id, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM documents")
def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.quote_lines(F.col("text")).alias("quoted"))


@query("reminder_line", "SELECT event_id, CASE WHEN event_type = 'view' THEN '#' ELSE '' END || event_id || '. [' || event_type || '] ' || props AS line FROM events")
def reminder_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "task_reminder").otherwise("todo_reminder")
    line = text.reminder_line(kind, F.col("event_id").cast("string"), F.col("event_type"), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


# -- streams --------------------------------------------------------------------------------------


def _instant(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))  # watermarks need an instant: read as UTC


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instant(streams.read_records(spark, sf_dir, table(spark, sf_dir, "events").schema, "parquet", "events.parquet"))


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instant(table(spark, sf_dir, "events"))


def _utc(column: str):
    """Instant back to zone-less UTC, whatever the session's time zone is."""
    return F.convert_timezone(None, F.lit("UTC"), F.col(column).cast("timestamp_ntz")).alias(column)


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = scratch_path(spark, name)
    schema = stream.schema
    streams.append_records(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


@query("stream_records", "SELECT event_id, user_id, event_type FROM events")
def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(spark, _stream(spark, sf_dir).select("event_id", "user_id", "event_type"), "records")


@query("stream_dedupe", "SELECT user_id, event_id // 2 AS record_id, count(*) > 0 AS kept FROM events GROUP BY 1, 2")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("record_id", F.expr("event_id div 2"))
    kept = _drain(spark, streams.dedupe_records(rows, ["user_id", "record_id"]), "dedupe")
    return kept.select("user_id", "record_id", F.lit(True).alias("kept"))


@query(
    "stream_activity",
    """SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS records FROM events GROUP BY 1, 2""",
)
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = lambda rows: streams.activity_windows(rows, ["event_type"])
    emitted = _drain(spark, windows(_stream(spark, sf_dir)), "activity")
    rows = streams.with_open(emitted, _arrived(spark, sf_dir), windows, "window_end")
    return rows.select(_utc("window_start"), "event_type", "records")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g), w AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS e, count(*) AS records FROM r GROUP BY user_id, run)
    SELECT user_id, session_start, records FROM w""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = lambda rows: streams.activity_sessions(rows, ["user_id"])
    emitted = _drain(spark, windows(_stream(spark, sf_dir)), "sessions")
    rows = streams.with_open(emitted, _arrived(spark, sf_dir), windows, "session_end")
    return rows.select("user_id", _utc("session_start"), "records")


_CALLS = """c AS (SELECT 'u' || user_id AS session_ref, event_id AS ordinal, ts, CASE WHEN event_type IN ('view', 'signup') THEN 'call' WHEN event_type IN ('click', 'error') THEN 'result' ELSE 'exchange' END AS phase, 'c' || (json_extract_string(props, '$.k')::BIGINT % 10) AS call_id
  FROM events),
l AS (SELECT *, lag(phase) OVER (PARTITION BY session_ref, call_id ORDER BY ordinal) AS pp, row_number() OVER (PARTITION BY session_ref, call_id ORDER BY ordinal DESC) AS back FROM c WHERE phase <> 'exchange')"""


@query(
    "stream_pair_tools",
    f"""WITH {_CALLS} SELECT session_ref, ordinal, call_id, 'paired' AS outcome FROM l WHERE phase = 'result' AND pp = 'call' UNION ALL SELECT session_ref, ordinal, call_id, 'paired' FROM c WHERE phase = 'exchange'
    UNION ALL SELECT session_ref, ordinal, call_id, CASE WHEN ts < (SELECT max(ts) FROM c) - INTERVAL 1 DAY THEN 'unanswered' ELSE 'open' END FROM l WHERE back = 1 AND phase = 'call'""",
)
def stream_pair_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, blank = F.col("event_type"), F.lit("")
    phase = F.when(kind.isin("view", "signup"), "call").when(kind.isin("click", "error"), "result").otherwise("exchange")
    rows = _stream(spark, sf_dir).select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), F.col("event_id").alias("ordinal"), phase.alias("phase"),
        F.concat(F.lit("c"), F.get_json_object("props", "$.k").cast("bigint") % 10).alias("call_id"),
        *[blank.alias(c) for c in ("name", "namespace", "status", "input", "output", "error")], "ts",
    )
    root = scratch_path(spark, "pairs")
    streams.pair_tools_stream(rows, root, f"{root}/checkpoint").awaitTermination()
    read = lambda name, outcome: spark.read.parquet(f"{root}/{name}").select("session_ref", "ordinal", "call_id", F.lit(outcome).alias("outcome"))
    return read("paired", "paired").unionByName(read("unanswered", "unanswered")).unionByName(read("open", "open"))


_TIMED = """c AS (SELECT 'u' || user_id AS session_ref, event_id AS ordinal, ts, CASE WHEN event_type IN ('view', 'signup') THEN 'call' WHEN event_type IN ('click', 'error') THEN 'result' ELSE 'exchange' END AS phase, 'c' || (json_extract_string(props, '$.k')::BIGINT % 10) AS call_id FROM events),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM c),
l AS (SELECT *, lag(phase) OVER o AS pp, lag(ts) OVER o AS pt, lead(ts) OVER o AS nt FROM c, w WHERE phase <> 'exchange' AND ts <= mark WINDOW o AS (PARTITION BY session_ref, call_id ORDER BY ts, ordinal))"""


@query(
    "stream_pair_calls",
    f"""WITH {_TIMED} SELECT session_ref, ordinal, call_id, 'paired' AS outcome FROM c WHERE phase = 'exchange'
    UNION ALL SELECT session_ref, ordinal, call_id, 'paired' FROM l WHERE phase = 'result' AND pp = 'call' AND ts < pt + INTERVAL 1 DAY
    UNION ALL SELECT session_ref, ordinal, call_id, CASE WHEN nt IS NOT NULL OR ts + INTERVAL 1 DAY <= mark THEN 'unanswered' ELSE 'open' END FROM l WHERE phase = 'call' AND (nt IS NULL OR nt >= ts + INTERVAL 1 DAY)
    UNION ALL SELECT session_ref, ordinal, call_id, 'waiting' FROM c, w WHERE phase <> 'exchange' AND ts > mark""",
)
def stream_pair_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, blank = F.col("event_type"), F.lit("")
    phase = F.when(kind.isin("view", "signup"), "call").when(kind.isin("click", "error"), "result").otherwise("exchange")
    rows = _stream(spark, sf_dir).select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), F.col("event_id").alias("ordinal"), phase.alias("phase"),
        F.concat(F.lit("c"), F.get_json_object("props", "$.k").cast("bigint") % 10).alias("call_id"),
        *[blank.alias(c) for c in ("name", "namespace", "status", "input", "output", "error")], "ts",
    )
    root = scratch_path(spark, "calls")
    paired = calls.pair_calls(rows)
    with calls.state_store(spark):
        streams.append_records(paired, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    emitted = spark.read.schema(paired.schema).parquet(f"{root}/out")
    held = calls.unfinished(spark, f"{root}/checkpoint").withColumnRenamed("held", "outcome")
    return emitted.select("session_ref", "ordinal", "call_id", "outcome").unionByName(held.select("session_ref", "ordinal", "call_id", "outcome"))
