"""Queries: listing, selection, search, library overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.ids import kind_order
from convhist.functions.text import compact_title
from convhist.operators import catalog as C
from convhist.operators import search as S
from convhist.plans.bindings import ITEMS, SESSIONS, documents, items, sessions, table
from convhist.plans.registry import query

_STATE = "CASE WHEN deleted THEN 'deleted' WHEN archived THEN 'archived' ELSE 'active' END"
_SUMMARY = f"""session_ref, agent, coalesce(nullif(name, ''), title) AS title, context, model, provider, updated_at,
  {_STATE} AS library_state, array_to_string(tags, ',') AS tags"""
_ORDER = "ORDER BY updated_at DESC NULLS LAST, session_ref"


def _joined_tags(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", ","))


@query("list_sessions", f"WITH {SESSIONS} SELECT {_SUMMARY} FROM sessions WHERE {_STATE} = 'active' {_ORDER} LIMIT 50")
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_tags(C.list_sessions(sessions(spark, sf_dir)))


@query(
    "list_sessions_page",
    f"""WITH {SESSIONS} SELECT {_SUMMARY} FROM sessions WHERE agent IN ('event_log', 'record_tree') {_ORDER} LIMIT 20 OFFSET 10""",
)
def list_sessions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir)
    return _joined_tags(C.list_sessions(rows, ["record_tree", "event_log", "event_log"], "all", 10, 20))


@query("view_counts", f"WITH {SESSIONS} SELECT {_STATE} AS view, count(*) AS sessions FROM sessions GROUP BY 1")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy(C.library_state().alias("view")).agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "page_metadata",
    f"""WITH {SESSIONS}, n AS (SELECT count(*) AS total FROM sessions WHERE {_STATE} = 'active')
    SELECT total, 20::BIGINT AS "offset", 30::BIGINT AS "limit", greatest(least(total - 20, 30), 0)::BIGINT AS returned,
      greatest(total - 20 - greatest(least(total - 20, 30), 0), 0)::BIGINT AS remaining,
      CASE WHEN total > 50 THEN 50 ELSE -1 END::BIGINT AS next_offset FROM n""",
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.page_metadata(C.visible_sessions(sessions(spark, sf_dir)), 20, 30)
    return rows.withColumn("next_offset", F.coalesce("next_offset", F.lit(-1).cast("bigint")))


@query("summary_projection", f"WITH {SESSIONS} SELECT {_SUMMARY} FROM sessions")
def summary_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_tags(C.summaries(sessions(spark, sf_dir)))


@query(
    "show_session",
    f"""WITH {SESSIONS} SELECT i.session_ref, s.name AS library_name, i.ordinal, i.kind, i.role, i.text
    FROM items i JOIN sessions s USING (session_ref) WHERE i.session_ref = 'event_log:000000000012'""",
)
def show_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.show_session(sessions(spark, sf_dir), items(spark, sf_dir), "event_log:000000000012")
    return rows.select("session_ref", "library_name", "ordinal", "kind", "role", "text")


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third existing session, plus a reference past the end for every seventh."""
    refs = sessions(spark, sf_dir).select("session_ref", "conv_id")
    return refs.filter("conv_id % 3 = 0").select("session_ref").unionByName(
        refs.filter("conv_id % 7 = 0").select(F.concat("session_ref", F.lit("x")).alias("session_ref"))
    )


_REQUESTED = """requested AS (SELECT session_ref FROM sessions WHERE conv_id % 3 = 0
  UNION ALL SELECT session_ref || 'x' FROM sessions WHERE conv_id % 7 = 0)"""


@query(
    "select_by_reference",
    f"""WITH {SESSIONS}, {_REQUESTED} SELECT session_ref, true AS found FROM sessions WHERE session_ref IN (SELECT session_ref FROM requested)
    UNION ALL SELECT session_ref, false FROM requested WHERE session_ref NOT IN (SELECT session_ref FROM sessions)""",
)
def select_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, missing = C.select_by_reference(sessions(spark, sf_dir), _requested(spark, sf_dir))
    return found.select("session_ref", F.lit(True).alias("found")).unionByName(missing.withColumn("found", F.lit(False)))


def _workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked workspaces, derived from the sessions: some exact, some parents, some unknown."""
    rows = sessions(spark, sf_dir)
    pick = rows.filter("conv_id % 7 IN (1, 3)").select(F.concat(F.lit("/work/p"), F.col("conv_id") % 7).alias("workspace"))
    odd = rows.filter("conv_id % 7 = 5").select(F.concat(F.lit("/work/./x/../p"), F.col("conv_id") % 7, F.lit("/pkg")).alias("workspace"))
    none = rows.filter("conv_id % 7 = 2").select(F.lit("/work/p").alias("workspace"))
    return pick.unionByName(odd).unionByName(none).distinct()


_WORKSPACES = """workspaces AS (
  SELECT DISTINCT '/work/p' || (conv_id % 7) AS workspace, '/work/p' || (conv_id % 7) AS path FROM sessions WHERE conv_id % 7 IN (1, 3)
  UNION SELECT DISTINCT '/work/./x/../p' || (conv_id % 7) || '/pkg', '/work/p' || (conv_id % 7) || '/pkg' FROM sessions WHERE conv_id % 7 = 5
  UNION SELECT '/work/p', '/work/p')"""


@query(
    "select_by_workspace",
    f"""WITH {SESSIONS}, {_WORKSPACES} SELECT session_ref AS value, 'selected' AS status FROM sessions WHERE context IN (SELECT path FROM workspaces)
    UNION ALL SELECT workspace, 'missing' FROM workspaces WHERE path NOT IN (SELECT context FROM sessions)""",
)
def select_by_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, missing = C.select_by_workspace(sessions(spark, sf_dir), _workspaces(spark, sf_dir))
    return found.select(F.col("session_ref").alias("value"), F.lit("selected").alias("status")).unionByName(
        missing.select(F.col("workspace").alias("value"), F.lit("missing").alias("status"))
    )


@query(
    "sessions_in_tree",
    f"""WITH {SESSIONS}, {_WORKSPACES} SELECT w.workspace, s.session_ref FROM sessions s JOIN workspaces w
    ON s.context = w.path OR starts_with(s.context, w.path || '/')""",
)
def sessions_in_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sessions_in_tree(sessions(spark, sf_dir), _workspaces(spark, sf_dir)).select("workspace", "session_ref")


@query(
    "scope_counts",
    f"""WITH {SESSIONS}, {_WORKSPACES}, marked AS (SELECT s.*, EXISTS (SELECT 1 FROM workspaces w
      WHERE s.context = w.path OR starts_with(s.context, w.path || '/')) AS scoped, updated_at >= TIMESTAMP '2026-01-02 12:00:00' AS late FROM sessions s)
    SELECT count(*) FILTER (NOT deleted AND scoped AND late) AS selected, count(*) FILTER (NOT deleted AND NOT scoped) AS outside_scope,
      count(*) FILTER (NOT deleted AND scoped AND NOT late) AS before_since, count(*) FILTER (deleted AND scoped) AS deleted_in_scope FROM marked""",
)
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scope_counts(sessions(spark, sf_dir), "workspace", _workspaces(spark, sf_dir), since="2026-01-02 12:00:00")[1]


@query(
    "scope_sessions",
    f"""WITH {SESSIONS}, {_REQUESTED} SELECT session_ref FROM sessions WHERE NOT deleted AND session_ref IN (SELECT session_ref FROM requested)""",
)
def scope_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scope_counts(sessions(spark, sf_dir), "session", references=_requested(spark, sf_dir))[0].select("session_ref")


@query(
    "source_kinds",
    f"""WITH {SESSIONS} SELECT agent, list_position(['event_log', 'uuid_graph', 'table_store', 'record_tree'], agent)::BIGINT AS kind_order,
    count(*) AS sessions FROM sessions WHERE agent IN ('table_store', 'event_log') GROUP BY 1, 2""",
)
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = C.select_kinds(["table_store", "event_log", "table_store"])
    rows = sessions(spark, sf_dir).filter(F.col("agent").isin(*chosen))
    return rows.groupBy("agent", kind_order(F.col("agent")).alias("kind_order")).agg(F.count(F.lit(1)).alias("sessions"))


# -- search ---------------------------------------------------------------------------------------


def _fold_sql(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _hits_sql(needle: str, more: str = "") -> str:
    n = len(needle)
    start = "greatest(found - 121, 0)"
    end = f"least(found - 1 + {n} + 120, length(value))"
    return f"""candidates AS (
      SELECT session_ref, 0 AS p, 0 AS o, 'name' AS field, name AS value FROM sessions
      UNION ALL SELECT session_ref, 0, 1 + u.i, 'tag', tags[u.i] FROM sessions, LATERAL (SELECT unnest(range(1, len(tags) + 1)) AS i) u
      UNION ALL SELECT session_ref, 0, 100, 'title', title FROM sessions
      UNION ALL SELECT session_ref, 0, 101, 'context', context FROM sessions
      UNION ALL SELECT session_ref, 0, 102, 'model', model FROM sessions
      UNION ALL SELECT session_ref, 0, 103, 'session_ref', session_ref FROM sessions
      UNION ALL SELECT session_ref, 1, ordinal * 1000, 'content', CASE WHEN kind = 'gap' THEN label ELSE text END FROM items{more}),
    located AS (SELECT *, strpos({_fold_sql("value")}, '{needle.lower()}') AS found FROM candidates),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY session_ref ORDER BY p, o) AS rn FROM located WHERE found > 0),
    hits AS (SELECT session_ref, field, CASE WHEN {start} = 0 THEN '' ELSE '...' END
        || substr(value, ({start} + 1)::INT, ({end} - {start})::INT) || CASE WHEN {end} = length(value) THEN '' ELSE '...' END AS snippet
      FROM ranked WHERE rn = 1)"""


@query("search_first_hits", f"WITH {SESSIONS}, {_hits_sql('quE')} SELECT * FROM hits")
def search_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_hits(sessions(spark, sf_dir), items(spark, sf_dir), "quE")


@query(
    "search_page",
    f"""WITH {SESSIONS}, {_hits_sql('ReA')} SELECT session_ref, agent, title, updated_at, field, snippet
    FROM sessions JOIN hits USING (session_ref) WHERE {_STATE} = 'active' {_ORDER} LIMIT 50""",
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(C.visible_sessions(sessions(spark, sf_dir)), items(spark, sf_dir), "ReA")


@query("search_miss", f"WITH {SESSIONS}, {_hits_sql('needle-absent')} SELECT session_ref, field, snippet FROM hits")
def search_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_hits(sessions(spark, sf_dir), items(spark, sf_dir), "needle-absent")


@query("search_metadata", f"WITH {SESSIONS}, {_hits_sql('even')} SELECT * FROM hits WHERE field <> 'content'")
def search_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.first_hits(sessions(spark, sf_dir), items(spark, sf_dir), "even")
    return hits.filter("field <> 'content'")


@query("ascii_fold_match", f"SELECT doc_id, strpos({_fold_sql('text')}, 'é') > 0 AS lower_hit, strpos({_fold_sql('text')}, 'É') > 0 AS upper_hit FROM documents")
def ascii_fold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convhist.functions.text import matches

    return documents(spark, sf_dir).select(
        "doc_id", matches(F.col("text"), "é").alias("lower_hit"), matches(F.col("text"), "É").alias("upper_hit")
    )


BLOCK_TYPE = (
    "struct<kind:string,text:string,citations:string,source_role:string,event:string,reason:string,source_kind:string,"
    "summary:array<string>,tool:struct<call_id:string,name:string,namespace:string,status:string,input:string,output:string,"
    "error:string,resources:array<struct<name:string,media_type:string,source_reference:string,relative_path:string,sha256:string>>,"
    "references:array<struct<type:string,namespace:string,locator:string,title:string,context:string,citations:string>>>,"
    "resource:struct<name:string,media_type:string,source_reference:string,relative_path:string,sha256:string>,"
    "reference:struct<type:string,namespace:string,locator:string,title:string,context:string,citations:string>,"
    "work_items:array<struct<id:string,title:string,description:string,active_label:string,assignee:string,priority:string,"
    "status:string,blocks:array<string>,blocked_by:array<string>>>>"
)


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a wide content block: one kind per event type."""
    doc = F.to_json(
        F.when(F.col("event_type") == "view", F.struct(
            F.lit("tool").alias("kind"),
            F.struct(F.concat(F.lit("c"), F.col("event_id")).alias("call_id"), F.lit("grep").alias("name"), F.lit("").alias("namespace"),
                     F.col("props").alias("input"), F.lit("done").alias("output")).alias("tool"),
        ))
    )
    other = F.to_json(F.struct(
        F.when(F.col("event_type") == "click", "reference").when(F.col("event_type") == "purchase", "event")
        .when(F.col("event_type") == "signup", "work_state").otherwise("reasoning").alias("kind"),
        F.struct(F.lit("file").alias("type"), F.lit("fs").alias("namespace"), F.concat(F.lit("/f/"), F.col("event_id")).alias("locator")).alias("reference"),
        F.lit("bought").alias("event"), F.concat(F.lit("why "), F.col("event_id")).alias("reason"), F.lit("todo").alias("source_kind"),
        F.array(F.struct(F.concat(F.lit("w"), F.col("event_id")).alias("id"), F.lit("open").alias("status"), F.array(F.lit("b1"), F.lit("b2")).alias("blocks"))).alias("work_items"),
        F.array(F.lit("thought"), F.lit(""), F.col("event_type")).alias("summary"),
    ))
    return table(spark, sf_dir, "events").withColumn("block", F.from_json(F.coalesce(doc, other), BLOCK_TYPE))


@query(
    "block_search_text",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'c' || event_id || '|grep|' || props || '|done'
      WHEN 'click' THEN 'file|fs|/f/' || event_id WHEN 'purchase' THEN 'bought|why ' || event_id
      WHEN 'signup' THEN 'todo|w' || event_id || '|open|b1|b2' ELSE 'thought|' || event_type END AS texts FROM events""",
)
def block_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_blocks(spark, sf_dir).select("event_id", F.array_join(S.block_search_text(F.col("block")), "|").alias("texts"))


@query(
    "extra_search_text",
    f"""WITH {ITEMS} SELECT session_ref, value, min(ordinal) AS position FROM (
      SELECT session_ref, ordinal, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS value FROM items) WHERE value <> '' GROUP BY 1, 2""",
)
def extra_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extra_search_text(items(spark, sf_dir))


# -- library --------------------------------------------------------------------------------------


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir).filter("conv_id % 4 = 1")
    return rows.select(
        "session_ref", F.concat(F.lit("Overlay "), "conv_id").alias("name"), F.array(F.lit("kept")).alias("tags"),
        (F.col("conv_id") % 3 == 0).alias("archived"), (F.col("conv_id") % 9 == 0).alias("deleted"),
    )


@query(
    "apply_overlay",
    f"""WITH {SESSIONS} SELECT session_ref, CASE WHEN conv_id % 4 = 1 THEN 'Overlay ' || conv_id ELSE name END AS name,
      CASE WHEN conv_id % 4 = 1 THEN 'kept' ELSE array_to_string(tags, ',') END AS tags,
      CASE WHEN conv_id % 4 = 1 THEN conv_id % 3 = 0 ELSE archived END AS archived,
      CASE WHEN conv_id % 4 = 1 THEN conv_id % 9 = 0 ELSE deleted END AS deleted FROM sessions""",
)
def apply_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.apply_overlay(sessions(spark, sf_dir), _overlay(spark, sf_dir))
    return _joined_tags(rows.select("session_ref", "name", "tags", "archived", "deleted"))


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    op = F.element_at(F.array(*[F.lit(o) for o in ("rename", "tag", "archive", "unarchive", "delete", "undelete", "tag", "rename")]), (c % 8).cast("int") + 1)
    none = F.array().cast("array<string>")
    return sessions(spark, sf_dir).select(
        "session_ref", op.alias("op"),
        F.when(c % 8 == 0, F.concat(F.lit("New "), c)).alias("new_name"),
        F.when(c % 8 == 1, F.array(F.lit("alpha"), F.lit("even"))).when(c % 8 == 6, F.array(F.lit("zeta"))).otherwise(none).alias("add_tags"),
        F.when(c % 8 == 6, F.array(F.when(c % 3 == 0, "zeta").otherwise("even"))).otherwise(none).alias("remove_tags"),
    )


_MUTATED = f"""mutated AS (
  SELECT conv_id, session_ref, name, tags, archived, deleted, ['rename','tag','archive','unarchive','delete','undelete','tag','rename'][conv_id % 8 + 1] AS op,
    CASE WHEN conv_id % 8 = 7 THEN 'invalid_rename' WHEN conv_id % 8 = 6 AND conv_id % 3 = 0 THEN 'invalid_tag'
         WHEN conv_id % 8 IN (2, 3) AND deleted THEN 'conflict_deleted' ELSE '' END AS issue FROM sessions),
applied AS (
  SELECT *, CASE WHEN issue = '' AND conv_id % 8 = 0 THEN 'New ' || conv_id ELSE name END AS name2,
    list_sort(CASE WHEN issue <> '' THEN tags WHEN conv_id % 8 = 1 THEN list_distinct(list_concat(tags, ['alpha', 'even']))
      WHEN conv_id % 8 = 6 THEN list_concat(list_filter(tags, lambda t: t <> 'even'), ['zeta']) ELSE tags END) AS tags2,
    CASE WHEN issue = '' AND conv_id % 8 IN (2, 3) THEN conv_id % 8 = 2 ELSE archived END AS archived2,
    CASE WHEN issue = '' AND conv_id % 8 IN (4, 5) THEN conv_id % 8 = 4 ELSE deleted END AS deleted2 FROM mutated)"""


@query(
    "mutate_library",
    f"""WITH {SESSIONS}, {_MUTATED} SELECT session_ref, op, issue, name2 AS name, array_to_string(tags2, ',') AS tags,
      CASE WHEN deleted2 THEN 'deleted' WHEN archived2 THEN 'archived' ELSE 'active' END AS state,
      CASE WHEN deleted2 THEN CASE WHEN archived2 THEN 'archived' ELSE 'active' END ELSE '' END AS restore_state,
      name <> name2 OR tags <> tags2 OR archived <> archived2 OR deleted <> deleted2 AS changed FROM applied""",
)
def mutate_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = sessions(spark, sf_dir).select("session_ref", "name", "tags", "archived", "deleted")
    rows = C.mutate_library(library, _operations(spark, sf_dir)).withColumn("_v", C.library_view(F.col("after")))
    return rows.select(
        "session_ref", "op", F.coalesce("issue", F.lit("")).alias("issue"), "_v.name", F.array_join("_v.tags", ",").alias("tags"),
        "_v.state", F.coalesce("_v.restore_state", F.lit("")).alias("restore_state"), "changed",
    )


@query(
    "upsert_library",
    f"""WITH {SESSIONS}, {_MUTATED} SELECT session_ref, name2 AS name, array_to_string(tags2, ',') AS tags, archived2 AS archived, deleted2 AS deleted FROM applied""",
)
def upsert_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = sessions(spark, sf_dir).select("session_ref", "name", "tags", "archived", "deleted")
    return _joined_tags(C.upsert_library(library, C.mutate_library(library, _operations(spark, sf_dir))))


@query(
    "valid_library",
    """SELECT doc_id, strlen(text) <= 4096 AND trim(text) = text AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AND lang < source AS valid FROM documents""",
)
def valid_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", C.valid_library(F.col("text"), F.array("lang", "source")).alias("valid"))


@query(
    "compact_title",
    """SELECT doc_id, CASE WHEN length(f) <= 160 THEN f ELSE substr(f, 1, 157) || '...' END AS title FROM (
      SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)""",
)
def compact_title_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", compact_title(F.col("text"), 160).alias("title"))


# Each message has two blocks, a tool or its text and a reference; some sessions bring notes beside their items.
_BLOCK_TEXTS = """blocked AS (SELECT session_ref, ordinal, list_filter(list_concat(
    CASE WHEN ordinal % 3 = 0 THEN ['c' || ordinal, CASE WHEN conv_id % 7 = 0 THEN 'Quarry' || (conv_id % 3) ELSE 'grep' END, 'seen', 'pit.txt', 'at ' || ordinal] ELSE [text] END,
    ['file', 'fs', '/f/' || ordinal, CASE WHEN conv_id % 4 = 1 THEN 'The QUARRY of ' || conv_id END]), lambda x: x IS NOT NULL AND x <> '') AS vals
  FROM items WHERE kind <> 'gap'),
notes AS (SELECT session_ref, ordinal, trim(CASE WHEN conv_id % 5 = 2 THEN '  Quarry note ' || (ordinal % 2) || ' ' ELSE ' ' END) AS note FROM items)"""
_MORE = """
      UNION ALL SELECT session_ref, 1, ordinal * 1000 + u.i, 'content', vals[u.i] FROM blocked, LATERAL (SELECT unnest(range(1, len(vals) + 1)) AS i) u
      UNION ALL SELECT session_ref, 2, min(ordinal), 'content', note FROM notes WHERE note <> '' GROUP BY session_ref, note"""


def _with_blocks(rows: DataFrame) -> DataFrame:
    c, o = F.col("conv_id"), F.col("ordinal")
    tool = F.struct(
        F.concat(F.lit("c"), o).alias("call_id"), F.when(c % 7 == 0, F.concat(F.lit("Quarry"), c % 3)).otherwise("grep").alias("name"),
        F.lit("").alias("namespace"), F.lit("seen").alias("output"), F.array(F.struct(F.lit("pit.txt").alias("name"), F.concat(F.lit("at "), o).alias("source_reference"))).alias("resources"),
    )
    first = F.to_json(F.struct(F.when(o % 3 == 0, "tool").otherwise("text").alias("kind"), F.when(o % 3 == 0, tool).alias("tool"), "text"))
    place = F.struct(
        F.lit("file").alias("type"), F.lit("fs").alias("namespace"), F.concat(F.lit("/f/"), o).alias("locator"),
        F.when(c % 4 == 1, F.concat(F.lit("The QUARRY of "), c)).alias("title"),
    )
    second = F.to_json(F.struct(F.lit("reference").alias("kind"), place.alias("reference")))
    return rows.withColumn("blocks", F.array(F.from_json(first, BLOCK_TYPE), F.from_json(second, BLOCK_TYPE)))


def _notes(rows: DataFrame) -> DataFrame:
    note = F.when(F.col("conv_id") % 5 == 2, F.concat(F.lit("  Quarry note "), F.col("ordinal") % 2, F.lit(" "))).otherwise(" ")
    return S.extra_search_text(rows.select("session_ref", "ordinal", note.alias("text")))


@query("search_blocks", f"WITH {SESSIONS}, {_BLOCK_TEXTS}, {_hits_sql('quarrY', _MORE)} SELECT * FROM hits")
def search_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return S.first_hits(sessions(spark, sf_dir), _with_blocks(rows), "quarrY", _notes(rows))
