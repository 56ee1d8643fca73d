"""Queries: transfer planning and conversion accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.ids import conversion_key, derived_uuid
from convhist.operators import conversion as N
from convhist.operators import transfer as M
from convhist.operators.assembly import coalesce_runs, same_role_runs
from convhist.plans.beats_queries import duck_digest
from convhist.plans.bindings import EDGES, ITEMS, SESSIONS, items, pick, session_edges, sessions, table
from convhist.plans.catalog_queries import event_blocks
from convhist.plans.graph_queries import _EXPORT, export_inputs
from convhist.plans.registry import query


def _plan(spark: SparkSession, sf_dir: str):
    nodes, edges, owned = export_inputs(spark, sf_dir)
    return M.plan_export(nodes.filter("conv_id % 2 = 0"), nodes, edges, nodes.filter("deleted OR model = ''"), owned)


_KIND = "list_position(['event_log', 'uuid_graph', 'table_store', 'record_tree'], {})::BIGINT"


@query("plan_export", f"WITH RECURSIVE {SESSIONS}, {EDGES}, {_EXPORT} SELECT agent, {_KIND.format('agent')} AS kind_order, count(*) AS sessions FROM sessions WHERE session_ref IN (SELECT session_ref FROM exported) GROUP BY 1, 2")
def plan_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1]


@query(
    "selection_catalog",
    f"WITH RECURSIVE {SESSIONS}, {EDGES}, {_EXPORT} SELECT session_ref, agent, coalesce(nullif(name, ''), title) AS title, context, {_KIND.format('agent')} AS kind_order FROM sessions WHERE session_ref IN (SELECT session_ref FROM exported)",
)
def selection_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, skipped = _plan(spark, sf_dir)
    return M.selection_catalog(entries, skipped)[0]


_CURSOR = "'cursor1_' || translate(replace(base64(encode(session_ref)), '=', ''), '+/', '-_')"


@query(
    "inspect_bundle",
    f"""WITH {SESSIONS}, page AS (SELECT session_ref, agent, context, row_number() OVER (ORDER BY session_ref) AS n, count(*) OVER () AS total FROM sessions WHERE session_ref > 'record_tree:000000000003')
    SELECT session_ref, agent, context, CASE WHEN n = 20 AND total > 20 THEN {_CURSOR} ELSE '' END AS next_cursor FROM page WHERE n <= 20""",
)
def inspect_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = M.inspect_bundle(sessions(spark, sf_dir).select("session_ref", "agent", "context"), 20, "record_tree:000000000003")
    return page.withColumn("next_cursor", F.coalesce("next_cursor", F.lit("")))


@query(
    "workspace_rollup",
    f"""WITH {SESSIONS}, k AS (SELECT DISTINCT context, agent, {_KIND.format('agent')} AS o FROM sessions)
    SELECT s.context, count(*) AS sessions, (SELECT string_agg(agent, ',' ORDER BY o) FROM k WHERE k.context = s.context) AS agents FROM sessions s GROUP BY s.context""",
)
def workspace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.workspace_rollup(sessions(spark, sf_dir))


@query(
    "bundle_violations",
    """WITH e AS (SELECT 's' || (event_id // 2) AS session_ref FROM events WHERE event_type IN ('view', 'click')),
    o AS (SELECT 'o' || (event_id % 5000) AS object_id FROM events WHERE event_type <> 'error'),
    b AS (SELECT 's' || (event_id // 2) AS session_ref, 'o' || (event_id % 4000) AS object_id, CASE WHEN event_id % 3 = 0 THEN 'native' ELSE 'resource' END AS usage FROM events WHERE event_type <> 'purchase')
    SELECT 'session_repeated' AS violation, session_ref AS subject FROM e GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'object_repeated', object_id FROM o GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'object_unreferenced', object_id FROM o WHERE object_id NOT IN (SELECT object_id FROM b) UNION ALL SELECT 'object_mixed', object_id FROM b GROUP BY 2 HAVING count(DISTINCT usage) > 1
    UNION ALL SELECT DISTINCT 'object_missing', object_id FROM b WHERE object_id NOT IN (SELECT object_id FROM o) UNION ALL SELECT DISTINCT 'session_missing', session_ref FROM b WHERE session_ref NOT IN (SELECT session_ref FROM e)""",
)
def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, e = table(spark, sf_dir, "events"), F.col("event_id")
    ref = F.concat(F.lit("s"), F.expr("event_id div 2")).alias("session_ref")
    return M.bundle_violations(
        base.filter("event_type IN ('view', 'click')").select(ref), base.filter("event_type <> 'error'").select(F.concat(F.lit("o"), e % 5000).alias("object_id")),
        base.filter("event_type <> 'purchase'").select(ref, F.concat(F.lit("o"), e % 4000).alias("object_id"), F.when(e % 3 == 0, "native").otherwise("resource").alias("usage")),
    )


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/home/u"), F.col("user_id") % 20, F.lit("/w"), e % 7, F.when(e % 3 == 0, F.concat(F.lit("/../w"), e % 5)).otherwise("/src")).alias("path"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rules derived from the users: two per even user, one of them deeper, one never used."""
    users = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("u")).distinct().filter("u % 2 = 0")
    up = users.select(F.concat(F.lit("/home/u"), "u").alias("source"), F.concat(F.lit("/mnt/u"), "u", F.lit("/")).alias("target"))
    deep = users.select(F.concat(F.lit("/home/u"), "u", F.lit("/w3/")).alias("source"), F.concat(F.lit("/fast/./u"), "u").alias("target"))
    return up.unionByName(deep).unionByName(users.filter("u = 0").select(F.lit("/home/u").alias("source"), F.lit("/none").alias("target")))


_MAPPED = """p AS (SELECT event_id, '/home/u' || (user_id % 20) || '/w' || CASE WHEN event_id % 3 = 0 THEN (event_id % 5)::VARCHAR ELSE (event_id % 7) || '/src' END AS clean,
  user_id % 20 AS u, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE event_id % 7 END AS w FROM events),
m AS (SELECT *, CASE WHEN u % 2 <> 0 THEN clean WHEN w = 3 THEN '/fast/u' || u || substr(clean, length('/home/u' || u || '/w3') + 1) ELSE '/mnt/u' || u || substr(clean, length('/home/u' || u) + 1) END AS mapped,
  CASE WHEN u % 2 <> 0 THEN '' WHEN w = 3 THEN '/home/u' || u || '/w3/' ELSE '/home/u' || u END AS rule_source FROM p)"""


@query("map_paths", f"WITH {_MAPPED} SELECT event_id, mapped, rule_source FROM m")
def map_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.map_paths(_paths(spark, sf_dir), _rules(spark, sf_dir))[0]
    return rows.select("event_id", "mapped", F.coalesce("rule_source", F.lit("")).alias("rule_source"))


@query("unused_mappings", "SELECT '/home/u' AS source WHERE (SELECT count(*) FROM events WHERE user_id % 20 = 0) > 0")
def unused_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.map_paths(_paths(spark, sf_dir), _rules(spark, sf_dir))[1]


@query(
    "check_mappings",
    """WITH r AS (SELECT DISTINCT user_id % 30 AS u FROM events) SELECT '/a/u' || u AS source, 'ambiguous' AS issue FROM r WHERE u % 3 = 0
    UNION ALL SELECT 'a/u' || u, 'not_absolute' FROM r WHERE u % 3 = 1 UNION ALL SELECT '/b/../a/u' || u, 'no_effect' FROM r WHERE u % 3 = 2""",
)
def check_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    users = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("u")).distinct()
    source = F.when(u % 3 == 1, "a/u").when(u % 3 == 2, "/b/../a/u").otherwise("/a/u")
    first = users.select(F.concat(source, u).alias("source"), F.when(u % 3 == 2, F.concat(F.lit("/a/u"), u)).otherwise("/x").alias("target"))
    second = users.filter("u % 3 = 0").select(F.concat(F.lit("/a/u"), u).alias("source"), F.lit("/y").alias("target"))
    fine = users.select(F.concat(F.lit("/ok/u"), u).alias("source"), F.lit("/z").alias("target"))
    return M.check_mappings(first.unionByName(second).unionByName(fine))


@query(
    "workspace_plan",
    f"""WITH {SESSIONS}, m AS (SELECT *, CASE WHEN conv_id % 7 IN (0, 1) THEN '/mnt' || substr(context, 6) WHEN conv_id % 7 = 2 AND conv_id % 3 = 0 THEN '/deep' ELSE context END AS target FROM sessions),
    d AS (SELECT DISTINCT '/mnt/p' || (conv_id % 7) AS path FROM sessions WHERE conv_id % 7 = 0)
    SELECT context AS source, target, CASE WHEN context = target THEN 'unchanged' ELSE 'mapped' END AS status, CASE WHEN target IN (SELECT path FROM d) THEN 'available' ELSE 'missing' END AS availability,
      count(*) AS sessions, (SELECT string_agg(agent, ',' ORDER BY o) FROM (SELECT DISTINCT agent, {_KIND.format('agent')} AS o FROM m x WHERE x.context = m.context)) AS agents FROM m GROUP BY context, target""",
)
def workspace_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir)
    p = F.col("conv_id") % 7
    shallow = rows.filter("conv_id % 7 IN (0, 1)").select(F.concat(F.lit("/work/p"), p).alias("source"), F.concat(F.lit("/mnt/p"), p).alias("target")).distinct()
    deep = rows.filter("conv_id % 7 = 2").select(F.lit("/work/p2/pkg").alias("source"), F.lit("/deep").alias("target")).distinct()
    directories = rows.filter("conv_id % 7 = 0").select(F.concat(F.lit("/mnt/p"), p).alias("path"), F.lit("available").alias("state")).distinct()
    return M.workspace_plan(rows, shallow.unionByName(deep), directories)


@query(
    "classify_import",
    f"""WITH {SESSIONS} SELECT session_ref, CASE WHEN conv_id % 5 IN (1, 2, 3, 4) AND NOT (conv_id % 5 = 1) THEN 'conflict' WHEN conv_id % 5 = 1 THEN 'already_present' ELSE 'new' END AS classification,
      CASE conv_id % 5 WHEN 2 THEN 'session_row_differs' WHEN 3 THEN 'occupied_without_session' WHEN 4 THEN 'partial_or_later_rows' ELSE '' END AS reason FROM sessions""",
)
def classify_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lines = sessions(spark, sf_dir), items(spark, sf_dir)
    c = F.col("conv_id") % 5
    head = rows.select("session_ref", "conv_id", F.lit("session").alias("row_key"), F.concat(F.lit("h"), "title").alias("row_hash"))
    body = lines.select("session_ref", "conv_id", F.col("ordinal").cast("string").alias("row_key"), F.sha2("text", 256).alias("row_hash"))
    target_head = head.filter(c.isin(1, 2, 4)).withColumn("row_hash", F.when(c == 2, "other").otherwise(F.col("row_hash")))
    target_body = body.filter(c.isin(1, 2, 3) | ((c == 4) & (F.col("row_key") == "0")))
    return M.classify_import({"session": head, "item": body}, {"session": target_head, "item": target_body}, "session").select(
        "session_ref", "classification", F.coalesce("reason", F.lit("")).alias("reason")
    )


def _routed(spark: SparkSession, sf_dir: str):
    rows = sessions(spark, sf_dir)
    own = rows.filter("conv_id % 5 = 0").select("session_ref", pick(("event_log", "record_tree"), F.col("conv_id") % 2).alias("target_agent"))
    stray = rows.filter("conv_id % 9 = 0").select(F.concat("session_ref", F.lit("x")).alias("session_ref"), F.lit("event_log").alias("target_agent"))
    return M.route(rows, own.unionByName(stray), None)


_ROUTED = "routed AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'event_log' ELSE 'record_tree' END ELSE agent END AS target_agent FROM sessions)"


@query("route", f"WITH {SESSIONS}, {_ROUTED} SELECT session_ref, target_agent FROM routed UNION ALL SELECT session_ref || 'x', 'unselected' FROM sessions WHERE conv_id % 9 = 0")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed, stray = _routed(spark, sf_dir)
    return routed.select("session_ref", "target_agent").unionByName(stray.withColumn("target_agent", F.lit("unselected")))


# Rule table of the derived codes: code, finding, disposition.
_RULES = [
    ("response.reasoning", "reasoning.omitted", "exact"), ("record.opaque", "record.opaque", "blocked"), ("compaction.marker", "compaction.degraded", "degraded"),
    ("reasoning.omitted", "reasoning.omitted", "exact"), ("tool.partial", "tool.partial", "degraded"), ("citation.unresolved", "citation.skipped", "skipped"),
    ("image.retained", "image.retained", "synthesized"), ("role.system", "role.system.degraded", "degraded"),
]
_RULES_SQL = "rules(code, finding, disposition) AS (VALUES " + ", ".join(str(r) for r in _RULES) + ")"
_FINDINGS = f"""{_RULES_SQL}, codes AS (SELECT session_ref, code FROM items WHERE kind = 'gap' UNION ALL SELECT session_ref, unnest(notes) FROM items
  UNION ALL SELECT session_ref, 'role.' || role FROM items WHERE kind = 'message' AND role NOT IN ('user', 'assistant')),
findings AS (SELECT session_ref, coalesce(r.finding, 'unclassified') AS code, coalesce(r.disposition, 'blocked') AS disposition, count(*) AS n FROM codes c LEFT JOIN rules r USING (code) GROUP BY 1, 2, 3),
statuses AS (SELECT s.session_ref, CASE max(CASE disposition WHEN 'blocked' THEN 2 WHEN 'exact' THEN 0 ELSE 1 END) WHEN 2 THEN 'blocked' WHEN 1 THEN 'degraded' ELSE 'exact' END AS status
  FROM sessions s LEFT JOIN findings f USING (session_ref) GROUP BY 1)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.portable_findings(items(spark, sf_dir), spark.createDataFrame(_RULES, "code string, finding string, disposition string"))


@query("portable_findings", f"WITH {SESSIONS}, {_FINDINGS} SELECT * FROM findings")
def portable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query("merge_findings", f"WITH {SESSIONS}, {_FINDINGS} SELECT code, disposition, sum(n)::BIGINT AS n FROM findings GROUP BY 1, 2")
def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.merge_findings(_findings(spark, sf_dir))


@query("conversion_status", f"WITH {SESSIONS}, {_FINDINGS} SELECT * FROM statuses")
def conversion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.conversion_status(sessions(spark, sf_dir), _findings(spark, sf_dir))


@query("conversion_plan", f"WITH {SESSIONS}, {_FINDINGS} SELECT session_ref, status, CASE status WHEN 'blocked' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END::BIGINT AS rank FROM statuses")
def conversion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.conversion_plan(N.conversion_status(sessions(spark, sf_dir), _findings(spark, sf_dir)))[0]


@query("conversion_counts", f"WITH {SESSIONS}, {_FINDINGS} SELECT count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'exact') AS exact FROM statuses")
def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.conversion_plan(N.conversion_status(sessions(spark, sf_dir), _findings(spark, sf_dir)))[1]


@query(
    "route_summary",
    f"""WITH {SESSIONS}, {_ROUTED}, {_FINDINGS} SELECT agent AS source_agent, target_agent, count(*) AS sessions,
    ['native', 'exact', 'degraded', 'blocked'][max(CASE WHEN agent = target_agent THEN 0 WHEN status = 'exact' THEN 1 WHEN status = 'degraded' THEN 2 ELSE 3 END) + 1] AS quality FROM routed JOIN statuses USING (session_ref) GROUP BY 1, 2""",
)
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return M.route_summary(_routed(spark, sf_dir)[0], N.conversion_status(sessions(spark, sf_dir), found), found)[0]


@query(
    "route_findings",
    f"""WITH {SESSIONS}, {_ROUTED}, {_FINDINGS} SELECT agent AS source_agent, target_agent, code, disposition, sum(n)::BIGINT AS n FROM routed JOIN findings USING (session_ref) WHERE agent <> target_agent GROUP BY 1, 2, 3, 4""",
)
def route_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return M.route_summary(_routed(spark, sf_dir)[0], N.conversion_status(sessions(spark, sf_dir), found), found)[1]


def _imported(spark: SparkSession, sf_dir: str):
    rows, c = sessions(spark, sf_dir), F.col("conv_id")
    done = rows.select("session_ref", pick(("new", "already_present"), c % 2).alias("classification"), (c % 4 == 0).alias("written"))
    places = rows.filter("conv_id % 7 <> 6").select("context", F.concat(F.lit("/t"), "context").alias("target")).distinct()
    return M.import_result(done, rows.filter("conv_id % 10 <> 9"), places)


@query("import_result", f"WITH {SESSIONS} SELECT count(*) AS total, count(*) FILTER (conv_id % 2 = 0) AS new_sessions, count(*) FILTER (conv_id % 4 = 0) AS written, count(*) FILTER (conv_id % 2 = 1) AS already_present FROM sessions")
def import_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(spark, sf_dir)[1]


@query(
    "import_result_items",
    f"""WITH {SESSIONS} SELECT session_ref, '/t' || context AS target FROM sessions WHERE conv_id % 10 <> 9 AND conv_id % 7 <> 6
    UNION ALL SELECT session_ref, 'lost' FROM sessions WHERE conv_id % 10 = 9 OR conv_id % 7 = 6""",
)
def import_result_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, lost = _imported(spark, sf_dir)
    return rows.select("session_ref", "target").unionByName(lost.withColumn("target", F.lit("lost")))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources from the documents: digest of the text, spread over sessions and paths."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), d % 60).alias("session_ref"), F.concat(F.lit("/r/"), d % 300).alias("path"), F.concat(F.lit("/t/"), d - F.when(d % 5 == 4, 1).otherwise(0)).alias("destination"),
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"), "doc_id",
    )


_RES = """res AS (SELECT 's' || (doc_id % 60) AS session_ref, '/r/' || (doc_id % 300) AS path, '/t/' || (doc_id - CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END) AS destination, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, doc_id FROM documents)"""


@query("dedupe_resources", f"WITH {_RES} SELECT sha256, min(size_bytes) AS size_bytes, count(*) AS bindings, 'object-' || substr(sha256, 1, 16) AS object_id FROM res GROUP BY sha256")
def dedupe_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dedupe_resources(_resources(spark, sf_dir))[0]


@query("resource_path_clashes", f"WITH {_RES} SELECT session_ref, path FROM res GROUP BY 1, 2 HAVING count(DISTINCT sha256) > 1")
def resource_path_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dedupe_resources(_resources(spark, sf_dir))[1]


def _target(rows: DataFrame) -> DataFrame:
    """What the receiver has: nothing at every third destination, other bytes at every third."""
    d = F.col("doc_id")
    return rows.filter((d % 5 != 4) & (d % 3 != 0)).select("destination", F.when(d % 3 == 1, F.col("sha256")).otherwise("x").alias("sha256"), "size_bytes")


@query(
    "resource_plan",
    f"""WITH {_RES}, p AS (SELECT destination, count(DISTINCT session_ref) AS sessions, count(DISTINCT sha256) AS k, min(doc_id) AS d FROM res GROUP BY 1)
    SELECT destination, sessions, CASE WHEN k > 1 THEN 'collision' WHEN d % 3 = 0 THEN 'new' WHEN d % 3 = 1 THEN 'already_present' ELSE 'conflict' END AS classification FROM p""",
)
def resource_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resources(spark, sf_dir)
    return M.resource_plan(rows, _target(rows))


@query(
    "resource_closure",
    f"""WITH {_RES}, a AS (SELECT DISTINCT sha256 FROM res WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT sha256 FROM res WHERE doc_id % 3 = 0)
    SELECT sha256, 'missing' AS status FROM a WHERE sha256 NOT IN (SELECT sha256 FROM b) UNION ALL SELECT sha256, 'extra' FROM b WHERE sha256 NOT IN (SELECT sha256 FROM a)""",
)
def resource_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resources(spark, sf_dir)
    return M.resource_closure(rows.filter("doc_id % 2 = 0").select("sha256"), rows.filter("doc_id % 3 = 0").select("sha256"))


@query(
    "batch_ready",
    f"""WITH {SESSIONS}, {_RES} SELECT (SELECT count(*) FROM sessions WHERE conv_id % 5 = 2) AS session_conflicts, (SELECT count(*) FROM res WHERE doc_id % 4 = 1) AS resource_conflicts,
    (SELECT count(*) FROM (SELECT destination FROM res GROUP BY 1 HAVING count(DISTINCT (sha256, size_bytes)) > 1)) AS clashes, false AS ready""",
)
def batch_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = sessions(spark, sf_dir).select(F.when(F.col("conv_id") % 5 == 2, "conflict").otherwise("new").alias("classification"))
    rows = _resources(spark, sf_dir).withColumn("classification", F.when(F.col("doc_id") % 4 == 1, "conflict").otherwise("new"))
    return M.batch_ready(heads, rows)


@query("provider_usage", f"WITH {SESSIONS} SELECT provider, count(*) AS sessions, provider = 'provider1' AS current FROM sessions GROUP BY 1")
def provider_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.provider_usage(sessions(spark, sf_dir), "provider1")


def _unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return sessions(spark, sf_dir).select(
        F.concat(F.lit("s"), c).alias("session_ref"), F.repeat(F.lit("p"), (c % 3 + 1).cast("int")).alias("provider"), F.when(c % 4 != 0, F.concat(F.lit("s"), c - 1)).alias("base_ref"),
        F.when(c % 4 != 0, c * 7 + 92).alias("base_offset"), (F.lit(6) - (c % 3 + 1)).alias("own_delta"),
    )


@query(
    "provider_unify",
    f"""WITH RECURSIVE {SESSIONS}, b AS (SELECT conv_id AS c, repeat('p', (conv_id % 3 + 1)::INT) AS provider, conv_id * 7 + 92 AS off, CASE WHEN conv_id % 3 = 2 THEN 0 ELSE 6 - (conv_id % 3 + 1) END AS own FROM sessions),
    w AS (SELECT c, provider, NULL::BIGINT AS after_offset, own AS delta FROM b WHERE c % 4 = 0
      UNION ALL SELECT b.c, b.provider, b.off + w.delta, b.own + length((b.off + w.delta)::VARCHAR) - length(b.off::VARCHAR) FROM w JOIN b ON b.c = w.c + 1 AND b.c % 4 <> 0)
    SELECT 's' || c AS session_ref, provider AS before, 'ppp' AS "after", provider <> 'ppp' AS changed, coalesce(after_offset, -1) AS after_offset FROM w""",
)
def provider_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.provider_unify(_unify(spark, sf_dir), "ppp").withColumn("after_offset", F.coalesce("after_offset", F.lit(-1)).cast("bigint"))


@query("lineage_levels", f"WITH {SESSIONS} SELECT 's' || conv_id AS session_ref, conv_id % 4 AS depth FROM sessions")
def lineage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lineage_levels(_unify(spark, sf_dir))


@query(
    "consistency_report",
    f"""WITH {SESSIONS} SELECT session_ref, 'row_missing' AS issue FROM sessions WHERE conv_id % 11 = 1 UNION ALL SELECT session_ref, 'file_missing' FROM sessions WHERE conv_id % 11 = 2
    UNION ALL SELECT session_ref, 'provider_disagrees' FROM sessions WHERE conv_id % 11 = 3 UNION ALL SELECT session_ref, 'cwd_disagrees' FROM sessions WHERE conv_id % 11 IN (4, 5)
    UNION ALL SELECT session_ref, 'archived_disagrees' FROM sessions WHERE conv_id % 11 IN (5, 6)""",
)
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m = sessions(spark, sf_dir), F.col("conv_id") % 11
    files = rows.filter(m != 2).select("session_ref", "provider", F.concat("context", F.lit("/./x/..")).alias("cwd"), F.concat("context", F.lit("/log")).alias("path"), "archived")
    table_rows = rows.filter(m != 1).select(
        "session_ref", F.when(m == 3, "none").otherwise(F.col("provider")).alias("provider"), F.when(m.isin(4, 5), "/else").otherwise(F.col("context")).alias("cwd"),
        F.concat("context", F.lit("//log")).alias("path"), F.when(m.isin(5, 6), ~F.col("archived")).otherwise(F.col("archived")).alias("archived"),
    )
    return M.consistency_report(files, table_rows)


@query("resolve_provider", f"WITH {SESSIONS} SELECT session_ref, provider AS preserved, 'provider2' AS current, 'acme' AS explicit FROM sessions")
def resolve_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("provider")
    return sessions(spark, sf_dir).select(
        "session_ref", M.resolve_provider(p, "preserve").alias("preserved"), M.resolve_provider(p, "current", "provider2").alias("current"), M.resolve_provider(p, "explicit", explicit="acme").alias("explicit")
    )


_REWRITE = """r AS (SELECT 'u' || user_id AS session_ref, event_id, event_type = 'signup' AND event_id % 4 = 0 AS hit,
  CASE WHEN event_id % 4 = 0 THEN 'old' ELSE 'own' END AS provider, props FROM events)"""


@query(
    "rewrite_fields",
    f"""WITH {_REWRITE} SELECT session_ref, count(*) FILTER (hit) AS changed, sum(CASE WHEN hit THEN 4 ELSE 0 END)::BIGINT AS byte_delta FROM r GROUP BY 1""",
)
def rewrite_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rewrite_fields(_rewritable(spark, sf_dir), {"provider": ("old_provider", "new_provider")})[1]


@query(
    "rewrite_payloads",
    f"""WITH {_REWRITE} SELECT event_id AS record_no, '{{"extra": {{"provider":"old", "a":1.0}}, "provider" : "' || CASE WHEN hit THEN 'unified' ELSE provider END || '","cwd":"/w","props":' || props || ',"n":12345678901234567890}}' AS payload FROM r""",
)
def rewrite_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that the rewrite doesn't name, nested ones of the same name and numbers keep their bytes."""
    return M.rewrite_fields(_rewritable(spark, sf_dir), {"provider": ("old_provider", "new_provider")})[0].select("record_no", "payload")


def _rewritable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    payload = F.concat(
        F.lit('{"extra": {"provider":"old", "a":1.0}, "provider" : "'), F.when(e % 4 == 0, "old").otherwise("own"), F.lit('","cwd":"/w","props":'), F.col("props"),
        F.lit(',"n":12345678901234567890}'),
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), e.alias("record_no"), F.when(F.col("event_type") == "signup", "session_meta").otherwise("other").alias("type"),
        payload.alias("payload"), F.lit("old").alias("old_provider"), F.lit("unified").alias("new_provider"),
    )


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    base = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("session_ref"), e.alias("item"))
    i = F.col("item")
    before = base.filter("item % 5 <> 4").withColumn("digest", F.concat(F.lit("b"), i))
    after = base.withColumn("digest", F.when(i % 5 == 0, F.concat(F.lit("b"), i)).otherwise(F.concat(F.lit("a"), i)))
    current = base.filter("item % 35 <> 4").withColumn("digest", F.when(i % 7 == 0, F.concat(F.lit("b"), i)).when(i % 197 == 1, "z").otherwise(F.concat(F.lit("a"), i)))
    return M.three_way(before, after, current, ["session_ref", "item"])


_THREE = """pos AS (SELECT 'u' || user_id AS session_ref, event_id AS item, CASE WHEN event_id % 5 <> 4 THEN 'b' || event_id END AS b, CASE WHEN event_id % 5 = 0 THEN 'b' || event_id ELSE 'a' || event_id END AS a,
  CASE WHEN event_id % 35 <> 4 THEN CASE WHEN event_id % 7 = 0 THEN 'b' || event_id WHEN event_id % 197 = 1 THEN 'z' ELSE 'a' || event_id END END AS c FROM events),
states AS (SELECT session_ref, item, CASE WHEN c IS NOT DISTINCT FROM b AND c IS NOT DISTINCT FROM a THEN 'unchanged' WHEN c IS NOT DISTINCT FROM b THEN 'before' WHEN c IS NOT DISTINCT FROM a THEN 'after' ELSE 'diverged' END AS position FROM pos)"""


@query("three_way", f"WITH {_THREE} SELECT * FROM states")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir)


@query(
    "three_way_rollup",
    f"WITH {_THREE} SELECT session_ref, count(*) FILTER (position = 'before') AS n_before, count(*) FILTER (position = 'after') AS n_after, count(*) FILTER (position = 'unchanged') AS n_unchanged, count(*) FILTER (position = 'diverged') AS n_diverged, count(*) FILTER (position = 'diverged') = 0 AS ready FROM states GROUP BY 1",
)
def three_way_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.three_way_rollup(_positions(spark, sf_dir))


@query(
    "shared_dimension",
    f"""WITH {SESSIONS} SELECT 'p' || conv_id AS id, conv_id % 3 = 0 AS from_target, CASE WHEN conv_id % 3 = 0 THEN '/there' WHEN conv_id % 7 = 1 THEN '/mnt' || substr(context, 6) ELSE context END AS path,
    CASE WHEN conv_id % 3 = 0 THEN 'theirs' ELSE 'ours' END AS name, CASE WHEN conv_id % 3 = 0 THEN '["x"]' ELSE '[]' END AS listed FROM sessions""",
)
def shared_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir)
    key = F.concat(F.lit("p"), "conv_id").alias("id")
    ours = rows.select(key, F.col("context").alias("path"), F.lit("ours").alias("name"), F.lit('["/a"]').alias("listed"))
    theirs = rows.filter("conv_id % 3 = 0").select(key, F.lit("/there").alias("path"), F.lit("theirs").alias("name"), F.lit('["x"]').alias("listed"))
    rules = rows.filter("conv_id % 7 = 1").select(F.lit("/work/p1").alias("source"), F.lit("/mnt/p1").alias("target")).distinct()
    return M.shared_dimension(ours, theirs, rules)


@query(
    "merge_state",
    f"""WITH {SESSIONS} SELECT session_ref, CASE WHEN conv_id % 5 = 0 AND conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'conflict' ELSE 'goal' || conv_id END AS goal FROM sessions WHERE conv_id % 2 = 0 OR conv_id % 3 = 0""",
)
def merge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = sessions(spark, sf_dir), F.col("conv_id")
    left = rows.filter("conv_id % 2 = 0").select("session_ref", F.concat(F.lit("goal"), c).alias("goal"))
    right = rows.filter("conv_id % 3 = 0").select("session_ref", F.when((c % 5 == 0) & (c % 2 == 0), "other").otherwise(F.concat(F.lit("goal"), c)).alias("goal"))
    merged, clash = M.merge_state(left, right, "session_ref", ["goal"])
    return merged.unionByName(clash.withColumn("goal", F.lit("conflict")))


# -- conversion -----------------------------------------------------------------------------------


@query(
    "sequence_valid",
    f"""WITH {ITEMS}, m AS (SELECT *, lag(role) OVER w AS pr, last_value(ts IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM items WHERE kind = 'message' WINDOW w AS (PARTITION BY session_ref ORDER BY ordinal))
    SELECT session_ref, CASE WHEN min_by(role, ordinal) <> 'user' THEN 'first_not_user' WHEN max_by(role, ordinal) <> 'assistant' THEN 'last_not_assistant' WHEN bool_or(coalesce(pr = role, false)) THEN 'not_alternating'
      WHEN bool_or(ts IS NULL OR coalesce(ts < pt, false)) THEN 'times_not_monotone' ELSE 'ok' END AS status FROM m GROUP BY 1""",
)
def sequence_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sequence_valid(items(spark, sf_dir).filter("kind = 'message'"))


@query(
    "sequence_valid_merged",
    f"""WITH {ITEMS}, m AS (SELECT *, lag(role) OVER (PARTITION BY session_ref ORDER BY ordinal) AS pr FROM items WHERE kind = 'message'),
    n AS (SELECT *, sum(CASE WHEN role IS DISTINCT FROM pr THEN 1 ELSE 0 END) OVER (PARTITION BY session_ref ORDER BY ordinal) AS run FROM m),
    r AS (SELECT session_ref, run, min(role) AS role, last(ts ORDER BY ordinal) AS ts FROM n GROUP BY 1, 2),
    t AS (SELECT *, last_value(ts IGNORE NULLS) OVER (PARTITION BY session_ref ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM r)
    SELECT session_ref, CASE WHEN min_by(role, run) <> 'user' THEN 'first_not_user' WHEN max_by(role, run) <> 'assistant' THEN 'last_not_assistant'
      WHEN bool_or(ts IS NULL OR coalesce(ts < pt, false)) THEN 'times_not_monotone' ELSE 'ok' END AS status FROM t GROUP BY 1""",
)
def sequence_valid_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = coalesce_runs(same_role_runs(items(spark, sf_dir).filter("kind = 'message'"))).withColumnRenamed("first", "ordinal")
    return N.sequence_valid(merged.select("session_ref", "ordinal", "role", "ts"))


@query(
    "portable_messages",
    """SELECT 'u' || user_id AS session_ref, event_id AS ordinal, 'assistant_only_block' AS text FROM events WHERE event_type IN ('purchase', 'error', 'view') AND event_id % 2 = 0
    UNION ALL SELECT 'u' || user_id, event_id, 'user_only_block' FROM events WHERE event_type = 'signup' AND event_id % 2 = 1
    UNION ALL SELECT 'u' || user_id, event_id, 'rendered' FROM events WHERE NOT (event_type IN ('purchase', 'error', 'view') AND event_id % 2 = 0) AND NOT (event_type = 'signup' AND event_id % 2 = 1)""",
)
def portable_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    owners = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("session_ref"))
    rows = event_blocks(spark, sf_dir).join(owners, "event_id").select(
        "session_ref", e.alias("ordinal"), F.when(e % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("event_log").alias("source_agent"), F.array("block").alias("blocks")
    )
    good, bad = N.portable_messages(rows)
    sound = good.filter(F.col("rendered").rlike("(?s)^<<<CONVHIST_HISTORICAL_[A-Z_]+_V1>>>\n\\{\"notice\":\"Historical .*\\}\n<<<END_CONVHIST_HISTORICAL_[A-Z_]+_V1>>>$"))
    return sound.select("session_ref", "ordinal", F.lit("rendered").alias("text")).unionByName(bad.select("session_ref", "ordinal", F.col("issue").alias("text")))


_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-4' || substr({0}, 14, 3) || '-' || substr('89ab', ((('0x' || substr({0}, 17, 1))::INT) % 4) + 1, 1) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"
_KEYS = f"""keyed AS (SELECT session_ref, title, 'conversion1_' || {duck_digest(["'portable/1'", "agent", "'other'", "session_ref", "'rev' || n_items"])} AS conversion_key FROM sessions)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir)
    return rows.select("session_ref", "title", conversion_key(F.col("agent"), F.lit("other"), F.col("session_ref"), F.concat(F.lit("rev"), "n_items")).alias("conversion_key"))


def _purpose(expression: str) -> str:
    return f"sha256('converted-uuid/1|' || {expression} || '|' || conversion_key)"


@query("derived_ids", f"WITH {SESSIONS}, {_KEYS}, h AS (SELECT *, {_purpose(repr('other.session'))} AS d FROM keyed) SELECT session_ref, conversion_key, {_UUID.format('d')} AS native_id FROM h")
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("session_ref", "conversion_key", derived_uuid(F.col("conversion_key"), "other.session").alias("native_id"))


@query(
    "project_rows",
    f"""WITH {SESSIONS}, {_KEYS}, body AS (SELECT i.session_ref, i.ordinal, 'message' AS type, role, text, CASE WHEN role = 'assistant' THEN model ELSE '' END AS model, {_purpose("'target.message.' || i.ordinal")} AS d FROM items i JOIN keyed USING (session_ref) WHERE kind = 'message'),
    info AS (SELECT session_ref, -1::BIGINT AS ordinal, 'session_info' AS type, '' AS role, title AS text, '' AS model, {_purpose("'target.session-info'")} AS d FROM keyed WHERE trim(title) <> '' AND session_ref IN (SELECT session_ref FROM body)),
    lines AS (SELECT *, {_UUID.format('d')} AS record_id FROM (SELECT * FROM body UNION ALL SELECT * FROM info))
    SELECT session_ref, ordinal, type, role, text, model, record_id, coalesce(lag(record_id) OVER w, '') AS parent_id, row_number() OVER w AS record_no FROM lines WINDOW w AS (PARTITION BY session_ref ORDER BY ordinal)""",
)
def project_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = items(spark, sf_dir).filter("kind = 'message'").withColumnRenamed("text", "rendered")
    rows = N.project_rows(messages, _keyed(spark, sf_dir))
    return rows.select("session_ref", "ordinal", "type", "role", "text", "model", "record_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "record_no")


@query(
    "kind_counts",
    f"""WITH {ITEMS}, k AS (SELECT session_ref, unnest(content_kinds) AS kind FROM items) SELECT session_ref, CASE WHEN kind = 'thinking' THEN 'reasoning' WHEN kind LIKE '%tool%' THEN 'tool' WHEN kind IN ('image', 'document') THEN 'resource' ELSE 'unknown' END AS category, count(*) AS n
    FROM k WHERE kind <> 'text' GROUP BY 1, 2""",
)
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.kind_counts(items(spark, sf_dir))
