"""Queries: session graphs and record forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.operators import graphs as H
from convhist.operators.ordered import previous_row, scan
from convhist.plans.beats_queries import duck_multiset
from convhist.plans.bindings import EDGES, RECORDS, SESSIONS, records, session_edges, sessions, table
from convhist.plans.registry import query


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir)


def _inner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_edges(spark, sf_dir).filter("parent_ref <> 'event_log:missing'")


_REACH = """links AS (SELECT session_ref AS a, parent_ref AS b FROM session_edges WHERE parent_ref <> 'event_log:missing'
  UNION SELECT parent_ref, session_ref FROM session_edges WHERE parent_ref <> 'event_log:missing'),
reach AS (SELECT session_ref AS a, session_ref AS b FROM sessions UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS session_ref, min(b) AS component_ref FROM reach GROUP BY a)"""


@query(
    "session_components",
    f"WITH RECURSIVE {SESSIONS}, {EDGES}, {_REACH} SELECT session_ref, component_ref, count(*) OVER (PARTITION BY component_ref) AS members FROM comp",
)
def session_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = H.components(_nodes(spark, sf_dir), _inner_edges(spark, sf_dir), src="session_ref", dst="parent_ref")
    return H.component_members(labels)


@query(
    "invalid_components",
    f"""WITH RECURSIVE {SESSIONS}, {EDGES}, {_REACH} SELECT session_ref, component_ref, component_ref IN (SELECT c.component_ref FROM comp c JOIN session_edges e USING (session_ref)
      WHERE e.parent_ref NOT IN (SELECT session_ref FROM sessions)) AS invalid FROM comp""",
)
def invalid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _nodes(spark, sf_dir), session_edges(spark, sf_dir)
    labels = H.components(nodes, _inner_edges(spark, sf_dir), src="session_ref", dst="parent_ref")
    return H.invalid_components(nodes, edges, labels, src="session_ref", dst="parent_ref")


@query("children", f"WITH {EDGES} SELECT DISTINCT parent_ref, session_ref FROM session_edges")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.children(session_edges(spark, sf_dir))


_CLOSURE = """picked AS (SELECT session_ref FROM sessions WHERE conv_id % 5 = 2),
clos AS (SELECT session_ref FROM picked UNION SELECT e.parent_ref FROM clos c JOIN session_edges e USING (session_ref))"""


@query(
    "closure",
    f"WITH RECURSIVE {SESSIONS}, {EDGES}, {_CLOSURE} SELECT session_ref, session_ref IN (SELECT session_ref FROM sessions) AS known FROM clos",
)
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    found, missing = H.closure(nodes.filter("conv_id % 5 = 2"), session_edges(spark, sf_dir), nodes)
    return found.withColumn("known", F.lit(True)).unionByName(missing.withColumn("known", F.lit(False)))


@query(
    "topo_order",
    f"""WITH RECURSIVE {SESSIONS}, {EDGES}, bases AS (SELECT * FROM session_edges WHERE parent_ref <> 'event_log:missing'
        UNION SELECT session_ref, session_ref FROM sessions WHERE conv_id % 17 = 6),
    lv AS (SELECT session_ref, 0::BIGINT AS level FROM sessions WHERE session_ref NOT IN (SELECT session_ref FROM bases)
      UNION ALL SELECT b.session_ref, l.level + 1 FROM lv l JOIN bases b ON b.parent_ref = l.session_ref AND b.session_ref <> b.parent_ref
        WHERE b.session_ref NOT IN (SELECT session_ref FROM bases x WHERE x.session_ref = x.parent_ref))
    SELECT s.session_ref, coalesce(max(l.level), -1)::BIGINT AS level FROM sessions s LEFT JOIN lv l USING (session_ref) GROUP BY 1""",
)
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    loops = nodes.filter("conv_id % 17 = 6").select("session_ref", F.col("session_ref").alias("parent_ref"))
    levels = H.topo_levels(nodes, _inner_edges(spark, sf_dir).unionByName(loops))
    return levels.select("session_ref", F.coalesce("level", F.lit(-1)).cast("bigint").alias("level"))


def _event_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events, each event's dependency on the same user's event before it)."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rows = scan(events, ["user_id"], "event_id", {"_before": previous_row(F.col("event_id"))})
    return events, rows.filter("_before IS NOT NULL").select("event_id", F.col("_before.v").alias("before"))


@query(
    "closure_chains",
    """SELECT event_id FROM (SELECT event_id, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS e FROM events) WHERE event_id <= e""",
)
def closure_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, links = _event_chains(spark, sf_dir)
    return H.closure(events.filter("event_type = 'error'"), links, events, "event_id", "event_id", "before")[0]


@query("topo_chains", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS level FROM events")
def topo_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, links = _event_chains(spark, sf_dir)
    return H.topo_levels(events, links, "event_id", "event_id", "before")


@query(
    "forest_depth",
    f"""WITH RECURSIVE {RECORDS}, d AS (SELECT session_ref, record_id, record_id AS root, 0::BIGINT AS depth FROM records WHERE parent_id IS NULL
      UNION ALL SELECT r.session_ref, r.record_id, d.root, d.depth + 1 FROM d JOIN records r ON r.session_ref = d.session_ref AND r.parent_id = d.record_id)
    SELECT session_ref, record_id, root, depth FROM d""",
)
def forest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.forest_depth(records(spark, sf_dir), ["session_ref"], "record_id", "parent_id")
    return rows.withColumnRenamed("node", "record_id")


@query(
    "nearest_ancestor",
    f"""WITH RECURSIVE {RECORDS}, up AS (SELECT session_ref, record_id AS node, parent_id AS a FROM records
      UNION ALL SELECT u.session_ref, u.node, r.parent_id FROM up u JOIN records r ON r.session_ref = u.session_ref AND r.record_id = u.a WHERE r.type <> 'signup')
    SELECT u.session_ref, u.node AS record_id, coalesce(max(u.a) FILTER (r.type = 'signup'), '') AS ancestor FROM up u LEFT JOIN records r ON r.session_ref = u.session_ref AND r.record_id = u.a GROUP BY 1, 2""",
)
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    found = H.nearest_marked_ancestor(rows, rows.filter("type = 'signup'"), ["session_ref"], "record_id", "parent_id")
    return found.select("session_ref", F.col("node").alias("record_id"), F.coalesce("ancestor", F.lit("")).alias("ancestor"))


_RULES_SQL = "list_filter([CASE WHEN deleted THEN 'library.deleted' END, CASE WHEN title = '' THEN 'title.missing' END, CASE WHEN conv_id % 13 = 0 THEN 'parent.missing' END, CASE WHEN model = '' THEN 'model.unknown' END], lambda c: c IS NOT NULL)"


def _rules():
    return H.blockers({
        "library.deleted": F.col("deleted"), "title.missing": F.col("title") == "", "parent.missing": F.col("conv_id") % 13 == 0,
        "model.unknown": F.col("model") == "",
    })


@query("migratable", f"WITH {SESSIONS}, b AS (SELECT session_ref, {_RULES_SQL} AS codes FROM sessions) SELECT session_ref, array_to_string(codes, ',') AS blockers, len(codes) = 0 AS exportable FROM b")
def migratable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).withColumn("_b", _rules())
    return rows.select("session_ref", F.array_join("_b", ",").alias("blockers"), (F.size("_b") == 0).alias("exportable"))


# Every session depends on its parent and every tenth also on its third predecessor; two resources each.
_EXPORT = f"""deps AS (SELECT session_ref, parent_ref FROM session_edges UNION SELECT a.session_ref, b.session_ref FROM sessions a JOIN sessions b ON b.conv_id = a.conv_id - 3 WHERE a.conv_id % 10 = 6),
bad AS (SELECT session_ref FROM sessions WHERE deleted OR model = ''
  UNION SELECT session_ref FROM deps WHERE parent_ref NOT IN (SELECT session_ref FROM sessions)
  UNION SELECT e.session_ref FROM deps e JOIN bad b ON e.parent_ref = b.session_ref),
owned AS (SELECT session_ref, 'file' || (conv_id % 20) AS resource FROM sessions UNION SELECT session_ref, 'log' || (conv_id % 17) FROM sessions WHERE conv_id % 3 = 0),
good AS (SELECT session_ref, conv_id FROM sessions WHERE conv_id % 2 = 0 AND session_ref NOT IN (SELECT session_ref FROM bad)),
reach AS (SELECT session_ref AS root, session_ref AS member FROM good UNION SELECT r.root, d.parent_ref FROM reach r JOIN deps d ON d.session_ref = r.member),
claims AS (SELECT DISTINCT root, resource, member AS owner FROM reach JOIN owned ON owned.session_ref = member),
torn AS (SELECT DISTINCT root FROM claims GROUP BY root, resource HAVING min(owner) <> max(owner)),
cand AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) AS rn FROM (SELECT root, count(*) AS size FROM reach GROUP BY root) WHERE root NOT IN (SELECT root FROM torn)),
lists AS (SELECT c.rn, c.root, coalesce(list(resource || '=' || owner) FILTER (resource IS NOT NULL), []) AS mine, coalesce(list(resource) FILTER (resource IS NOT NULL), []) AS res FROM cand c LEFT JOIN claims USING (root) GROUP BY 1, 2),
greedy AS (SELECT 0::BIGINT AS rn, ''::VARCHAR AS root, true AS ok, []::VARCHAR[] AS held, []::VARCHAR[] AS names
  UNION ALL SELECT l.rn, l.root, len(list_filter(l.mine, lambda x: list_contains(g.names, split_part(x, '=', 1)) AND NOT list_contains(g.held, x))) = 0,
    CASE WHEN len(list_filter(l.mine, lambda x: list_contains(g.names, split_part(x, '=', 1)) AND NOT list_contains(g.held, x))) = 0 THEN list_distinct(list_concat(g.held, l.mine)) ELSE g.held END,
    CASE WHEN len(list_filter(l.mine, lambda x: list_contains(g.names, split_part(x, '=', 1)) AND NOT list_contains(g.held, x))) = 0 THEN list_distinct(list_concat(g.names, l.res)) ELSE g.names END
  FROM greedy g JOIN lists l ON l.rn = g.rn + 1),
exported AS (SELECT DISTINCT r.member AS session_ref FROM reach r JOIN greedy g ON g.root = r.root AND g.ok)"""


@query(
    "select_exportable",
    f"""WITH RECURSIVE {SESSIONS}, {EDGES}, {_EXPORT} SELECT session_ref, 'exported' AS outcome FROM exported
    UNION ALL SELECT session_ref, 'closure_blocked' FROM sessions WHERE conv_id % 2 = 0 AND (session_ref IN (SELECT session_ref FROM bad) OR session_ref IN (SELECT root FROM torn))
    UNION ALL SELECT root, 'ownership_conflict' FROM greedy WHERE NOT ok""",
)
def select_exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, owned = export_inputs(spark, sf_dir)
    exported, skipped = H.select_exportable(nodes.filter("conv_id % 2 = 0"), nodes, edges, nodes.filter("deleted OR model = ''"), owned)
    return exported.select("session_ref", F.lit("exported").alias("outcome")).unionByName(skipped.select("session_ref", F.col("reason").alias("outcome")))


def export_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, dependencies, owned resources), with several of both per session."""
    nodes, c = _nodes(spark, sf_dir), F.col("conv_id")
    earlier = nodes.select((c + 3).alias("conv_id"), F.col("session_ref").alias("parent_ref"))
    more = nodes.filter(c % 10 == 6).join(earlier, "conv_id").select("session_ref", "parent_ref")
    owned = nodes.select("session_ref", F.concat(F.lit("file"), c % 20).alias("resource")).unionByName(
        nodes.filter(c % 3 == 0).select("session_ref", F.concat(F.lit("log"), c % 17).alias("resource"))
    )
    return nodes, session_edges(spark, sf_dir).unionByName(more), owned


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return _nodes(spark, sf_dir).select(
        "session_ref", "conv_id", "agent", "native_id", (c % 3 != 1).alias("relation_valid"),
        F.array(F.when(c % 6 == 0, c + 4).cast("string"), F.lit("")).alias("related"),
    )


KEYS = """keys AS (SELECT session_ref, agent || ':' || native_id AS relation_key FROM sessions
  UNION SELECT session_ref, agent || ':' || (conv_id + 4) FROM sessions WHERE conv_id % 6 = 0)"""


@query("relation_keys", f"WITH {SESSIONS}, {KEYS} SELECT * FROM keys")
def relation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.relation_keys(_related(spark, sf_dir))


@query(
    "lineages",
    f"""WITH RECURSIVE {SESSIONS}, {KEYS}, vals AS (
      SELECT session_ref, 'd|' || CASE WHEN conv_id % 5 = 0 THEN 'same' || (conv_id % 2) ELSE 'own' || conv_id END AS value FROM sessions
      UNION ALL SELECT session_ref, 'k|' || relation_key FROM keys),
    reach AS (SELECT session_ref AS a, session_ref AS b FROM sessions UNION SELECT r.a, w.session_ref FROM reach r JOIN vals v ON v.session_ref = r.b JOIN vals w ON w.value = v.value),
    comp AS (SELECT a AS session_ref, min(b) AS root FROM reach GROUP BY a),
    refs AS (SELECT root, {duck_multiset("lineage1_", "sha256(value)")} AS lineage_ref FROM (SELECT DISTINCT root, value FROM comp JOIN vals USING (session_ref)) GROUP BY root)
    SELECT session_ref, lineage_ref FROM comp JOIN refs USING (root)""",
)
def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    digests = _nodes(spark, sf_dir).select(
        "session_ref", F.when(c % 5 == 0, F.concat(F.lit("same"), c % 2)).otherwise(F.concat(F.lit("own"), c)).alias("logical_digest")
    )
    return H.lineages(digests, H.relation_keys(_related(spark, sf_dir)))
