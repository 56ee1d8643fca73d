"""Queries: the whole way from conversations to planned requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.operators import corpus as Q
from convhist.plans.beats_queries import CARDS, PLAN, SPREAD, cut_sql, duck_digest, duck_multiset, logical_sql
from convhist.plans.bindings import items, sessions
from convhist.plans.graph_queries import KEYS, relation_keys
from convhist.plans.registry import query

# Every assistant message holds one tool exchange: what it was asked is its text.
_FIELDS = ("name", "namespace", "status", "input", "output", "error")
_PACKED = "struct_pack(" + ", ".join(f"{f} := {f}" for f in _FIELDS) + ")"
_TOOLS = f"""calls AS (SELECT session_ref, ordinal, 'grep' AS name, model AS namespace, 'completed' AS status, {cut_sql("text", "1024")} AS input, role AS output, '' AS error
  FROM items WHERE kind = 'message' AND role = 'assistant'),
call_digests AS (SELECT session_ref, ordinal, {duck_multiset("tools1_", "d")} AS td FROM (SELECT *, {duck_digest(list(_FIELDS))} AS d FROM calls) GROUP BY 1, 2),
turn_calls AS (SELECT b.turn_start, c.*, sum(strlen(to_json({_PACKED})::VARCHAR)) OVER (PARTITION BY b.session_ref, b.turn_start ORDER BY c.ordinal) AS running
  FROM calls c JOIN beats b ON b.session_ref = c.session_ref AND c.ordinal BETWEEN b.turn_start AND b.turn_end
    AND b.turn_start = (SELECT max(x.turn_start) FROM beats x WHERE x.session_ref = c.session_ref AND x.turn_start <= c.ordinal)),
turn_tools AS (SELECT session_ref, turn_start, to_json(coalesce(list({_PACKED} ORDER BY ordinal) FILTER (running <= 4096), []))::VARCHAR AS tools,
  count(*) FILTER (running > 4096) AS omitted_tools FROM turn_calls GROUP BY 1, 2)"""
_LINEAGE = f"""{logical_sql("(SELECT i.*, t.td FROM items i LEFT JOIN call_digests t USING (session_ref, ordinal))", "coalesce(td, '')")}, {KEYS},
vals AS (SELECT session_ref, 'd|' || logical_digest AS value FROM logical UNION ALL SELECT session_ref, 'k|' || relation_key FROM keys),
reach AS (SELECT session_ref AS a, session_ref AS b FROM sessions UNION SELECT r.a, w.session_ref FROM reach r JOIN vals v ON v.session_ref = r.b JOIN vals w ON w.value = v.value),
comp AS (SELECT a AS session_ref, min(b) AS root FROM reach GROUP BY a),
refs AS (SELECT root, {duck_multiset("lineage1_", "sha256(value)")} AS lineage_ref FROM (SELECT DISTINCT root, value FROM comp JOIN vals USING (session_ref)) GROUP BY root),
lin AS (SELECT session_ref, lineage_ref FROM comp JOIN refs USING (root))"""
_QUEUE = (
    CARDS.replace("card_base AS (", f"{_TOOLS},\n{_LINEAGE},\ncard_base AS (")
    .replace("'lin' || (s.conv_id % 11) AS lineage_ref", "g.lineage_ref, coalesce(t.tools, '[]') AS tools, coalesce(t.omitted_tools, 0)::BIGINT AS omitted_tools")
    .replace("LEFT JOIN lists l USING", "JOIN lin g USING (session_ref) LEFT JOIN turn_tools t USING (session_ref, turn_start) LEFT JOIN lists l USING")
    .replace("tools := '[]'", "tools := tools")
    .replace("omitted_tools := 0::BIGINT", "omitted_tools := omitted_tools")
)
_DOCS = "docs AS (SELECT * FROM sized WHERE card_ref IN (SELECT min(card_ref) FROM sized GROUP BY lineage_ref, content_digest))"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    heads = sessions(spark, sf_dir).withColumn("source_revision", F.concat(F.lit("rev"), F.col("n_items")))
    events = rows.filter("kind = 'message' AND role = 'assistant'").select(
        "session_ref", "ordinal", F.lit("exchange").alias("phase"), F.concat(F.lit("t"), "ordinal").alias("call_id"), F.lit("grep").alias("name"),
        F.col("model").alias("namespace"), F.lit("").alias("status"), F.col("text").alias("input"), F.col("role").alias("output"), F.lit("").alias("error"),
    )
    return Q.discovery_queue(rows, heads, relation_keys(spark, sf_dir), events)


@query(
    "discovery_queue",
    f"""WITH RECURSIVE {_QUEUE}, {_DOCS}, {SPREAD} SELECT card_ref, session_ref, turn_start, lineage_ref, tools, omitted_tools, request_bytes, estimated_tokens,
    place AS spread_place, lineage_rank, project_key FROM stratified""",
)
def discovery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select(
        "card_ref", "session_ref", "turn_start", "lineage_ref", "tools", "omitted_tools", "request_bytes", "estimated_tokens", "spread_place", "lineage_rank", "project_key"
    )


@query(
    "discovery_plan",
    f"""WITH RECURSIVE {_QUEUE}, {_DOCS}, {SPREAD}, {PLAN} SELECT f.q - 1 AS place, c.card_ref, f.requests AS request_no, c.estimated_tokens AS tokens
    FROM fold f JOIN queue c USING (q) WHERE f.q > 0""",
)
def discovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.discovery_plan(_queue(spark, sf_dir), 500_000, 300_000)[0]
