"""Queries: transcript assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.text import gap_code
from convhist.operators import assembly as A
from convhist.plans.bindings import ITEMS, RECORDS, items, records, table
from convhist.plans.registry import query


@query(
    "session_header",
    f"""WITH {RECORDS}, m AS (SELECT session_ref || '/' || type || '/' || (k % 10) AS session_ref, record_no, 'h' || (k % 3) AS header_id, CASE WHEN record_no % 2 = 0 THEN 'h1' END AS expected_id FROM records),
    f AS (SELECT session_ref, min(record_no) AS record_no, min_by(header_id, record_no) AS header_id, count(*) AS n, max(expected_id) AS e FROM m GROUP BY 1),
    s AS (SELECT m.session_ref, count(*) FILTER (m.header_id = coalesce(f.e, f.header_id)) AS same FROM m JOIN f USING (session_ref) GROUP BY 1)
    SELECT session_ref, record_no, header_id, CASE WHEN n > 1 AND header_id <> coalesce(e, header_id) THEN 'unidentified' WHEN n > 1 AND same <> 1 THEN 'ambiguous'
      WHEN e IS NOT NULL AND header_id <> e THEN 'disagrees' ELSE 'ok' END AS status FROM f JOIN s USING (session_ref)""",
)
def session_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select(
        F.concat_ws("/", "session_ref", "type", F.col("k") % 10).alias("session_ref"), "record_no", F.concat(F.lit("h"), F.col("k") % 3).alias("header_id"),
        F.when(F.col("record_no") % 2 == 0, "h1").alias("expected_id"),
    )
    return A.session_header(rows)


@query(
    "last_setting",
    f"WITH {RECORDS} SELECT session_ref, coalesce(max_by('m' || k, record_no) FILTER (type = 'signup'), '') AS model FROM records GROUP BY 1",
)
def last_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("setting", F.when(F.col("type") == "signup", F.concat(F.lit("m"), "k")))
    return A.last_setting(rows, "setting", name="model").withColumn("model", F.coalesce("model", F.lit("")))


@query(
    "forward_fill",
    f"""WITH {RECORDS} SELECT session_ref, record_no, coalesce(last_value(CASE WHEN type = 'signup' THEN 'm' || k END IGNORE NULLS)
      OVER (PARTITION BY session_ref ORDER BY record_no), '') AS model FROM records""",
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("setting", F.when(F.col("type") == "signup", F.concat(F.lit("m"), "k")))
    return A.forward_fill(rows, "setting", "model").select("session_ref", "record_no", F.coalesce("model", F.lit("")).alias("model"))


@query(
    "session_title",
    """WITH t AS (SELECT 's' || conv_id AS session_ref, turn, CASE WHEN role = 'user' THEN 'user' WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN 'custom_title' ELSE 'generated_title' END AS kind, text FROM conversations),
    p AS (SELECT session_ref, max_by(text, turn) FILTER (kind = 'custom_title') AS c, max_by(text, turn) FILTER (kind = 'generated_title') AS g, min_by(text, turn) FILTER (kind = 'user') AS u FROM t GROUP BY 1),
    f AS (SELECT session_ref, trim(regexp_replace(coalesce(nullif(c, ''), nullif(g, ''), nullif(u, ''), 'Untitled session'), '\\s+', ' ', 'g')) AS t FROM p)
    SELECT session_ref, CASE WHEN length(t) <= 160 THEN t ELSE substr(t, 1, 157) || '...' END AS title FROM f""",
)
def session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), "conv_id").alias("session_ref"), F.col("turn").alias("record_no"), "text",
        F.when(F.col("role") == "user", "user").when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 2 == 0), "custom_title").otherwise("generated_title").alias("kind"),
    )
    return A.session_title(rows)


@query(
    "session_times",
    """WITH e AS (SELECT 'u' || user_id AS session_ref, max(ts) FILTER (event_id % 7 <> 0) AS latest FROM events GROUP BY 1),
    h AS (SELECT 'u' || user_id AS session_ref, min(date_trunc('second', ts)) AS header, max(date_trunc('second', ts)) FILTER (event_type = 'error') AS file FROM events GROUP BY 1)
    SELECT session_ref, header AS created_at, greatest(header, file, date_trunc('second', latest)) AS updated_at FROM h LEFT JOIN e USING (session_ref)""",
)
def session_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    base = table(spark, sf_dir, "events").withColumn("session_ref", F.concat(F.lit("u"), "user_id"))
    headers = base.groupBy("session_ref").agg(F.min(at).alias("header_time"), F.max(F.when(F.col("event_type") == "error", at)).alias("file_time"))
    entries = base.select("session_ref", F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(at).alias("entry_time"))
    return A.session_times(headers, entries)


@query(
    "active_path",
    f"""WITH RECURSIVE {RECORDS}, leaf AS (SELECT session_ref, max_by(record_id, record_no) AS record_id FROM records GROUP BY 1),
    path AS (SELECT session_ref, record_id FROM leaf UNION ALL SELECT r.session_ref, r.parent_id FROM path p JOIN records r USING (session_ref, record_id) WHERE r.parent_id IS NOT NULL)
    SELECT session_ref, record_id, record_no FROM path JOIN records USING (session_ref, record_id)""",
)
def active_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.active_path(records(spark, sf_dir)).select("session_ref", "record_id", "record_no")


@query(
    "tree_stats",
    f"""WITH {RECORDS} SELECT session_ref, count(*) AS records, count(*) FILTER (parent_id IS NULL) AS roots, max_by(record_id, record_no) AS leaf,
    (SELECT count(*) FROM (SELECT parent_id FROM records c WHERE c.session_ref = r.session_ref AND parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 1)) AS branch_points FROM records r GROUP BY session_ref""",
)
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tree_stats(records(spark, sf_dir))


_BROKEN = f"""{RECORDS}, broken AS (SELECT session_ref, record_no, CASE WHEN record_no % 101 = 0 THEN 'r' || (record_no // 10000) ELSE record_id END AS record_id,
  CASE WHEN record_no % 50 = 7 THEN 'r' || (record_no + 300) ELSE parent_id END AS parent_id FROM records),
first AS (SELECT session_ref, record_id, min(record_no) AS seen, count(*) AS n FROM broken GROUP BY 1, 2)"""


@query(
    "tree_violations",
    f"""WITH {_BROKEN} SELECT session_ref, record_id, 'repeated_id' AS violation FROM first WHERE n > 1
    UNION ALL SELECT b.session_ref, b.record_id, 'parent_id' || '' FROM broken b WHERE false
    UNION ALL SELECT b.session_ref, b.record_id, 'parent_not_earlier' FROM broken b LEFT JOIN first f ON f.session_ref = b.session_ref AND f.record_id = b.parent_id
      WHERE b.parent_id IS NOT NULL AND (f.seen IS NULL OR f.seen >= b.record_no)""",
)
def tree_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("record_no")
    rows = records(spark, sf_dir).select(
        "session_ref", "record_no",
        F.when(n % 101 == 0, F.concat(F.lit("r"), F.expr("record_no div 10000"))).otherwise(F.col("record_id")).alias("record_id"),
        F.when(n % 50 == 7, F.concat(F.lit("r"), n + 300)).otherwise(F.col("parent_id")).alias("parent_id"),
    )
    return A.tree_violations(rows)


@query(
    "forward_compaction",
    f"""WITH {ITEMS}, c AS (SELECT session_ref, max(ordinal) AS cut FROM items WHERE conv_id % 3 = 0 AND kind = 'message' AND role = 'assistant' AND ordinal % 4 = 1 GROUP BY 1)
    SELECT i.session_ref, 1::BIGINT AS section, ordinal, role, text FROM items i LEFT JOIN c USING (session_ref) WHERE cut IS NULL OR ordinal > cut
    UNION ALL SELECT session_ref, 0, p, CASE p WHEN 0 THEN 'user' ELSE 'assistant' END, CASE p WHEN 0 THEN 'summary ' || cut ELSE 'ack' END FROM c, (VALUES (0::BIGINT), (1::BIGINT)) v(p)""",
)
def forward_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    new = F.array(
        F.struct(F.lit("user").alias("role"), F.concat(F.lit("summary "), "ordinal").alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.lit("ack").alias("text")),
    )
    marks = rows.filter("conv_id % 3 = 0 AND kind = 'message' AND role IN ('assistant', 'system')").select(
        "session_ref", "ordinal", F.when((F.col("ordinal") % 4 == 1) & (F.col("role") == "assistant"), new).alias("replacement")
    )
    return A.forward_compaction(rows, marks).withColumn("section", F.col("section").cast("bigint"))


@query(
    "partial_compaction",
    f"""WITH {ITEMS}, cp AS (SELECT DISTINCT session_ref, conv_id, CASE WHEN conv_id % 2 = 0 THEN 'up_to' ELSE 'from' END AS mode, 3::BIGINT AS so FROM items WHERE conv_id % 4 <> 3 AND ordinal = 3),
    ok AS (SELECT *, CASE WHEN (conv_id * 5 + 3) % 29 <> 3 THEN TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(3) + to_microseconds(3003) END AS stamp FROM cp WHERE conv_id % 5 <> 0),
    j AS (SELECT i.*, ok.mode, ok.stamp, ordinal IN (1, 2) AND mode IS NOT NULL AS kept FROM items i LEFT JOIN ok USING (session_ref))
    SELECT session_ref, CASE WHEN mode IS NULL THEN 2 WHEN ordinal = 3 THEN CASE WHEN mode = 'up_to' THEN 0 ELSE 1 END WHEN kept THEN CASE WHEN mode = 'up_to' THEN 1 ELSE 0 END ELSE 2 END::BIGINT AS section,
      CASE WHEN kept THEN ordinal - 1 ELSE ordinal END AS place, ordinal, CASE WHEN mode IS NOT NULL AND ordinal = 3 THEN 'user' ELSE role END AS role, text,
      CASE WHEN kept AND mode = 'up_to' THEN stamp ELSE ts END AS ts FROM j WHERE mode IS NULL OR ordinal >= 3 OR kept""",
)
def partial_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    c = F.col("conv_id")
    checkpoints = rows.filter("conv_id % 4 <> 3 AND ordinal = 3").select(
        "session_ref", F.when(c % 2 == 0, "up_to").otherwise("from").alias("mode"), F.lit(3).cast("bigint").alias("summary_ordinal")
    )
    preserved = rows.filter("conv_id % 4 <> 3 AND ordinal IN (1, 2)").select(
        "session_ref", (F.col("ordinal") - 1).alias("seq"), "ordinal",
        F.when(c % 5 == 0, F.lit(0)).otherwise(F.col("ordinal") - 1).cast("bigint").alias("parent_ordinal"),
    )
    return A.partial_compaction(rows, checkpoints, preserved)


@query(
    "compaction_tail",
    f"""WITH {ITEMS}, b AS (SELECT session_ref, max(ordinal) AS b FROM items WHERE conv_id % 2 = 0 AND ordinal % 3 = 2 AND kind = 'message' GROUP BY 1),
    x AS (SELECT i.*, b.b, max(ordinal) FILTER (ordinal < b.b AND NOT (kind = 'message' AND (ordinal + conv_id // 2) % 4 <> 0)) OVER (PARTITION BY session_ref) AS o,
      max(ts) FILTER (ordinal = b.b + 1 AND kind = 'message' AND role = 'assistant') OVER (PARTITION BY session_ref) AS stamp FROM items i LEFT JOIN b USING (session_ref)),
    y AS (SELECT *, coalesce(o + 1, 0) AS beg, coalesce(b IS NOT NULL AND stamp IS NOT NULL AND coalesce(o + 1, 0) < b, false) AS act FROM x),
    z AS (SELECT *, max(text) FILTER (act AND ordinal = beg AND role = 'assistant') OVER (PARTITION BY session_ref) AS lead FROM y)
    SELECT session_ref, CASE WHEN NOT act THEN 4 WHEN ordinal = b THEN 0 WHEN ordinal = b + 1 THEN 1 WHEN ordinal < b THEN 2 ELSE 3 END::BIGINT AS section, ordinal AS place, role,
      CASE WHEN act AND ordinal = b + 1 AND lead IS NOT NULL THEN text || chr(10) || chr(10) || lead ELSE text END AS text, CASE WHEN act AND ordinal < b THEN stamp ELSE ts END AS ts
    FROM z WHERE NOT act OR (ordinal >= beg AND NOT (lead IS NOT NULL AND ordinal = beg))""",
)
def compaction_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("ordinal"), F.col("conv_id")
    rows = items(spark, sf_dir).withColumn("in_tail", (o + F.expr("conv_id div 2")) % 4 != 0)
    return A.compaction_tail(rows.withColumn("is_boundary", (c % 2 == 0) & (o % 3 == 2) & (F.col("kind") == "message")))


_ROLLBACK = {"signup": "user", "view": "assistant", "click": "assistant", "purchase": "gap", "error": "rollback"}


def _rollback_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, e = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("/"), F.expr("event_id div 1000")).alias("session_ref"), e.alias("ordinal"),
        F.when(kind.isin("purchase", "error"), "gap").otherwise("message").alias("kind"),
        F.when(kind == "signup", "user").when(kind.isin("view", "click"), "assistant").otherwise("").alias("role"),
        F.when(kind == "purchase", F.when(e % 5 == 0, "record.opaque").otherwise("world_state")).when(kind == "error", "rollback").otherwise("").alias("code"),
        F.when(e % 23 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"),
        F.when(kind == "error", e % 3 + 1).alias("rollback_turns"), (F.col("user_id") % 7 != 0).alias("eligible"),
    )


# The check replays the events one by one, keeping the surviving ordinals and user turns as lists.
@query(
    "apply_rollbacks",
    """WITH RECURSIVE src AS (SELECT 'u' || user_id || '/' || (event_id // 1000) AS s, event_id AS o, event_type AS k, event_id % 3 + 1 AS back, user_id % 7 <> 0 AS el,
        CASE WHEN event_id % 23 = 0 THEN TIMESTAMP '2024-01-01' ELSE ts END AS ts, k = 'purchase' AND event_id % 5 = 0 AS opaque FROM events),
    num AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o) AS i, count(*) OVER (PARTITION BY s, ts) AS same FROM src),
    fold AS (
      SELECT s, 0::BIGINT AS i, []::BIGINT[] AS live, []::BIGINT[] AS users, false AS shut FROM (SELECT DISTINCT s FROM num)
      UNION ALL
      SELECT f.s, n.i,
        CASE WHEN hit THEN list_filter(f.live, lambda x: x < f.users[len(f.users) - least(n.back, len(f.users)) + 1]) ELSE list_append(f.live, n.o) END,
        CASE WHEN hit THEN f.users[1:len(f.users) - least(n.back, len(f.users))] WHEN n.k = 'signup' THEN list_append(f.users, n.o) ELSE f.users END,
        f.shut OR n.opaque OR (n.k = 'error' AND NOT hit)
      FROM fold f JOIN num n ON n.s = f.s AND n.i = f.i + 1, LATERAL (SELECT n.k = 'error' AND n.el AND n.same = 1 AND NOT f.shut AND len(f.users) > 0 AS hit)),
    last AS (SELECT s, max_by(live, i) AS live FROM fold GROUP BY s)
    SELECT s AS session_ref, unnest(live) AS ordinal FROM last""",
)
def apply_rollbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_rollbacks(_rollback_items(spark, sf_dir)).select("session_ref", "ordinal")


def _retraction_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assistant messages from views and clicks; purchases are replacement messages that retract."""
    e, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), e.alias("ordinal"), F.lit("message").alias("kind"),
        F.when(kind == "signup", "user").otherwise("assistant").alias("role"), F.concat(F.lit("m"), e).alias("message_id"), "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    from convhist.operators.ordered import last_value, scan

    rows = scan(rows, ["session_ref"], "ordinal", {
        "_v": last_value(F.when(F.col("event_type") == "view", F.col("message_id")), strict=True),
        "_s": last_value(F.when(F.col("event_type").isin("signup", "click"), F.col("message_id")), strict=True),
    })
    episodes = rows.filter("event_type = 'purchase' AND _v IS NOT NULL").select(
        "session_ref", F.col("ordinal").alias("episode_no"), F.col("message_id").alias("replacement_id"),
        F.when(F.col("k") % 2 == 0, F.array("_v")).otherwise(F.array_compact(F.array("_v", "_s"))).alias("superseded"),
    )
    return rows.select("session_ref", "ordinal", "kind", "role", "message_id"), episodes


@query(
    "apply_retractions",
    """WITH RECURSIVE m AS (SELECT 'u' || user_id AS s, event_id AS o, event_type AS t, json_extract_string(props, '$.k')::BIGINT AS k,
      last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type IN ('signup', 'click') THEN event_id END IGNORE NULLS) OVER w AS c
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ep AS (SELECT s, o, CASE WHEN k % 2 = 0 OR c IS NULL THEN [v] ELSE [v, c] END AS ids, k % 2 = 0 OR c IS NULL OR (SELECT x.t FROM m x WHERE x.o = m.c) = 'click' AS static_ok FROM m WHERE t = 'purchase' AND v IS NOT NULL),
    num AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o) AS i FROM ep),
    fold AS (SELECT s, 0::BIGINT AS i, []::BIGINT[] AS gone, NULL::BIGINT AS o, false AS ok FROM (SELECT DISTINCT s FROM num)
      UNION ALL SELECT f.s, n.i, CASE WHEN n.static_ok AND NOT list_has_any(f.gone, n.ids) THEN list_concat(f.gone, n.ids) ELSE f.gone END, n.o, n.static_ok AND NOT list_has_any(f.gone, n.ids)
      FROM fold f JOIN num n ON n.s = f.s AND n.i = f.i + 1)
    SELECT s AS session_ref, o AS episode_no, ok AS applied FROM fold WHERE i > 0""",
)
def apply_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_retractions(*_retraction_inputs(spark, sf_dir))[1]


@query(
    "apply_replacements",
    """WITH res AS (SELECT 'u' || (user_id % 50) AS session_ref, 'c' || (event_id // 60) AS call_id, event_id, event_id % 4 <> 0 AS active, event_id % 5 <> 0 AS replaceable FROM events WHERE event_type NOT IN ('view', 'signup')),
    rep AS (SELECT 'u' || (user_id % 50) AS session_ref, 'c' || (event_id // 60) AS call_id, max_by('new' || event_id, event_id) AS v FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1, 2),
    f AS (SELECT session_ref, call_id, count(*) AS n, count(*) FILTER (active) AS a, bool_and(replaceable) AS can FROM res GROUP BY 1, 2),
    g AS (SELECT session_ref, bool_or(NOT active) AS folded FROM res GROUP BY 1),
    o AS (SELECT r.*, CASE WHEN coalesce(n, 0) <> 1 OR NOT coalesce(can, false) THEN 'unsupported' WHEN a = 0 AND folded THEN 'inactive' WHEN a <> 1 THEN 'unsupported' ELSE 'applied' END AS outcome
      FROM rep r LEFT JOIN f USING (session_ref, call_id) LEFT JOIN g USING (session_ref))
    SELECT session_ref, call_id, outcome FROM o""",
)
def apply_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    base = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 50).alias("session_ref"), F.concat(F.lit("c"), F.expr("event_id div 60")).alias("call_id"),
        e.alias("record_no"), (e % 4 != 0).alias("active"), (e % 5 != 0).alias("replaceable"), F.lit("old").alias("output"),
        F.concat(F.lit("new"), e).alias("replacement"), "event_type",
    )
    is_new = F.col("event_type").isin("view", "signup")
    return A.apply_replacements(base.filter(~is_new), base.filter(is_new))[1]


def _mirror(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Model list: events of a user as (type, k mod 3); display list: every third session is a
    subsequence of it, others have one foreign message."""
    from convhist.operators.ordered import position, scan

    base = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), "user_id", "event_id",
        F.concat("event_type", F.get_json_object("props", "$.k").cast("bigint") % 3).alias("content_key"),
    )
    model = scan(base, ["session_ref"], "event_id", {"_p": position()}).select("session_ref", (F.col("_p") - 1).alias("ordinal"), "content_key")
    keep = base.filter("event_id % 4 <> 1").withColumn("content_key", F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 977 == 0), "foreign").otherwise(F.col("content_key")))
    display = scan(keep, ["session_ref"], "event_id", {"_p": position()}).select("session_ref", (F.col("_p") - 1).alias("ordinal"), "content_key")
    return model, display


@query(
    "reconcile_mirror",
    """WITH RECURSIVE base AS (SELECT 'u' || user_id AS s, user_id, event_id, event_type || (json_extract_string(props, '$.k')::BIGINT % 3) AS key FROM events),
    model AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY event_id) - 1 AS o, key FROM base),
    display AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY event_id) - 1 AS o, CASE WHEN user_id % 3 = 0 AND event_id % 977 = 0 THEN 'foreign' ELSE key END AS key FROM base WHERE event_id % 4 <> 1),
    fold AS (SELECT s, -1::BIGINT AS i, -1::BIGINT AS cur, true AS hit FROM (SELECT DISTINCT s FROM display)
      UNION ALL SELECT f.s, d.o, coalesce((SELECT min(m.o) FROM model m WHERE m.s = f.s AND m.key = d.key AND m.o > f.cur), f.cur), EXISTS (SELECT 1 FROM model m WHERE m.s = f.s AND m.key = d.key AND m.o > f.cur)
      FROM fold f JOIN display d ON d.s = f.s AND d.o = f.i + 1)
    SELECT s AS session_ref, bool_and(hit) AS matched, count(*) FILTER (hit AND i >= 0) AS hits, sum(CASE WHEN hit AND i >= 0 THEN cur ELSE 0 END)::BIGINT AS place_sum FROM fold GROUP BY s""",
)
def reconcile_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = A.reconcile_mirror(*_mirror(spark, sf_dir))
    return state.groupBy("session_ref").agg(
        F.bool_and(F.col("match").isNotNull()).alias("matched"), F.count("match").alias("hits"),
        F.coalesce(F.sum("match"), F.lit(0)).alias("place_sum"),
    )


@query(
    "merge_carriers",
    """WITH old AS (SELECT 's' || conv_id AS session_ref, 'm' || turn AS message_id, turn AS ordinal, CASE WHEN turn % 4 = 3 THEN NULL ELSE TIMESTAMP '2026-01-01' + to_minutes(turn) END AS ts, 'old' AS text FROM conversations WHERE conv_id % 3 <> 0 AND turn % 2 = 0),
    cur AS (SELECT 's' || conv_id AS session_ref, 'm' || turn AS message_id, turn AS ordinal, CASE WHEN turn % 5 = 4 THEN NULL ELSE TIMESTAMP '2026-01-01' + to_minutes(turn) END AS ts, 'new' AS text FROM conversations),
    extra AS (SELECT * FROM cur WHERE session_ref IN (SELECT session_ref FROM old) AND (session_ref, message_id) NOT IN (SELECT (session_ref, message_id) FROM old)),
    merged AS (SELECT *, 0 AS store FROM old UNION ALL SELECT *, 1 FROM cur WHERE session_ref NOT IN (SELECT session_ref FROM old) UNION ALL SELECT *, 1 FROM extra
      UNION ALL SELECT session_ref, '', -1, min_by(ts, ordinal), 'message_carriers.mixed', 2 FROM extra GROUP BY session_ref)
    SELECT session_ref, message_id, text, row_number() OVER (PARTITION BY session_ref ORDER BY ts IS NULL, ts, store, ordinal) AS line FROM merged""",
)
def merge_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convhist.operators.ordered import ranked

    t = F.col("turn")
    at = F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(turn as int), 0)")
    base = table(spark, sf_dir, "conversations").withColumn("session_ref", F.concat(F.lit("s"), "conv_id")).withColumn("message_id", F.concat(F.lit("m"), t))
    old = base.filter("conv_id % 3 <> 0 AND turn % 2 = 0").select("session_ref", "message_id", t.alias("ordinal"), F.when(t % 4 != 3, at).alias("ts"), F.lit("old").alias("text"))
    new = base.select("session_ref", "message_id", t.alias("ordinal"), F.when(t % 5 != 4, at).alias("ts"), F.lit("new").alias("text"))
    rows = A.merge_carriers(old, new)
    return ranked(rows, ["session_ref"], ["place"], "line").select("session_ref", "message_id", "text", "line")


@query(
    "inherit_history",
    """WITH RECURSIVE s AS (SELECT DISTINCT conv_id AS c, CASE WHEN conv_id % 4 <> 0 THEN conv_id - 1 END AS base, conv_id % 4 + 1 AS cut, conv_id % 11 = 0 AS compacted FROM conversations),
    pairs AS (SELECT c, c AS owner, NULL::BIGINT AS cutoff, 0::BIGINT AS distance FROM s
      UNION ALL SELECT p.c, s.base, least(p.cutoff, s.cut), p.distance + 1 FROM pairs p JOIN s ON s.c = p.owner WHERE s.base IS NOT NULL AND NOT s.compacted)
    SELECT 's' || p.c AS session_ref, 's' || p.owner AS owner, r.turn AS record_no, p.distance FROM pairs p JOIN conversations r ON r.conv_id = p.owner WHERE p.cutoff IS NULL OR r.turn < p.cutoff""",
)
def inherit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    raw = table(spark, sf_dir, "conversations")
    heads = raw.select("conv_id").distinct().select(
        F.concat(F.lit("s"), c).alias("session_ref"), F.when(c % 4 != 0, F.concat(F.lit("s"), c - 1)).alias("base_ref"),
        F.when(c % 4 != 0, c % 4 + 1).alias("cutoff"), (c % 11 == 0).alias("compacted"),
    )
    lines = raw.select(F.concat(F.lit("s"), c).alias("session_ref"), F.col("turn").alias("record_no"))
    return A.inherit_history(heads, lines).select("session_ref", "owner", "record_no", "distance")


@query(
    "inheritance_issues",
    """WITH s AS (SELECT conv_id AS c, max(turn) AS last, CASE WHEN conv_id % 4 <> 0 THEN conv_id - CASE WHEN conv_id % 12 = 5 THEN 1000000 ELSE 1 END END AS base, conv_id % 4 * 3 AS cut FROM conversations GROUP BY 1)
    SELECT 's' || a.c AS session_ref, CASE WHEN b.c IS NULL THEN 'base_missing' ELSE 'cutoff_outside' END AS issue FROM s a LEFT JOIN s b ON b.c = a.base WHERE a.base IS NOT NULL AND (b.c IS NULL OR a.cut > b.last + 1)""",
)
def inheritance_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    raw = table(spark, sf_dir, "conversations")
    base = F.concat(F.lit("s"), c - F.when(c % 12 == 5, 1000000).otherwise(1))
    heads = raw.select("conv_id").distinct().select(F.concat(F.lit("s"), c).alias("session_ref"), F.when(c % 4 != 0, base).alias("base_ref"), F.when(c % 4 != 0, c % 4 * 3).alias("cutoff"))
    return A.inheritance_issues(heads, raw.select(F.concat(F.lit("s"), c).alias("session_ref"), F.col("turn").alias("record_no")))


_MESSAGES = f"""{ITEMS}, msgs AS (SELECT *, lag(role) OVER w AS pr FROM items WHERE kind = 'message' WINDOW w AS (PARTITION BY session_ref ORDER BY ordinal)),
numbered AS (SELECT *, sum(CASE WHEN role IS DISTINCT FROM pr THEN 1 ELSE 0 END) OVER (PARTITION BY session_ref ORDER BY ordinal)::BIGINT AS run FROM msgs)"""


@query(
    "coalesce_runs",
    f"""WITH {_MESSAGES} SELECT session_ref, run, min(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text, min(ordinal) AS "first", max(ordinal) AS "last",
    last(ts ORDER BY ordinal) AS ts, coalesce(max_by(model, CASE WHEN model <> '' THEN ordinal END), '') AS model, count(*) - 1 AS merged FROM numbered GROUP BY session_ref, run""",
)
def coalesce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coalesce_runs(A.same_role_runs(items(spark, sf_dir).filter("kind = 'message'")))


@query(
    "split_inherited",
    f"""WITH {ITEMS}, p AS (SELECT *, CASE WHEN conv_id % 2 = 0 AND ordinal < 4 THEN 'inherited' ELSE 'own' END AS projection FROM items WHERE kind = 'message'),
    l AS (SELECT *, lag(role) OVER w AS pr, lag(projection) OVER w AS pp FROM p WINDOW w AS (PARTITION BY session_ref ORDER BY ordinal)),
    n AS (SELECT *, sum(CASE WHEN projection = 'inherited' AND role = 'user' AND pr = 'user' AND pp = 'inherited' THEN 0 ELSE 1 END) OVER (PARTITION BY session_ref ORDER BY ordinal)::BIGINT AS run FROM l)
    SELECT session_ref, projection, run, min(role) AS role, string_agg(text, chr(10) ORDER BY ordinal) AS text, count(*) - 1 AS merged FROM n GROUP BY 1, 2, 3""",
)
def split_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).filter("kind = 'message'")
    starts = rows.filter("conv_id % 2 = 0").select("session_ref").distinct().withColumn("start_ordinal", F.lit(4).cast("bigint"))
    split = A.split_inherited(rows, starts)
    return A.coalesce_runs(split, separator="\n", extra=["projection"]).select("session_ref", "projection", "run", "role", "text", "merged")


@query(
    "pending_evidence",
    """WITH e AS (SELECT 'u' || user_id AS session_ref, event_id AS ordinal, event_type AS t FROM events),
    m AS (SELECT *, min(CASE WHEN t = 'view' THEN ordinal END) OVER w AS a, min(CASE WHEN t = 'signup' THEN ordinal END) OVER w AS u FROM e
      WINDOW w AS (PARTITION BY session_ref ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT session_ref, ordinal, CASE WHEN a IS NOT NULL AND (u IS NULL OR a < u) THEN a ELSE -1 END AS attached_to FROM m WHERE t IN ('click', 'purchase', 'error')""",
)
def pending_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), F.col("event_id").alias("ordinal"),
        F.when(t.isin("view", "signup"), "message").otherwise("evidence").alias("kind"),
        F.when(t == "view", "assistant").when(t == "signup", "user").alias("role"),
    )
    found = A.pending_evidence(rows)
    return found.select("session_ref", "ordinal", F.coalesce("attached_to", F.lit(-1).cast("bigint")).alias("attached_to"))


@query(
    "ordinals_valid",
    """WITH r AS (SELECT 'u' || user_id AS session_ref, user_id, event_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 AND event_id % 50 = 3 THEN NULL WHEN user_id % 5 = 2 AND event_id % 40 = 9 THEN event_id - 500 ELSE event_id END AS d FROM events),
    l AS (SELECT *, lag(d) OVER (PARTITION BY session_ref ORDER BY event_id) AS p, min(event_id) OVER (PARTITION BY session_ref) AS f FROM r)
    SELECT session_ref, CASE WHEN count(d) = 0 THEN 'absent' WHEN count(d) <> count(*) THEN 'mixed' WHEN NOT bool_and(coalesce(d > p, true)) THEN 'not_increasing'
      WHEN min(CASE WHEN event_id = f THEN d END) <> min(CASE WHEN user_id % 5 = 3 THEN f + 1 ELSE f END) THEN 'wrong_start' ELSE 'ok' END AS status FROM l GROUP BY session_ref""",
)
def ordinals_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    base = table(spark, sf_dir, "events").withColumn("session_ref", F.concat(F.lit("u"), u))
    first = base.groupBy("session_ref").agg(F.min(e).alias("_f"))
    rows = base.join(first, "session_ref").select(
        "session_ref", e.alias("record_no"),
        F.when((u % 5 == 0) | ((u % 5 == 1) & (e % 50 == 3)), F.lit(None)).when((u % 5 == 2) & (e % 40 == 9), e - 500).otherwise(e).alias("declared"),
        (F.col("_f") + F.when(u % 5 == 3, 1).otherwise(0)).alias("expected_start"),
    )
    return A.ordinals_valid(rows)


_TIMES = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - to_days(2) ELSE ts END"


@query(
    "monotonic_times",
    f"""WITH t AS (SELECT 'u' || user_id AS session_ref, event_id, {_TIMES} AS ts FROM events),
    w AS (SELECT *, max(ts) OVER v AS mx, last_value(ts IGNORE NULLS) OVER v AS lv FROM t WINDOW v AS (PARTITION BY session_ref ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT session_ref, count(*) FILTER (ts IS NULL OR ts < lv) AS invalid_times, count(*) FILTER (ts < mx) AS below_maximum FROM w GROUP BY 1""",
)
def monotonic_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), e.alias("ordinal"),
        F.when(e % 17 == 0, F.lit(None)).when(e % 13 == 0, F.col("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts")).alias("ts"),
    )
    return A.monotonic_times(rows)


# Rule table of the derived record types: required keys, code, disposition, priority.
_RULES = [
    ("view", ["k"], "tool.call", "projected", 1), ("click", ["k", "odd"], "tool.result.odd", "projected", 1),
    ("click", ["k"], "tool.result", "projected", 2), ("purchase", ["missing"], "never", "projected", 1),
    ("purchase", [], "cost.record", "skipped", 2), ("error", ["odd"], "error.odd", "skipped", 1),
]


@query(
    "record_dispositions",
    f"""WITH {RECORDS}, c AS (SELECT session_ref, CASE WHEN type = 'view' THEN 'tool.call' WHEN type = 'click' AND k % 2 = 1 THEN 'tool.result.odd' WHEN type = 'click' THEN 'tool.result'
      WHEN type = 'purchase' THEN 'cost.record' WHEN type = 'error' AND k % 2 = 1 THEN 'error.odd' ELSE 'record.unknown' END AS code FROM records)
    SELECT session_ref, code, CASE WHEN code LIKE 'tool%' THEN 'projected' WHEN code = 'record.unknown' THEN 'unknown' ELSE 'skipped' END AS disposition, count(*) AS n FROM c GROUP BY 1, 2""",
)
def record_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "type string, required array<string>, code string, disposition string, priority int")
    rows = records(spark, sf_dir).select("session_ref", "type", F.array_compact(F.array(F.lit("k"), F.when(F.col("k") % 2 == 1, F.lit("odd")))).alias("fields"))
    return A.record_dispositions(rows, rules)


@query(
    "latest_links",
    f"""WITH {RECORDS} SELECT session_ref, 'a' || (k % 5) AS url, max_by('t' || k, record_no) AS title, max(record_no) AS record_no FROM records WHERE type NOT IN ('error', 'signup') GROUP BY 1, 2
    UNION ALL SELECT session_ref, '' AS url, max_by('t' || k, record_no), max(record_no) FROM records WHERE type IN ('error', 'signup') GROUP BY 1""",
)
def latest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("url", F.concat(F.lit("a"), F.col("k") % 5)).withColumn("title", F.concat(F.lit("t"), "k"))
    by_url = A.latest_links(rows.filter("type NOT IN ('error', 'signup')"), ["session_ref", "url"], "title")
    by_session = A.latest_links(rows.filter("type IN ('error', 'signup')"), ["session_ref"], "title").withColumn("url", F.lit(""))
    return by_url.unionByName(by_session)


@query(
    "gap_runs",
    """WITH e AS (SELECT 'u' || user_id AS session_ref, event_id AS o, event_type IN ('click', 'error', 'purchase', 'view') AS gap, event_type AS code FROM events),
    l AS (SELECT *, lag(gap) OVER (PARTITION BY session_ref ORDER BY o) AS pg FROM e),
    n AS (SELECT *, sum(CASE WHEN gap IS DISTINCT FROM pg THEN 1 ELSE 0 END) OVER (PARTITION BY session_ref ORDER BY o)::BIGINT AS run FROM l),
    c AS (SELECT session_ref, run, code, count(*) AS n, min(o) AS f FROM n WHERE gap GROUP BY 1, 2, 3)
    SELECT session_ref, run, min(f) AS "first", sum(n)::BIGINT AS gaps, string_agg(code || '=' || n, ',' ORDER BY f) AS counts, sum(n) >= 4 AS collapsed FROM c GROUP BY 1, 2""",
)
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("event_type") != "signup"
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), F.col("event_id").alias("ordinal"), F.when(gap, "gap").otherwise("message").alias("kind"),
        F.col("event_type").alias("code"), F.lit("").alias("label"),
    )
    return A.gap_runs(rows)


@query(
    "note_counts",
    f"""WITH {ITEMS}, c AS (SELECT session_ref, code, count(*) AS n FROM (SELECT session_ref, unnest(notes) AS code FROM items) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_ref ORDER BY n DESC, code) AS rank FROM c)
    SELECT session_ref, code, n, rank FROM r WHERE rank <= 2""",
)
def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.note_counts(items(spark, sf_dir), 2)[0]


@query(
    "note_counts_rest",
    f"""WITH {ITEMS}, c AS (SELECT session_ref, code, count(*) AS n FROM (SELECT session_ref, unnest(notes) AS code FROM items) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_ref ORDER BY n DESC, code) AS rank FROM c)
    SELECT session_ref, count(*) FILTER (rank > 2) AS other_codes, coalesce(sum(n) FILTER (rank > 2), 0)::BIGINT AS other_notes FROM r GROUP BY 1""",
)
def note_counts_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.note_counts(items(spark, sf_dir), 2)[1]


@query(
    "gap_code",
    """SELECT page_id, CASE WHEN regexp_full_match(h, '[A-Za-z0-9._-]{1,64}') THEN 'response.' || replace(lower(h), '-', '_') ELSE 'response.unclassified' END AS code
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'Kind-' || page_id || '.X_y' END AS h FROM pages)""",
)
def gap_code_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("Kind-"), "page_id", F.lit(".X_y")))
    return table(spark, sf_dir, "pages").select("page_id", gap_code("response", kind).alias("code"))


@query(
    "ambient_first_seen",
    f"WITH {RECORDS} SELECT session_ref, type || (k % 7) AS key, min(record_no) AS first_record, count(*) - 1 AS repeats FROM records GROUP BY 1, 2",
)
def ambient_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ambient_first_seen(records(spark, sf_dir).withColumn("key", F.concat("type", F.col("k") % 7)))
