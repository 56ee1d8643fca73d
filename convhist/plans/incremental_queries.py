"""Queries: fingerprints, snapshot diffs, incremental rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.operators import incremental as E
from convhist.plans.beats_queries import duck_digest, duck_multiset
from convhist.plans.bindings import EDGES, ITEMS, SESSIONS, items, session_edges, sessions, table
from convhist.plans.registry import query
from convhist.session import materialize


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata derived from the pages: one file per page, grouped into sessions by the id."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("s"), (p % 40)).alias("session_ref"), F.col("url").alias("path"),
        F.when(p % 5 == 0, "main").otherwise("auxiliary").alias("role"),
        F.octet_length("html").cast("bigint").alias("size"), (p * 1000).alias("modified"),
    )


_FILES = """files AS (SELECT 's' || (page_id % 40) AS session_ref, url AS path, CASE WHEN page_id % 5 = 0 THEN 'main' ELSE 'auxiliary' END AS role,
  strlen(html)::BIGINT AS size, page_id * 1000 AS modified FROM pages)"""


@query(
    "fingerprint_sources",
    f"""WITH {_FILES} SELECT session_ref, {duck_multiset("files1_", "d")} AS fingerprint, count(*) AS files
    FROM (SELECT session_ref, {duck_digest(["path", "role", "size", "modified"])} AS d FROM files) GROUP BY session_ref""",
)
def fingerprint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fingerprint_sources(_files(spark, sf_dir))


def _component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("session_ref", F.concat(F.lit("g"), F.floor(F.col("conv_id") / 5)).alias("component_ref"))


@query(
    "fingerprint_rows",
    f"""WITH {SESSIONS}, {EDGES},
    i AS (SELECT session_ref, {duck_multiset("rows1_", "d")} AS f FROM (SELECT session_ref, {duck_digest(["ordinal", "role", "text"])} AS d FROM items) GROUP BY 1),
    e AS (SELECT session_ref, {duck_multiset("rows1_", "d")} AS f FROM (SELECT session_ref, {duck_digest(["parent_ref"])} AS d FROM session_edges) GROUP BY 1),
    own AS (SELECT s.session_ref, 'g' || (conv_id // 5) AS component_ref, {duck_digest([duck_digest(["title", "model"]), "coalesce(i.f, '')", "coalesce(e.f, '')"])} AS fp
      FROM sessions s LEFT JOIN i USING (session_ref) LEFT JOIN e USING (session_ref)),
    shared AS (SELECT component_ref, {duck_multiset("component1_", "d")} AS sh FROM (SELECT component_ref, {duck_digest(["session_ref", "fp"])} AS d FROM own) GROUP BY 1)
    SELECT session_ref, {duck_digest(["fp", "sh"])} AS fingerprint FROM own JOIN shared USING (component_ref)""",
)
def fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = {
        "items": (items(spark, sf_dir), ["ordinal", "role", "text"]),
        "edges": (session_edges(spark, sf_dir), ["parent_ref"]),
    }
    return E.fingerprint_rows(sessions(spark, sf_dir), ["title", "model"], children, _component(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current): the previous one misses some sessions, has stale ones and removed ones."""
    rows = sessions(spark, sf_dir)
    mark = lambda df, stale: df.select("session_ref", "agent", F.concat(F.col("n_items"), F.lit(":"), F.col("model"), stale).alias("fingerprint"))
    current = mark(rows, F.lit(""))
    old = mark(rows.filter("conv_id % 11 <> 0"), F.when(F.col("conv_id") % 7 == 0, "stale").otherwise(""))
    gone = mark(rows.filter("conv_id % 9 = 0").withColumn("session_ref", F.concat("session_ref", F.lit("z"))), F.lit(""))
    return old.unionByName(gone), current


_SNAPSHOTS = """cur AS (SELECT session_ref, agent, n_items || ':' || model AS fingerprint, conv_id FROM sessions),
prev AS (SELECT session_ref, agent, fingerprint || CASE WHEN conv_id % 7 = 0 THEN 'stale' ELSE '' END AS fingerprint FROM cur WHERE conv_id % 11 <> 0
  UNION ALL SELECT session_ref || 'z', agent, fingerprint FROM cur WHERE conv_id % 9 = 0),
changes AS (SELECT coalesce(c.session_ref, p.session_ref) AS session_ref, CASE WHEN c.session_ref IS NULL THEN 'removed'
  WHEN c.fingerprint = p.fingerprint THEN 'reused' ELSE 'rebuilt' END AS change FROM cur c FULL JOIN prev p USING (session_ref))"""


@query("classify_snapshot", f"WITH {SESSIONS}, {_SNAPSHOTS} SELECT * FROM changes")
def classify_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classify_snapshot(*_snapshots(spark, sf_dir))


@query(
    "diff_snapshots",
    f"""WITH {SESSIONS}, {_SNAPSHOTS} SELECT count(*) FILTER (change = 'reused') AS reused, count(*) FILTER (change = 'rebuilt') AS rebuilt,
    count(*) FILTER (change = 'removed') AS removed FROM changes""",
)
def diff_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diff_snapshots(*_snapshots(spark, sf_dir))


@query(
    "rescan_changed",
    f"""WITH {SESSIONS} SELECT count(*) FILTER (conv_id % 10 NOT IN (0, 8, 9)) AS reused, count(*) FILTER (conv_id % 10 IN (0, 9)) AS rebuilt, count(*) FILTER (conv_id % 10 = 8) AS removed FROM sessions""",
)
def rescan_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a stored snapshot in which some sessions had another text, some did not exist, and some that are gone now did."""
    heads, rows, c = sessions(spark, sf_dir), items(spark, sf_dir), F.col("conv_id")
    revision = lambda h, i: E.source_revision(h, E.item_digest(i)).withColumnRenamed("revision", "fingerprint")
    other = F.when((c % 10 == 0) & (F.col("ordinal") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = materialize(revision(heads.filter(c % 10 != 9), rows.filter(c % 10 != 9).withColumn("text", other)))
    return E.diff_snapshots(before, revision(heads.filter(c % 10 != 8), rows.filter(c % 10 != 8)))


@query(
    "rebuild_changed",
    f"""WITH {SESSIONS}, cached AS (SELECT session_ref, 'r' || n_items AS revision, -1::BIGINT AS user_turns, CASE WHEN conv_id % 5 = 0 THEN 'v0' ELSE 'v1' END AS version
      FROM sessions WHERE conv_id % 3 <> 0)
    SELECT s.session_ref, 'r' || s.n_items AS revision, 'v1' AS version, coalesce(c.user_turns,
      (SELECT count(*) FROM items i WHERE i.session_ref = s.session_ref AND i.role = 'user')) AS user_turns
    FROM sessions s LEFT JOIN cached c ON c.session_ref = s.session_ref AND c.version = 'v1'""",
)
def rebuild_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir)
    revision = F.concat(F.lit("r"), "n_items")
    cached = rows.filter("conv_id % 3 <> 0").select(
        "session_ref", revision.alias("revision"), F.lit(-1).cast("bigint").alias("user_turns"),
        F.when(F.col("conv_id") % 5 == 0, "v0").otherwise("v1").alias("version"),
    )

    def build(pending: DataFrame) -> DataFrame:
        turns = items(spark, sf_dir).filter("role = 'user'").groupBy("session_ref").agg(F.count(F.lit(1)).alias("user_turns"))
        return pending.join(turns, "session_ref", "left").select(
            "session_ref", "revision", F.coalesce("user_turns", F.lit(0).cast("bigint")).alias("user_turns")
        )

    return E.rebuild_changed(rows.select("session_ref", revision.alias("revision")), cached, "v1", build)


@query(
    "removed_rows",
    f"""WITH {SESSIONS}, {_SNAPSHOTS} SELECT session_ref, NOT (agent IN ('event_log', 'table_store') AND session_ref NOT IN (SELECT session_ref FROM cur)) AS kept FROM prev""",
)
def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, current = _snapshots(spark, sf_dir)
    kept, removed = E.removed_rows(previous, current, ["event_log", "table_store"])
    return kept.select("session_ref", F.lit(True).alias("kept")).unionByName(removed.select("session_ref", F.lit(False).alias("kept")))


_D = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query(
    "source_revision",
    f"""WITH {SESSIONS}, d AS (SELECT session_ref, {duck_multiset("items1_", "d")} AS item_digest FROM (SELECT session_ref,
      {duck_digest(["ordinal", "kind", "role", "text", _D.format("ts"), "model", "code"])} AS d FROM items) GROUP BY 1)
    SELECT session_ref, 'revision1_' || {duck_digest(["session_ref", "agent", "native_id", "context", "model", "provider", _D.format("created_at"), _D.format("updated_at"), "archived", "item_digest"])} AS revision
    FROM sessions JOIN d USING (session_ref)""",
)
def source_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.source_revision(sessions(spark, sf_dir), E.item_digest(items(spark, sf_dir)))
