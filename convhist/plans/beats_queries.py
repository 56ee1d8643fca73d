"""Queries: turn windows, cards, lineages' folding, budgets and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.text import token_estimate
from convhist.operators import beats as B
from convhist.operators import budget as J
from convhist.operators.ordered import ranked
from convhist.plans.bindings import ITEMS, SESSIONS, documents, items, sessions
from convhist.plans.catalog_queries import BLOCK_TYPE, event_blocks
from convhist.plans.registry import query
from convhist.session import materialize

_VISIBLE = "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"
_BEATS = f"""{ITEMS}, vis AS (SELECT *, {_VISIBLE} AS visible FROM items),
edges AS (
  SELECT *, lag(kind) OVER w AS pk, lag(ordinal) OVER w AS po, lag(visible) OVER w AS pv, lag(role) OVER w AS pr,
    lead(kind) OVER w AS nk, lead(ordinal) OVER w AS no, lead(visible) OVER w AS nv, lead(role) OVER w AS nr
  FROM vis WHERE kind = 'gap' OR role = 'user' WINDOW w AS (PARTITION BY session_ref ORDER BY ordinal)),
beats AS (
  SELECT e.session_ref, e.ordinal AS turn_start, e.ts AS user_ts, e.visible AS user_text,
    CASE WHEN nk = 'gap' THEN no ELSE greatest(e.ordinal, coalesce((SELECT max(a.ordinal) FROM vis a
      WHERE a.session_ref = e.session_ref AND a.kind = 'message' AND a.role = 'assistant' AND a.ordinal > e.ordinal
        AND a.ordinal < coalesce(no, 1000000000)), -1)) END AS turn_end,
    CASE WHEN pk = 'message' AND pv <> '' THEN po END AS previous_ordinal,
    CASE WHEN pk = 'message' AND pv <> '' THEN pv END AS previous_text,
    CASE WHEN nk = 'message' AND nv <> '' THEN no END AS next_ordinal,
    CASE WHEN nk = 'message' AND nv <> '' THEN nv END AS next_text
  FROM edges e WHERE kind = 'message' AND visible <> '')"""


@query(
    "beats",
    f"""WITH {_BEATS} SELECT session_ref, turn_start, turn_end, user_ts, user_text,
    coalesce(previous_ordinal, -1) AS previous_ordinal, coalesce(next_ordinal, -1) AS next_ordinal FROM beats""",
)
def beats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.beats(items(spark, sf_dir))
    return rows.select(
        "session_ref", "turn_start", "turn_end", "user_ts", "user_text",
        F.coalesce("previous_user_ordinal", F.lit(-1)).cast("bigint").alias("previous_ordinal"),
        F.coalesce("next_user_ordinal", F.lit(-1)).cast("bigint").alias("next_ordinal"),
    )


def cut_sql(column: str, limit: str) -> str:
    """UTF-8 prefix in SQL: drop characters from the end until the byte length fits."""
    return (
        f"CASE WHEN strlen({column}) <= {limit} THEN {column} ELSE left({column}, "
        f"(SELECT max(n) FROM generate_series(0, length({column})) g(n) WHERE strlen(left({column}, n::INT)) <= {limit})::INT) END"
    )


@query(
    "adjacent_user",
    f"""WITH {_BEATS} SELECT session_ref, turn_start, coalesce({cut_sql("previous_text", "3072")}, '') AS previous_text,
    coalesce(strlen(previous_text) > 3072, false) AS previous_truncated,
    coalesce({cut_sql("next_text", "3072")}, '') AS next_text, coalesce(strlen(next_text) > 3072, false) AS next_truncated
    FROM beats""",
)
def adjacent_user_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.beats(items(spark, sf_dir))
    return rows.select(
        "session_ref", "turn_start",
        F.coalesce("previous_user_text", F.lit("")).alias("previous_text"),
        F.coalesce("previous_user_truncated", F.lit(False)).alias("previous_truncated"),
        F.coalesce("next_user_text", F.lit("")).alias("next_text"),
        F.coalesce("next_user_truncated", F.lit(False)).alias("next_truncated"),
    )


_EVIDENCE = f"""{_BEATS}, said AS (
  SELECT b.session_ref, b.turn_start, 'after' AS side, v.ordinal, v.ts, v.visible
  FROM beats b JOIN edges e ON e.session_ref = b.session_ref AND e.ordinal = b.turn_start
  JOIN vis v ON v.session_ref = b.session_ref AND v.kind = 'message' AND v.role = 'assistant' AND v.visible <> ''
    AND v.ordinal > b.turn_start AND v.ordinal < coalesce(e.no, 1000000000)
  UNION ALL
  SELECT b.session_ref, b.turn_start, 'before', v.ordinal, v.ts, v.visible
  FROM beats b JOIN edges e ON e.session_ref = b.session_ref AND e.ordinal = b.turn_start
  JOIN vis v ON v.session_ref = b.session_ref AND v.kind = 'message' AND v.role = 'assistant' AND v.visible <> ''
    AND v.ordinal < b.turn_start AND v.ordinal > coalesce(e.po, -1)),
spent AS (
  SELECT *, CASE side WHEN 'after' THEN 6144 ELSE 4096 END
    - coalesce(sum(strlen(visible)) OVER (PARTITION BY session_ref, turn_start, side ORDER BY ordinal
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM said),
evidence AS (
  SELECT session_ref, turn_start, side, ordinal, ts, {cut_sql("visible", "budget")} AS text, strlen(visible) > budget AS truncated
  FROM spent WHERE budget > 0)"""


@query("assistant_evidence", f"WITH {_EVIDENCE} SELECT * FROM evidence")
def assistant_evidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.assistant_evidence(items(spark, sf_dir))


# Every non-ASCII character becomes one mark plus continuation marks, so positions are byte offsets.
_BYTES = (
    "regexp_replace(regexp_replace(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', chr(1)||chr(2)||chr(2)||chr(2), 'g'), "
    "'[\\x{800}-\\x{FFFF}]', chr(1)||chr(2)||chr(2), 'g'), '[\\x{80}-\\x{7FF}]', chr(1)||chr(2), 'g')"
)


@query(
    "split_text",
    f"""WITH RECURSIVE flat AS (SELECT doc_id, {_BYTES} AS b FROM documents),
    base AS (SELECT doc_id, b, length(b)::BIGINT AS total FROM flat WHERE length(b) > 0),
    cuts AS (
      SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS e, total FROM base
      UNION ALL
      SELECT doc_id, i + 1, e, CASE WHEN total - e <= 8192 THEN total
          WHEN para >= half THEN para + 2 WHEN line > half THEN line ELSE stop END, total
      FROM (SELECT *, e + (stop - e) // 2 AS half,
              CASE WHEN p2 = 0 THEN -1 ELSE e + length(seg1) - p2 - 1 END AS para,
              CASE WHEN p1 = 0 THEN -1 ELSE e + length(seg) - p1 + 1 END AS line
            FROM (SELECT *, strpos(reverse(seg1), chr(10) || chr(10)) AS p2, strpos(reverse(seg), chr(10)) AS p1
              FROM (SELECT *, substr(b, (e + 1)::INT, (stop - e)::INT) AS seg, substr(b, (e + 1)::INT, (stop - e + 1)::INT) AS seg1
                FROM (SELECT c.doc_id, c.i, c.e, c.total, t.b,
                    c.e + 8192 - CASE WHEN substr(t.b, (c.e + 8193)::INT, 1) <> chr(2) THEN 0
                      WHEN substr(t.b, (c.e + 8192)::INT, 1) <> chr(2) THEN 1
                      WHEN substr(t.b, (c.e + 8191)::INT, 1) <> chr(2) THEN 2 ELSE 3 END AS stop
                  FROM cuts c JOIN base t USING (doc_id) WHERE c.e < c.total))))
    )
    SELECT doc_id, i - 1 AS fragment_index, s AS byte_start, e AS byte_end FROM cuts WHERE i > 0""",
)
def split_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.split_text(documents(spark, sf_dir).select("doc_id", "text"), "text")
    return rows.select("doc_id", "fragment_index", "byte_start", "byte_end")


@query(
    "project_key",
    f"""WITH {SESSIONS} SELECT session_ref, 'project1_' || sha256(context) AS project_key FROM sessions""",
)
def project_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("session_ref", B.project_key(F.col("context")).alias("project_key"))


def duck_digest(parts: list[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({p})::VARCHAR) || ':' || ({p})::VARCHAR, '-1:')" for p in parts) + ")"


def duck_multiset(prefix: str, digest: str) -> str:
    lanes = " || '|' || ".join(
        f"sum(('0x' || substr({digest}, {start}, 16))::UBIGINT::HUGEINT)::VARCHAR" for start in (1, 17, 33, 49)
    )
    return f"'{prefix}' || sha256(count({digest})::VARCHAR || '|' || {lanes})"


_AT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
def logical_sql(source: str = "items", tools: str = "''") -> str:
    """SQL of the logical digests of a table of items without evidence; tools: digest of the tools of a row."""
    return f"""positions AS (
  SELECT *, {_VISIBLE} AS visible, row_number() OVER (PARTITION BY session_ref ORDER BY ordinal) AS pos FROM {source}),
logical AS (
  SELECT session_ref, {duck_multiset("logical1_", "d")} AS logical_digest FROM (
    SELECT session_ref, CASE WHEN kind = 'gap' THEN {duck_digest(["pos", "'gap'", _AT, duck_digest(["code", "label"])])}
      ELSE {duck_digest(["pos", "role", _AT, "sha256(visible)", tools, "''"])} END AS d FROM positions)
  GROUP BY session_ref)"""


LOGICAL = logical_sql()


@query("logical_digest", f"WITH {ITEMS}, {LOGICAL} SELECT * FROM logical")
def logical_digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.logical_digest(items(spark, sf_dir))


def _duck_framed(text: str) -> str:
    return f"strlen({text})::VARCHAR || ':' || {text}"


def _duck_struct(**members: str) -> str:
    """SQL of the canonical text of a struct whose members' canonical texts are given."""
    return "('{' || " + " || ".join(f"'{len(k)}:{k}' || {_duck_framed(f'({members[k]})')}" for k in sorted(members)) + " || '}')"


def _duck_list(*elements: str) -> str:
    return "('[' || " + " || ".join(_duck_framed(f"({e})") for e in elements) + " || ']')"


def _duck_string(text: str) -> str:
    return f"chr(34) || {text}"


_EVENT_REFERENCE = _duck_struct(type=_duck_string("'file'"), namespace=_duck_string("'fs'"), locator=_duck_string("'/f/' || event_id"))
_EVENT_WORK = _duck_struct(id=_duck_string("'w' || event_id"), status=_duck_string("'open'"), blocks=_duck_list(_duck_string("'b1'"), _duck_string("'b2'")))
_EVENT_EVIDENCE = f"""CASE event_type WHEN 'click' THEN {_duck_struct(kind=_duck_string("'reference'"), reference=_EVENT_REFERENCE)}
  WHEN 'purchase' THEN {_duck_struct(kind=_duck_string("'event'"), event=_duck_string("'bought'"), reason=_duck_string("'why ' || event_id"))}
  WHEN 'signup' THEN {_duck_struct(kind=_duck_string("'work_state'"), source_kind=_duck_string("'todo'"), work_items=_duck_list(_EVENT_WORK))}
  WHEN 'error' THEN {_duck_struct(kind=_duck_string("'reasoning'"), summary=_duck_list(_duck_string("'thought'"), _duck_string("''"), _duck_string("event_type")))} END"""


@query(
    "logical_digest_evidence",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, {_EVENT_EVIDENCE} AS said FROM events),
    d AS (SELECT user_id, {duck_digest(["pos", "'user'", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')", "sha256('saw ' || event_type)", "''", f"CASE WHEN said IS NULL THEN '' ELSE sha256({_duck_framed('said')}) END"])} AS d FROM e)
    SELECT 'u' || user_id AS session_ref, {duck_multiset("logical1_", "d")} AS logical_digest FROM d GROUP BY user_id""",
)
def logical_digest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as messages of a text block and a block of their own kind."""
    said = F.concat(F.lit("saw "), "event_type")
    text = F.from_json(F.to_json(F.struct(F.lit("text").alias("kind"), said.alias("text"))), BLOCK_TYPE)
    rows = event_blocks(spark, sf_dir).select(
        F.concat(F.lit("u"), "user_id").alias("session_ref"), F.col("event_id").alias("ordinal"), F.lit("message").alias("kind"), F.lit("user").alias("role"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("").alias("text"), F.lit("").alias("code"), F.lit("").alias("label"), F.array(text, "block").alias("blocks"),
    )
    return B.logical_digest(rows)


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    heads = sessions(spark, sf_dir).withColumn("source_revision", F.concat(F.lit("rev"), F.col("n_items")))
    lineages = heads.select("session_ref", F.concat(F.lit("lin"), F.col("conv_id") % 11).alias("lineage_ref"))
    return B.cards(B.beats(rows), B.assistant_evidence(rows), heads, lineages)


CARDS = f"""{SESSIONS.replace("items AS (", "items AS (", 1)}{_EVIDENCE[len(ITEMS):]},
lists AS (
  SELECT session_ref, turn_start,
    coalesce(list(struct_pack(ordinal := ordinal, text := text, truncated := truncated) ORDER BY ordinal) FILTER (side = 'before'), []) AS pa,
    coalesce(list(struct_pack(ordinal := ordinal, text := text, truncated := truncated) ORDER BY ordinal) FILTER (side = 'after'), []) AS aa
  FROM evidence GROUP BY ALL),
card_base AS (
  SELECT b.*, s.agent, s.context, 'rev' || s.n_items AS revision, 'lin' || (s.conv_id % 11) AS lineage_ref,
    coalesce(l.pa, []) AS pa, coalesce(l.aa, []) AS aa, {cut_sql("previous_text", "3072")} AS pt, {cut_sql("next_text", "3072")} AS nt,
    strftime(user_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp
  FROM beats b JOIN sessions s USING (session_ref) LEFT JOIN lists l USING (session_ref, turn_start)),
digested AS (
  SELECT *, 'content1_' || sha256(to_json(struct_pack(assistant := aa, fragment_index := 0::BIGINT, next_user := nt,
      omitted_tools := 0::BIGINT, preceding_assistant := pa, previous_user := pt, tools := '[]', turn_end := turn_end,
      turn_start := turn_start, user_text := user_text, user_ts := stamp))::VARCHAR) AS content_digest FROM card_base),
cards AS (
  SELECT *, 'card1_' || {duck_digest(["'beats/1'", "session_ref", "revision", "turn_start", "0", "content_digest"])} AS card_ref,
    'project1_' || sha256(context) AS project_key FROM digested),
requests AS (
  SELECT *, to_json(struct_pack(discovery_id := card_ref, agent := agent, project_key := project_key, context := context,
    "timestamp" := stamp, turn_start := turn_start, turn_end := turn_end, byte_start := 0::BIGINT,
    byte_end := strlen(user_text)::BIGINT, user_text := user_text, previous_user := pt, preceding_assistant := pa,
    assistant := aa, tools := '[]', omitted_tools := 0::BIGINT, next_user := nt))::VARCHAR AS request FROM cards),
sized AS (
  SELECT *, strlen(request)::BIGINT AS request_bytes,
    ceil((length(regexp_replace(request, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / 4 + (length(request)
      - length(regexp_replace(request, '[^\\x00-\\x7F]', '', 'g')))::DOUBLE) * 1.2::DOUBLE)::BIGINT + 16 AS estimated_tokens
  FROM requests)"""


@query(
    "cards",
    f"""WITH {CARDS} SELECT card_ref, content_digest, session_ref, turn_start, project_key, lineage_ref,
    request_bytes, estimated_tokens FROM sized""",
)
def cards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select(
        "card_ref", "content_digest", "session_ref", "turn_start", "project_key", "lineage_ref", "request_bytes",
        "estimated_tokens",
    )


@query(
    "fold_duplicates",
    f"""WITH {CARDS} SELECT lineage_ref, content_digest, min(card_ref) AS card_ref FROM sized GROUP BY 1, 2""",
)
def fold_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Folding reads the cards twice, so they are stored once.
    return B.fold_duplicates(materialize(_cards(spark, sf_dir))).select("lineage_ref", "content_digest", "card_ref")


@query(
    "corpus_profile",
    f"""WITH {CARDS}, {LOGICAL}, prof AS (SELECT s.*, l.logical_digest FROM sessions s JOIN logical l USING (session_ref)),
    agents AS (SELECT DISTINCT agent AS scope FROM sessions UNION ALL SELECT 'total')
    SELECT scope, (SELECT count(*) FROM prof WHERE scope IN (agent, 'total')) AS sessions,
      (SELECT count(*) FROM prof WHERE scope IN (agent, 'total') AND archived) AS archived,
      (SELECT min(updated_at) FROM prof WHERE scope IN (agent, 'total')) AS earliest,
      (SELECT max(updated_at) FROM prof WHERE scope IN (agent, 'total')) AS latest,
      (SELECT count(*) FROM sized WHERE scope IN (agent, 'total')) AS cards,
      (SELECT count(DISTINCT (session_ref, turn_start)) FROM sized WHERE scope IN (agent, 'total')) AS beats,
      (SELECT count(DISTINCT lineage_ref) FROM sized WHERE scope IN (agent, 'total')) AS lineages,
      (SELECT count(DISTINCT project_key) FROM sized WHERE scope IN (agent, 'total')) AS projects,
      (SELECT count(*) FROM sized c WHERE scope IN (agent, 'total') AND card_ref = (SELECT min(card_ref) FROM sized d
         WHERE d.lineage_ref = c.lineage_ref AND d.content_digest = c.content_digest)) AS queued,
      (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM prof WHERE scope IN (agent, 'total') GROUP BY logical_digest)) AS duplicates,
      (SELECT count(*) FROM sized WHERE scope IN (agent, 'total')) - (SELECT count(*) FROM sized c WHERE scope IN (agent, 'total')
         AND card_ref = (SELECT min(card_ref) FROM sized d WHERE d.lineage_ref = c.lineage_ref AND d.content_digest = c.content_digest)) AS folded
    FROM agents""",
)
def corpus_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    card_rows = materialize(_cards(spark, sf_dir))
    session_rows = sessions(spark, sf_dir).join(B.logical_digest(items(spark, sf_dir)), "session_ref")
    return B.corpus_profile(session_rows, card_rows, B.fold_duplicates(card_rows))


# Breadth-first order of the rows of docs in each stratum.
SPREAD = """indexed AS (
  SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY project_key, lineage_ref) AS n
  FROM docs WINDOW w AS (PARTITION BY project_key, lineage_ref ORDER BY user_ts, card_ref)),
bisect AS (
  SELECT DISTINCT n, 0::BIGINT AS low, n - 1 AS high, 0 AS lvl FROM indexed WHERE n > 0
  UNION ALL
  SELECT n, CASE WHEN h.half = 0 THEN low ELSE (low + high) // 2 END, CASE WHEN h.half = 0 THEN (low + high) // 2 ELSE high END, lvl + 1
  FROM bisect, (VALUES (0), (1)) h(half) WHERE high - low > 1),
depths AS (
  SELECT n, (low + high) // 2 AS idx, lvl + 1 AS depth FROM bisect WHERE high - low > 1
  UNION ALL SELECT DISTINCT n, 0, -1 FROM indexed UNION ALL SELECT DISTINCT n, n - 1, 0 FROM indexed WHERE n > 1),
spread AS (
  SELECT i.*, d.depth::BIGINT AS depth, row_number() OVER (PARTITION BY project_key, lineage_ref ORDER BY d.depth, i.idx) AS place
  FROM indexed i JOIN depths d ON d.n = i.n AND d.idx = i.idx),
stratified AS (
  SELECT *, dense_rank() OVER (PARTITION BY project_key ORDER BY lineage_ref) AS lineage_rank FROM spread)"""
# Strata of the spread queries: source and language of a document, ordered by size and id.
_DOC_CARDS = f"""docs AS (
  SELECT doc_id::VARCHAR AS card_ref, source AS project_key, lang AS lineage_ref, n_chars AS user_ts,
    ceil((length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / 4 + (length(text)
      - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::DOUBLE) * 1.2::DOUBLE)::BIGINT + 16 AS estimated_tokens
  FROM documents),
{SPREAD}"""


def _doc_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("card_ref"), F.col("source").alias("project_key"),
        F.col("lang").alias("lineage_ref"), F.col("n_chars").alias("user_ts"),
        token_estimate(F.col("text")).alias("estimated_tokens"),
    )


@query(
    "temporal_spread",
    f"""WITH RECURSIVE {_DOC_CARDS} SELECT card_ref, project_key, lineage_ref, n AS stratum_size, depth AS spread_depth,
    idx AS spread_index FROM spread""",
)
def temporal_spread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.temporal_spread(_doc_cards(spark, sf_dir), ["project_key", "lineage_ref"], ["user_ts", "card_ref"])
    return rows.select("card_ref", "project_key", "lineage_ref", "stratum_size", "spread_depth", "spread_index")


@query(
    "stratified_order",
    f"""WITH RECURSIVE {_DOC_CARDS} SELECT card_ref, place AS spread_place, lineage_rank, project_key FROM stratified""",
)
def stratified_order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stratified_order(_doc_cards(spark, sf_dir)).select(
        "card_ref", "spread_place", "lineage_rank", "project_key"
    )


PLAN = """queue AS (
  SELECT *, row_number() OVER (ORDER BY place, lineage_rank, project_key) AS q FROM stratified),
fold AS (
  SELECT 0::BIGINT AS q, 0::BIGINT AS total, 0::BIGINT AS requests, 0::BIGINT AS cur, 0::BIGINT AS k
  UNION ALL
  SELECT n.q, n.total, n.requests, n.cur, n.k FROM (
    SELECT c.q, f.total + c.estimated_tokens + CASE WHEN fresh THEN 1200 ELSE 0 END AS total,
      f.requests + CASE WHEN fresh THEN 1 ELSE 0 END AS requests,
      CASE WHEN fresh THEN 1200 ELSE f.cur END + c.estimated_tokens AS cur, CASE WHEN fresh THEN 1 ELSE f.k + 1 END AS k
    FROM fold f JOIN queue c ON c.q = f.q + 1,
      LATERAL (SELECT f.q = 0 OR f.k >= 8 OR f.cur + c.estimated_tokens > 300000 AS fresh)) n
  WHERE n.total <= 500000)"""


@query(
    "plan_budget",
    f"""WITH RECURSIVE {_DOC_CARDS}, {PLAN}, last AS (SELECT * FROM fold ORDER BY q DESC LIMIT 1)
    SELECT (SELECT count(*) FROM docs) AS total_cards, q AS selected_cards, (SELECT count(*) FROM docs) - q AS remaining_cards,
      total AS fast_input_tokens, requests AS fast_requests,
      CASE WHEN q = 0 OR q < (SELECT count(*) FROM docs) THEN 0 ELSE 128000 END::BIGINT AS deep_input_tokens,
      CASE WHEN q = 0 OR q < (SELECT count(*) FROM docs) THEN 0 ELSE 4 END::BIGINT AS deep_requests FROM last""",
)
def plan_budget_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.plan_budget(J.stratified_order(_doc_cards(spark, sf_dir)), 500_000, request_tokens=300_000)[1]


@query(
    "plan_budget_cards",
    f"""WITH RECURSIVE {_DOC_CARDS}, {PLAN} SELECT f.q - 1 AS place, c.card_ref, f.requests AS request_no, c.estimated_tokens AS tokens
    FROM fold f JOIN queue c USING (q) WHERE f.q > 0""",
)
def plan_budget_cards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.plan_budget(J.stratified_order(_doc_cards(spark, sf_dir)), 500_000, request_tokens=300_000)[0]


@query(
    "pack_batches",
    f"""WITH RECURSIVE {_DOC_CARDS}, line AS (
      SELECT *, row_number() OVER (PARTITION BY lineage_ref ORDER BY card_ref) - 1 AS pos FROM docs),
    fold AS (
      SELECT lineage_ref, pos, 1::BIGINT AS batch_no, estimated_tokens AS cur, 1::BIGINT AS k FROM line WHERE pos = 0
      UNION ALL
      SELECT c.lineage_ref, c.pos, f.batch_no + CASE WHEN fresh THEN 1 ELSE 0 END,
        CASE WHEN fresh THEN c.estimated_tokens ELSE f.cur + c.estimated_tokens END, CASE WHEN fresh THEN 1 ELSE f.k + 1 END
      FROM fold f JOIN line c ON c.lineage_ref = f.lineage_ref AND c.pos = f.pos + 1,
        LATERAL (SELECT f.k >= 8 OR f.cur + c.estimated_tokens > 300000 - 1200 AS fresh))
    SELECT lineage_ref, pos, batch_no FROM fold""",
)
def pack_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(_doc_cards(spark, sf_dir), ["lineage_ref"], ["card_ref"], "_rank")
    rows = rows.withColumn("pos", F.col("_rank") - 1)
    packed = J.pack_batches(rows, ["lineage_ref"], "pos", "estimated_tokens", 300_000)
    return packed.select("lineage_ref", "pos", "batch_no")
