"""Queries: quotes, evidence validation, grouping, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.text import normalize_phrase
from convhist.operators import budget as J
from convhist.operators import evidence as K
from convhist.operators import groups as L
from convhist.operators.ordered import next_value, ranked, scan
from convhist.plans.beats_queries import duck_digest
from convhist.plans.bindings import pick, table
from convhist.plans.registry import query
from convhist.sources import review as R


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per user turn with the text of the next user turn."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    rows = scan(rows, ["conv_id"], "turn", {"_n": next_value(F.struct("turn", "text"))})
    c, t = F.col("conv_id"), F.col("turn")
    at = lambda turn: F.expr("timestamp_ntz'2026-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), c.cast("int"), turn.cast("int"), F.lit(0))
    return rows.select(
        F.concat(F.lit("c"), c, F.lit("-"), t).alias("card_ref"), "conv_id", t.alias("turn_start"), F.col("text").alias("user_text"),
        F.col("_n.text").alias("next_user_text"), F.col("_n.turn").alias("next_ordinal"), at(t).alias("user_ts"), at(F.col("_n.turn")).alias("next_ts"),
        F.concat(F.lit("s"), c).alias("session_ref"), F.concat(F.lit("l"), c % 13).alias("lineage_ref"), F.concat(F.lit("p"), c % 7).alias("project_key"),
        F.concat(F.lit("corpus"), c % 3).alias("corpus"),
    )


_CARDS = """cards AS (
  SELECT 'c' || conv_id || '-' || turn AS card_ref, conv_id, turn AS turn_start, text AS user_text, lead(text) OVER w AS next_user_text, lead(turn) OVER w AS next_ordinal,
    TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(turn) AS user_ts, TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(lead(turn) OVER w) AS next_ts,
    's' || conv_id AS session_ref, 'l' || (conv_id % 13) AS lineage_ref, 'p' || (conv_id % 7) AS project_key, 'corpus' || (conv_id % 3) AS corpus
  FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""

_TRIM = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_QUOTES = f"""{_CARDS}, sources AS (
  SELECT card_ref, 'user_text' AS source, user_text AS text FROM cards UNION ALL SELECT card_ref, 'next_user', next_user_text FROM cards WHERE next_user_text IS NOT NULL),
classes AS (SELECT card_ref, source, text, list_aggregate(list_transform(string_split(text, ''), lambda c: CASE
    WHEN c = chr(13) THEN 'R' WHEN c IN (chr(10), chr(133), chr(8232), chr(8233)) THEN 'P' WHEN regexp_matches(c, '^[\\s\\x0b\\p{{Zs}}]$') THEN 'W'
    WHEN regexp_matches(c, '^[\\p{{Lu}}\\p{{Lt}}]$') THEN 'U' WHEN regexp_matches(c, '^\\p{{Ll}}$') THEN 'L' WHEN regexp_matches(c, '^[\\p{{L}}\\p{{Nl}}]$') THEN 'O'
    WHEN regexp_matches(c, '^\\p{{Nd}}$') THEN 'N' WHEN c IN ('.', '․', '﹒', '．') THEN 'A' WHEN c IN ('!', '?', '。', '！', '？', '؟', '۔', '‼', '⁇', '｡') THEN 'S'
    WHEN regexp_matches(c, '^[\\p{{Ps}}\\p{{Pe}}\\p{{Pi}}\\p{{Pf}}"'']$') THEN 'C' WHEN c IN (',', '-', ':', '–', '—', '、', '，', '：') THEN 'K' ELSE 'X' END), 'string_agg', '') AS cls
  FROM sources WHERE text <> ''),
breaks AS (SELECT card_ref, source, text, list_filter(range(1, length(text)), lambda i: CASE
    WHEN substr(cls, i::INT, 1) = 'P' THEN true
    WHEN substr(cls, i::INT, 1) = 'R' THEN substr(cls, (i + 1)::INT, 1) <> 'P'
    WHEN NOT regexp_matches(left(cls, i::INT), '[AS]C*W*$') OR regexp_matches(substr(cls, (i + 1)::INT, 1), '[WPRASK]') THEN false
    WHEN substr(cls, (i + 1)::INT, 1) = 'C' AND substr(cls, i::INT, 1) <> 'W' THEN false
    WHEN regexp_matches(left(cls, i::INT), 'SC*W*$') THEN true
    ELSE NOT (regexp_matches(left(cls, i::INT), 'A$') AND substr(cls, (i + 1)::INT, 1) = 'N' OR regexp_matches(left(cls, i::INT), '[UL]A$') AND substr(cls, (i + 1)::INT, 1) = 'U')
      AND NOT regexp_matches(substr(cls, (i + 1)::INT), '^[^OULPRSA]*L') END) AS b FROM classes),
bounds AS (SELECT card_ref, source, text, list_concat(list_concat([0::BIGINT], b), [length(text)::BIGINT]) AS b FROM breaks),
raw AS (SELECT card_ref, source, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
  SELECT card_ref, source, list_transform(range(1, len(b)), lambda j: substr(text, (b[j] + 1)::INT, (b[j + 1] - b[j])::INT)) AS p FROM bounds)),
cutp AS (SELECT card_ref, source, i, g.k AS k, substr(piece, (g.k * 900 + 1)::INT, 900) AS piece FROM raw, LATERAL (SELECT unnest(range(0, greatest(ceil(length(piece) / 900.0)::BIGINT, 1))) AS k) g),
pieces AS (SELECT card_ref, source, piece, row_number() OVER (PARTITION BY card_ref, source ORDER BY i, k) AS n, {_TRIM.format("piece")} = '' AS blank FROM cutp),
fold AS (
  SELECT DISTINCT card_ref, source, 0::BIGINT AS n, '' AS cur, []::VARCHAR[] AS outs FROM pieces
  UNION ALL
  SELECT f.card_ref, f.source, p.n,
    CASE WHEN p.blank THEN CASE WHEN f.cur = '' THEN '' ELSE f.cur || p.piece END WHEN length(g.grown) >= 450 THEN '' ELSE g.grown END,
    CASE WHEN p.blank THEN f.outs ELSE list_concat(f.outs, list_concat(CASE WHEN g.big THEN [f.cur] ELSE [] END, CASE WHEN length(g.grown) >= 450 THEN [g.grown] ELSE [] END)) END
  FROM fold f JOIN pieces p ON p.card_ref = f.card_ref AND p.source = f.source AND p.n = f.n + 1,
    LATERAL (SELECT f.cur <> '' AND length(f.cur) + length(p.piece) > 900 AS big, CASE WHEN f.cur <> '' AND length(f.cur) + length(p.piece) > 900 THEN p.piece ELSE f.cur || p.piece END AS grown) g),
final AS (SELECT card_ref, source, list_append(max_by(outs, n), max_by(cur, n)) AS outs FROM fold GROUP BY ALL),
flat AS (SELECT card_ref, source, unnest(outs) AS q, generate_subscripts(outs, 1) AS i FROM final),
quotes AS (SELECT card_ref, source, {_TRIM.format("q")} AS text, row_number() OVER (PARTITION BY card_ref ORDER BY source DESC, i) - 1 AS n FROM flat WHERE {_TRIM.format("q")} <> '')"""


@query("quote_candidates", f"WITH RECURSIVE {_QUOTES} SELECT card_ref, 'u' || n AS quote_id, source, text FROM quotes")
def quote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.quote_candidates(_cards(spark, sf_dir))


@query("verify_quotes", f"WITH RECURSIVE {_QUOTES} SELECT card_ref, 'u' || n AS quote_id, n % 5 <> 4 AS exact FROM quotes")
def verify_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards(spark, sf_dir)
    number = F.substring("quote_id", 2, 10).cast("int")
    quotes = K.quote_candidates(cards).withColumn("text", F.when(number % 5 == 4, F.concat("text", F.lit("\u0001"))).otherwise(F.col("text")))
    return K.verify_quotes(quotes, cards).select("card_ref", "quote_id", "exact")


def label_by_rule(frame):
    """Default rule-based labeller: one event per card, topic and lens from the text length."""
    import json

    def respond(text: str) -> str:
        n = len(text)
        event = {
            "topic": K.TOPICS[n % len(K.TOPICS)], "basis": K.BASES[n % len(K.BASES)], "lenses": [K.LENSES[n % len(K.LENSES)]],
            "observation": f"{n} characters", "behavior_signature": {"situation": "reading", "behavior": "asking", "target": "text"}, "user_quote_ids": ["u0"],
        }
        return json.dumps({"task_anchor": f"length {n % 10}", "episode_summary": "one turn", "events": [event]})

    return frame.assign(response=frame["user_text"].map(respond))


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "label_cards",
    f"""WITH {_CARDS} SELECT card_ref, 'length ' || (length(user_text) % 10) AS task_anchor, ({_LIST(K.TOPICS)})[length(user_text) % 12 + 1] AS topic,
    ({_LIST(K.BASES)})[length(user_text) % 8 + 1] AS basis, ({_LIST(K.LENSES)})[length(user_text) % 6 + 1] AS lens, length(user_text) || ' characters' AS observation FROM cards""",
)
def label_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards(spark, sf_dir).withColumn("tokens", F.length("user_text").cast("bigint"))
    line = ranked(cards, ["corpus"], ["card_ref"], "_r").withColumn("pos", F.col("_r") - 1)
    batches = J.pack_batches(line, ["corpus"], "pos", "tokens", 6_000)
    batches = batches.withColumn("request_no", F.concat("corpus", F.lit("/"), "batch_no"))
    responses = K.label_cards(batches.select("request_no", "card_ref", "user_text"), label_by_rule, "request_no")
    quotes = K.quote_candidates(cards).groupBy("card_ref").agg(F.collect_list("quote_id").alias("quote_ids"))
    _, valid, _ = K.validate_evidence(quotes, responses)
    return valid.select("card_ref", "task_anchor", "topic", "basis", F.element_at("lenses", 1).alias("lens"), "observation")


def _raw_responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Responses with planted defects, chosen by (conversation + turn) mod 10."""
    m = (F.col("conv_id") + F.col("turn_start")) % 10
    base = _cards(spark, sf_dir).withColumn("m", m)
    event = F.concat(
        F.lit('{"topic":"'), F.when(m == 1, "cooking").otherwise("general"), F.lit('","basis":"task_request","lenses":'),
        F.when(m == 2, '["style","style"]').when(m == 3, "[]").otherwise('["style","scope"]'), F.lit(',"observation":"seen","behavior_signature":{"situation":"a","behavior":"'),
        F.when(m == 4, " ").otherwise("b"), F.lit('","target":"c"},"user_quote_ids":'), F.when(m == 5, '["u0","u7"]').otherwise('["u0"]'),
        F.when(m == 6, ',"extra":1').otherwise(""), F.lit("}"),
    )
    events = F.when(m == 7, "").otherwise(event)
    response = F.concat(F.lit('{"task_anchor":"'), F.when(m == 8, F.repeat(F.lit("x"), 201)).otherwise("anchor"), F.lit('","episode_summary":"sum","events":['), events, F.lit("]}"))
    asked = base.select("card_ref", F.array(F.lit("u0"), F.lit("u1")).alias("quote_ids"))
    answers = base.filter("m <> 9").select("card_ref", response.alias("response")).unionByName(
        base.filter("m = 9").select(F.concat("card_ref", F.lit("?")).alias("card_ref"), response.alias("response"))
    )
    return asked, answers


@query(
    "validate_evidence",
    f"""WITH {_CARDS} SELECT card_ref, ['', 'event.topic', 'event.lenses', 'event.lenses', 'event.signature', 'event.quotes', 'event.keys', 'events.count', 'task_anchor', 'missing'][(conv_id + turn_start) % 10 + 1] AS issues, false AS discarded FROM cards
    UNION ALL SELECT card_ref || '?', '', true FROM cards WHERE (conv_id + turn_start) % 10 = 9""",
)
def validate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _, discarded = K.validate_evidence(*_raw_responses(spark, sf_dir))
    return report.select("card_ref", F.array_join("issues", ",").alias("issues"), F.lit(False).alias("discarded")).unionByName(
        discarded.select("card_ref", F.lit("").alias("issues"), F.lit(True).alias("discarded"))
    )


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cards and one or two labelled events per card (none for every eleventh conversation)."""
    cards = _cards(spark, sf_dir)
    c, t = F.col("conv_id"), F.col("turn_start")
    rows = cards.filter("conv_id % 11 <> 5").withColumn("event_index", F.explode(F.sequence(F.lit(0).cast("bigint"), t % 2)))
    i = F.col("event_index")
    source = F.when((i == 1) & F.col("next_ordinal").isNotNull(), "next_user").otherwise("user_text")
    events = rows.select(
        "card_ref", F.concat(F.lit("Ｔask  "), c % 5).alias("task_anchor"), "event_index", pick(K.TOPICS, (c + t + i) % 12).alias("topic"),
        pick(K.BASES, (c + i) % 8).alias("basis"), F.array(pick(K.LENSES, c % 6)).alias("lenses"), F.concat(F.lit("obs"), t).alias("observation"),
        F.array(F.struct(source.alias("source"), F.lit("q").alias("text"))).alias("quotes"),
    )
    return cards, events


_S = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_OCC = f"""{_CARDS}, ev AS (SELECT c.*, e.i AS event_index, ({_LIST(K.TOPICS)})[(conv_id + turn_start + e.i) % 12 + 1] AS topic, ({_LIST(K.BASES)})[(conv_id + e.i) % 8 + 1] AS basis,
  ({_LIST(K.LENSES)})[conv_id % 6 + 1] AS lens, 'obs' || turn_start AS observation, CASE WHEN e.i = 1 AND next_ordinal IS NOT NULL THEN 'next_user' ELSE 'user_text' END AS source
  FROM cards c, LATERAL (SELECT unnest(range(0, turn_start % 2 + 1)) AS i) e WHERE conv_id % 11 <> 5),
occ AS (SELECT *, 'occurrence1_' || {duck_digest(["card_ref", "'task ' || (conv_id % 5)", "event_index", "to_json(struct_pack(topic := topic, basis := basis, lenses := [lens], observation := observation, quotes := [struct_pack(source := source, text := 'q')]))::VARCHAR"])} AS occurrence_ref,
  'episode1_' || {duck_digest(["lineage_ref", "turn_start", _S.format("user_ts")])} AS episode_ref,
  'mention1_' || CASE WHEN source = 'user_text' THEN {duck_digest(["lineage_ref", "turn_start", _S.format("user_ts")])} ELSE {duck_digest(["lineage_ref", "next_ordinal", _S.format("next_ts")])} END AS mention_ref FROM ev)"""


@query(
    "explode_evidence",
    f"""WITH {_OCC} SELECT card_ref, event_index, topic, occurrence_ref, episode_ref, mention_ref, 'ok' AS status FROM occ
    UNION ALL SELECT card_ref, -1, '', '', '', '', 'without_result' FROM cards WHERE conv_id % 11 = 5""",
)
def explode_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, odd = K.explode_evidence(*_events(spark, sf_dir))
    good = rows.select("card_ref", "event_index", "topic", "occurrence_ref", "episode_ref", F.array_join("mention_refs", ",").alias("mention_ref"), F.lit("ok").alias("status"))
    blank = F.lit("")
    return good.unionByName(odd.select(
        "card_ref", F.lit(-1).cast("bigint").alias("event_index"), blank.alias("topic"), blank.alias("occurrence_ref"), blank.alias("episode_ref"), blank.alias("mention_ref"), "status"))


@query(
    "normalize_phrase",
    """SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}_.:/+-]+', ' ', 'g')) AS phrase FROM documents""",
)
def normalize_phrase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize_phrase(F.col("text")).alias("phrase"))


# -- grouping -------------------------------------------------------------------------------------


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, events = _events(spark, sf_dir)
    rows, _ = K.explode_evidence(cards, events)
    return rows.join(cards.select("card_ref", "corpus", "conv_id", "session_ref", "project_key", "user_ts", "user_text"), "card_ref")


_SCOPE = """CASE WHEN topic IN ('research_writing', 'communication_style') THEN 'writing'
  WHEN topic IN ('research_literature', 'research_experimentation', 'research_analysis', 'data_analysis') THEN 'research'
  WHEN topic IN ('software_development', 'software_testing', 'software_debugging', 'version_control') THEN 'engineering' ELSE 'workflow' END"""
_SCOPED = f"""{_OCC}, scoped AS (SELECT *, CASE WHEN conv_id < 4 THEN 'tiny' || conv_id ELSE corpus END AS pool, {_SCOPE} AS scope FROM occ),
verdict AS (SELECT pool, scope, count(DISTINCT episode_ref) >= 2 AND count(DISTINCT mention_ref) >= 2 AS ok FROM scoped GROUP BY 1, 2),
evid AS (SELECT s.*, 'request1_' || {duck_digest(["s.pool", "s.scope"])} AS request_ref FROM scoped s JOIN verdict v ON v.pool = s.pool AND v.scope = s.scope WHERE v.ok),
aliased AS (SELECT *, 'a' || (row_number() OVER (PARTITION BY request_ref ORDER BY occurrence_ref) - 1) AS alias, 'e' || (dense_rank() OVER (PARTITION BY request_ref ORDER BY episode_ref) - 1) AS episode_alias,
  'l' || (dense_rank() OVER (PARTITION BY request_ref ORDER BY lineage_ref) - 1) AS lineage_alias FROM evid)"""


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = F.when(F.col("conv_id") < 4, F.concat(F.lit("tiny"), "conv_id")).otherwise(F.col("corpus"))
    return _occurrences(spark, sf_dir).withColumn("pool", pool)


@query("topic_scope", f"WITH {_SCOPED} SELECT topic, scope, count(*) AS occurrences FROM scoped GROUP BY 1, 2")
def topic_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)[1]
    return rows.groupBy("topic", L.topic_scope(F.col("topic")).alias("scope")).agg(F.count(F.lit(1)).alias("occurrences"))


@query(
    "plan_groups",
    f"""WITH {_SCOPED} SELECT s.occurrence_ref, s.pool, s.scope, CASE WHEN v.ok THEN 'request1_' || {duck_digest(["s.pool", "s.scope"])} ELSE 'insufficient_evidence' END AS route
    FROM scoped s JOIN verdict v ON v.pool = s.pool AND v.scope = s.scope""",
)
def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, rest = L.plan_groups(_pooled(spark, sf_dir), ["pool"])
    pick_columns = lambda df, c: df.select("occurrence_ref", "pool", "scope", F.col(c).alias("route"))
    return pick_columns(good, "request_ref").unionByName(pick_columns(rest, "reason"))


@query("alias_ids", f"WITH {_SCOPED} SELECT request_ref, occurrence_ref, alias, episode_alias, lineage_alias FROM aliased")
def alias_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.alias_ids(L.plan_groups(_pooled(spark, sf_dir), ["pool"])[0])
    return rows.select("request_ref", "occurrence_ref", "alias", "episode_alias", "lineage_alias")


#: Aliases of one request: seven groups of three, so no answer needs more groups than a request may have.
ASKED = 21


def _asked(aliases: DataFrame) -> DataFrame:
    """Aliases in requests of at most ASKED consecutive ones; ``part`` numbers the requests of one comparable scope (``whole_ref``)."""
    part = F.expr(f"cast(substring(alias, 2, 19) AS bigint) div {ASKED}")
    rows = aliases.withColumn("whole_ref", F.col("request_ref")).withColumn("part", part)
    return rows.withColumn("request_ref", F.concat_ws("-", "whole_ref", "part"))


def _proposed(aliases: DataFrame) -> DataFrame:
    """Proposed groups: every three consecutive aliases of a request, none left out but a last single one; one group repeated, some requests with a defect."""
    rows = aliases.withColumn("_n", F.substring("alias", 2, 19).cast("bigint")).withColumn("group_no", F.expr(f"_n % {ASKED} div 3"))
    sets = rows.groupBy("request_ref", "group_no").agg(
        F.min("part").alias("part"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "alias"))), lambda r: r["alias"]).alias("event_ids")
    ).filter(F.size("event_ids") >= 2)
    flaw = (F.conv(F.substring("request_ref", 10, 1), 16, 10).cast("int") + F.col("part")) % 8
    odd = lambda number, group: (flaw == number) & (F.col("group_no") == group)
    sets = sets.select(
        "request_ref", "group_no", F.lit("style").alias("lens"), F.concat(F.lit("idea "), "group_no").alias("hypothesis"), F.lit("general").alias("topic"),
        F.when(odd(0, 1), "guess").otherwise("shared_principle").alias("relation"),
        F.when(odd(1, 0), F.array_append("event_ids", F.lit("a"))).when(odd(3, 0), F.flatten(F.array_repeat("event_ids", 7))).otherwise(F.col("event_ids")).alias("event_ids"),
        odd(2, 1).alias("_ninth"),
    )
    again = sets.filter("group_no = 2").withColumn("group_no", F.lit(-1).cast("bigint"))
    ninth = sets.filter("_ninth").withColumn("group_no", F.lit(-2).cast("bigint"))
    return sets.unionByName(again).unionByName(ninth).drop("_ninth")


_GROUPS = f"""{_SCOPED}, nums AS (SELECT * REPLACE (request_ref || '-' || (substr(alias, 2)::BIGINT // {ASKED}) AS request_ref), substr(alias, 2)::BIGINT AS n, (('0x' || substr(request_ref, 10, 1))::INT + substr(alias, 2)::BIGINT // {ASKED}) % 8 AS flaw FROM aliased),
drawn AS (SELECT *, n % {ASKED} // 3 AS group_no FROM nums),
sets AS (SELECT request_ref, group_no, min(flaw) AS flaw, count(*) AS size, string_agg(occurrence_ref, ',' ORDER BY n) AS members FROM drawn GROUP BY 1, 2 HAVING count(*) >= 2),
bad AS (SELECT DISTINCT request_ref, 'relation' AS code FROM sets WHERE flaw = 0 AND group_no = 1 UNION SELECT DISTINCT request_ref, 'unknown_member' FROM sets WHERE flaw = 1 AND group_no = 0
  UNION SELECT request_ref, 'too_many_groups' FROM sets GROUP BY 1 HAVING count(*) + count(*) FILTER (group_no = 2) + count(*) FILTER (flaw = 2 AND group_no = 1) > 8
  UNION SELECT request_ref, unnest(['members', 'duplicate_members']) FROM sets WHERE flaw = 3 AND group_no = 0),
issue AS (SELECT request_ref, string_agg(code, ',' ORDER BY code) AS codes FROM bad GROUP BY 1),
kept AS (SELECT s.*, 'group1_' || {duck_digest(["s.request_ref", "'style'", "'idea ' || s.group_no", "'general'", "'shared_principle'", "s.members"])} AS group_ref FROM sets s WHERE request_ref NOT IN (SELECT request_ref FROM bad)),
member AS (SELECT k.group_ref, k.request_ref, d.occurrence_ref FROM kept k JOIN drawn d ON d.request_ref = k.request_ref AND d.group_no = k.group_no),
rest AS (SELECT request_ref, occurrence_ref FROM nums WHERE request_ref NOT IN (SELECT request_ref FROM bad) AND occurrence_ref NOT IN (SELECT occurrence_ref FROM member))"""


def _validated(spark: SparkSession, sf_dir: str):
    pooled = _pooled(spark, sf_dir)
    evidence, lone = L.plan_groups(pooled, ["pool"])
    asked = _asked(L.alias_ids(evidence))
    return pooled, (evidence, lone), asked, L.validate_groups(_proposed(asked), asked)


#: Members of a group in a repaired answer; the most a group may have.
REPAIRED = 12


def _repaired(aliases: DataFrame) -> DataFrame:
    """Answers to requests asked again: every twelve consecutive aliases of a request, without a defect."""
    rows = aliases.withColumn("_n", F.substring("alias", 2, 19).cast("bigint")).withColumn("group_no", F.expr(f"_n % {ASKED} div {REPAIRED}"))
    sets = rows.groupBy("request_ref", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "alias"))), lambda r: r["alias"]).alias("event_ids"))
    return sets.filter(F.size("event_ids") >= 2).select(
        "request_ref", "group_no", F.lit("style").alias("lens"), F.concat(F.lit("idea "), "group_no").alias("hypothesis"), F.lit("general").alias("topic"),
        F.lit("shared_principle").alias("relation"), "event_ids",
    )


def _settled(asked: DataFrame, issues: DataFrame, members: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member rows, leftovers) of every request: of its first answer or, where that was rejected, of the repaired one."""
    again = asked.join(issues.select("request_ref"), "request_ref", "left_semi")
    _, mended, left = L.validate_groups(_repaired(again), again)
    return members.unionByName(mended), rest.unionByName(left)


_SETTLED = f"""{_GROUPS},
mended AS (SELECT request_ref, n % {ASKED} // {REPAIRED} AS group_no, string_agg(occurrence_ref, ',' ORDER BY n) AS members FROM nums WHERE request_ref IN (SELECT request_ref FROM bad) GROUP BY 1, 2 HAVING count(*) >= 2),
final_group AS (SELECT request_ref, group_no, 'group1_' || {duck_digest(["request_ref", "'style'", "'idea ' || group_no", "'general'", "'shared_principle'", "members"])} AS group_ref FROM mended),
final_member AS (SELECT group_ref, request_ref, occurrence_ref FROM member UNION ALL SELECT g.group_ref, g.request_ref, n.occurrence_ref FROM final_group g JOIN nums n ON n.request_ref = g.request_ref AND n.n % {ASKED} // {REPAIRED} = g.group_no),
final_rest AS (SELECT request_ref, occurrence_ref FROM nums WHERE (request_ref, occurrence_ref) NOT IN (SELECT (request_ref, occurrence_ref) FROM final_member))"""


@query(
    "validate_groups",
    f"""WITH {_GROUPS} SELECT request_ref, codes AS value, 'issue' AS kind FROM issue UNION ALL SELECT request_ref, group_ref || ':' || occurrence_ref, 'member' FROM member
    UNION ALL SELECT request_ref, occurrence_ref, 'not_grouped' FROM rest""",
)
def validate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, (issues, members, rest) = _validated(spark, sf_dir)
    return (
        issues.select("request_ref", F.array_join("issues", ",").alias("value"), F.lit("issue").alias("kind"))
        .unionByName(members.select("request_ref", F.concat_ws(":", "group_ref", "occurrence_ref").alias("value"), F.lit("member").alias("kind")))
        .unionByName(rest.select("request_ref", F.col("occurrence_ref").alias("value"), F.col("reason").alias("kind")))
    )


@query(
    "audit_complete",
    f"""WITH {_SETTLED}, whole AS (SELECT split_part(request_ref, '-', 1) AS request_ref, occurrence_ref FROM nums),
    m AS (SELECT split_part(request_ref, '-', 1) AS request_ref, occurrence_ref FROM final_member WHERE substr(occurrence_ref, 13, 1) <> '7'),
    u AS (SELECT split_part(request_ref, '-', 1) AS request_ref, occurrence_ref FROM final_rest WHERE substr(occurrence_ref, 13, 1) <> '7' UNION ALL SELECT request_ref, occurrence_ref FROM m WHERE substr(occurrence_ref, 13, 1) = '3'),
    j AS (SELECT request_ref, occurrence_ref, (request_ref, occurrence_ref) IN (SELECT (request_ref, occurrence_ref) FROM m) AS g, (SELECT count(*) FROM u WHERE u.request_ref = n.request_ref AND u.occurrence_ref = n.occurrence_ref) AS l FROM whole n)
    SELECT request_ref, bool_and((g AND l = 0) OR (NOT g AND l = 1)) AS complete, 0::BIGINT AS "foreign", count(*) FILTER (NOT g AND l = 0) AS unlisted, count(*) FILTER (g AND l > 0) AS "both" FROM j GROUP BY 1""",
)
def audit_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, asked, (issues, members, rest) = _validated(spark, sf_dir)
    members, rest = _settled(asked, issues, members, rest)
    # The answers to a scope are audited as one; some rows are lost on the way, some listed twice.
    whole = lambda df: df.select(F.substring_index("request_ref", "-", 1).alias("request_ref"), "occurrence_ref")
    digit = F.substring("occurrence_ref", 13, 1)
    grouped = whole(members).filter(digit != "7")
    listed = whole(rest).filter(digit != "7").unionByName(grouped.filter(digit == "3"))
    return L.audit_complete(whole(asked), grouped, listed)


@query(
    "group_metrics",
    f"""WITH {_SETTLED} SELECT group_ref, 'general' AS topic, 'style' AS lens, 'shared_principle' AS relation, count(*) AS occurrences, count(DISTINCT mention_ref) AS messages, count(DISTINCT episode_ref) AS episodes,
    count(DISTINCT session_ref) AS sessions, count(DISTINCT lineage_ref) AS lineages, count(DISTINCT project_key) AS projects, min(user_ts) AS earliest, max(user_ts) AS latest
    FROM final_member m JOIN occ USING (occurrence_ref) GROUP BY group_ref""",
)
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled, _, asked, (issues, members, rest) = _validated(spark, sf_dir)
    return L.group_metrics(_settled(asked, issues, members, rest)[0], pooled)


def _requests(pooled: DataFrame) -> DataFrame:
    rows = pooled.withColumn("scope", L.topic_scope(F.col("topic"))).groupBy("pool", "scope").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_position(F.array(*[F.lit(s) for s in ("writing", "research", "engineering", "workflow")]), F.col("scope"))
    return rows.select("pool", "scope", order.cast("bigint").alias("request_no"), (F.col("n") * 100).alias("tokens"), ((F.col("n") % 3) == 0).alias("cached"))


_REQ = """req AS (SELECT pool, scope, list_position(['writing', 'research', 'engineering', 'workflow'], scope)::BIGINT AS request_no, count(*) * 100 AS tokens, count(*) % 3 = 0 AS cached FROM scoped GROUP BY 1, 2),
line AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY request_no) AS i FROM req),
pass AS (SELECT DISTINCT pool, 0::BIGINT AS i, 0::BIGINT AS used, '' AS scope, '' AS status, 0::BIGINT AS request_no, 0::BIGINT AS tokens FROM line
  UNION ALL SELECT p.pool, l.i, p.used + CASE WHEN s.st = 'completed' THEN l.tokens ELSE 0 END, l.scope, s.st, l.request_no, l.tokens FROM pass p JOIN line l ON l.pool = p.pool AND l.i = p.i + 1,
    LATERAL (SELECT CASE WHEN l.cached THEN 'cached' WHEN l.tokens > 4000 THEN 'pending_request_limit' WHEN p.used + l.tokens > 6000 THEN 'pending_budget' ELSE 'completed' END AS st) s),
status AS (SELECT pool, scope, request_no, tokens, status FROM pass WHERE i > 0)"""


@query("select_requests", f"WITH RECURSIVE {_SCOPED}, {_REQ} SELECT * FROM status")
def select_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.select_requests(_requests(_pooled(spark, sf_dir)), ["pool"], 4_000, 6_000)


@query(
    "routing_totals",
    f"""WITH RECURSIVE {_SETTLED}, {_REQ}, pools AS (SELECT DISTINCT request_ref, pool FROM nums),
    unrouted AS (SELECT q.pool FROM final_rest r JOIN pools q USING (request_ref) UNION ALL SELECT s.pool FROM scoped s JOIN verdict v ON v.pool = s.pool AND v.scope = s.scope WHERE NOT v.ok)
    SELECT p.pool, (SELECT count(*) FROM scoped s WHERE s.pool = p.pool) AS occurrences, (SELECT count(DISTINCT occurrence_ref) FROM final_member m JOIN pools q USING (request_ref) WHERE q.pool = p.pool) AS "grouped",
      (SELECT count(DISTINCT group_ref) FROM final_member m JOIN pools q USING (request_ref) WHERE q.pool = p.pool) AS "groups", (SELECT count(*) FROM unrouted r WHERE r.pool = p.pool) AS unrouted,
      (SELECT count(*) FROM status s WHERE s.pool = p.pool AND status = 'cached') AS cached, (SELECT count(*) FROM status s WHERE s.pool = p.pool AND status = 'completed') AS completed,
      (SELECT count(*) FROM status s WHERE s.pool = p.pool AND status LIKE 'pending%') AS pending FROM (SELECT DISTINCT pool FROM scoped) p""",
)
def routing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled, (evidence, lone), asked, (issues, members, rest) = _validated(spark, sf_dir)
    members, rest = _settled(asked, issues, members, rest)
    pools = evidence.select(F.col("request_ref").alias("whole_ref"), "pool").distinct()
    pools = asked.select("whole_ref", "request_ref").distinct().join(pools, "whole_ref").select("request_ref", "pool")
    unrouted = rest.join(pools, "request_ref").select("pool").unionByName(lone.select("pool"))
    statuses = J.select_requests(_requests(pooled), ["pool"], 4_000, 6_000)
    return L.routing_totals(pooled, members.join(pools, "request_ref"), unrouted, statuses, ["pool"])


@query(
    "usage_totals",
    """SELECT 'u' || (user_id % 10) AS profile, count(*) AS requests, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens, count(*) FILTER (event_type = 'error') AS repaired FROM events GROUP BY 1""",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 10).alias("profile"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), (F.col("event_type") == "error").alias("repaired")
    )
    return J.usage_totals(rows, ["profile"])


# -- result cache ---------------------------------------------------------------------------------


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = J.cache_key(F.lit("s1"), F.lit("p1"), F.lit("m1"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"), F.lit("s1").alias("schema_version"), F.lit("p1").alias("prompt_version"))
    stored = docs.filter("doc_id % 3 <> 0").groupBy("cache_key").agg(F.min("doc_id").alias("_d")).select(
        "cache_key", F.lit("s1").alias("schema_version"), F.when(F.col("_d") % 5 == 0, "p0").otherwise("p1").alias("prompt_version"), F.concat(F.lit("res"), "_d").alias("result")
    )
    return docs, stored


_KEY = "'cache1_' || " + duck_digest(["'s1'", "'p1'", "'m1'", "text"])


@query(
    "cache_lookup",
    f"""WITH d AS (SELECT doc_id, {_KEY} AS cache_key FROM documents), st AS (SELECT cache_key, min(doc_id) AS m FROM d WHERE doc_id % 3 <> 0 GROUP BY 1)
    SELECT doc_id, cache_key, m IS NOT NULL AND m % 5 <> 0 AS hit, CASE WHEN m % 5 <> 0 THEN 'res' || m ELSE '' END AS result FROM d LEFT JOIN st USING (cache_key)""",
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = _cache(spark, sf_dir)
    rows = J.cache_lookup(docs, stored, ["schema_version", "prompt_version"])
    return rows.select("doc_id", "cache_key", "hit", F.coalesce("result", F.lit("")).alias("result"))


@query(
    "cache_upsert",
    """WITH r AS (SELECT 'k' || (event_id % 700) AS cache_key, ts AS completed_at, 'v' || event_id AS result FROM events)
    SELECT cache_key, max(completed_at) AS completed_at, max_by(result, completed_at) AS result FROM r GROUP BY 1""",
)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), F.col("event_id") % 700).alias("cache_key"), F.col("ts").alias("completed_at"), F.concat(F.lit("v"), "event_id").alias("result"), "event_type"
    )
    fresh = F.col("event_type").isin("click", "purchase")
    return J.cache_upsert(*[rows.filter(part).drop("event_type") for part in (~fresh, fresh)])


@query(
    "cache_invalidate",
    """WITH idx AS (SELECT 'c' || event_id AS card_ref, user_id FROM events), kept AS (SELECT card_ref FROM idx WHERE NOT (user_id % 4 = 0 AND substr(card_ref, 2)::BIGINT % 3 = 0)),
    grp AS (SELECT 'g' || (event_id // 6) AS group_ref, 'c' || event_id AS card_ref FROM events)
    SELECT 'card' AS kind, card_ref AS ref FROM kept UNION ALL SELECT 'result', card_ref FROM kept WHERE substr(card_ref, 2)::BIGINT % 2 = 0
    UNION ALL SELECT 'grouping', group_ref || ':' || card_ref FROM grp WHERE group_ref NOT IN (SELECT group_ref FROM grp WHERE card_ref NOT IN (SELECT card_ref FROM kept))""",
)
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    base = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), e).alias("card_ref"), F.concat(F.lit("u"), "user_id").alias("session_ref"), "user_id", "event_id")
    index = base.select("card_ref", "session_ref")
    updated = base.filter("user_id % 4 = 0").select("session_ref").distinct()
    current = base.filter("event_id % 3 <> 0").select("card_ref")
    results = base.filter("event_id % 2 = 0").select("card_ref")
    groupings = base.select(F.concat(F.lit("g"), F.expr("event_id div 6")).alias("group_ref"), "card_ref")
    cards, kept, groups = J.cache_invalidate(index, updated, current, results, groupings)
    tag = lambda df, kind, ref: df.select(F.lit(kind).alias("kind"), ref.alias("ref"))
    return tag(cards, "card", F.col("card_ref")).unionByName(tag(kept, "result", F.col("card_ref"))).unionByName(tag(groups, "grouping", F.concat_ws(":", "group_ref", "card_ref")))


# -- review texts ---------------------------------------------------------------------------------


@query(
    "render_review",
    f"""WITH {_GROUPS}, met AS (SELECT group_ref, count(*) AS o, count(DISTINCT mention_ref) AS m, count(DISTINCT session_ref) AS s, count(DISTINCT lineage_ref) AS l, count(DISTINCT project_key) AS p FROM member JOIN occ USING (occurrence_ref) GROUP BY 1),
    num AS (SELECT *, row_number() OVER (ORDER BY group_ref) AS n FROM met)
    SELECT 'r' AS review_ref, n AS place, '## Candidate ' || n || ': draft' || chr(10) || chr(10) || '- Candidate: ' || group_ref || chr(10) || '- Topic: general; lens: style; relation: shared_principle' || chr(10)
      || '- Coverage: ' || o || ' occurrences, ' || m || ' messages, ' || s || ' sessions, ' || l || ' lineages, ' || p || ' projects' || chr(10) AS text FROM num""",
)
def render_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled, _, _, (_, members, _) = _validated(spark, sf_dir)
    rows = L.group_metrics(members, pooled).withColumn("review_ref", F.lit("r")).withColumn("draft", F.lit("draft"))
    rows = ranked(rows, ["review_ref"], ["topic", "group_ref"], "place")
    return rows.select("review_ref", "place", R.candidate_text(F.col("place")).alias("text"))


@query(
    "render_audit",
    f"""WITH {_SCOPED}, lo AS (SELECT s.*, row_number() OVER (ORDER BY user_ts, occurrence_ref) AS n FROM scoped s JOIN verdict v ON v.pool = s.pool AND v.scope = s.scope WHERE NOT v.ok)
    SELECT n AS place, '## Audit entry ' || n || chr(10) || chr(10) || '- Occurrence: ' || occurrence_ref || '; reason: insufficient_evidence' || chr(10) || '- Source: ' || session_ref || chr(10) || chr(10)
      || 'User text:' || chr(10) || '> ' || replace(user_text, chr(10), chr(10) || '> ') || chr(10) AS text FROM lo""",
)
def render_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = L.plan_groups(_pooled(spark, sf_dir), ["pool"])[1].withColumn("review_ref", F.lit("r"))
    rows = ranked(rest, ["review_ref"], ["user_ts", "occurrence_ref"], "place")
    return rows.select("place", R.audit_text(F.col("place")).alias("text"))


