"""Conversion accounting: findings, statuses, sequence checks, rendered messages, target rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.ids import derived_uuid
from convhist.functions.text import ENVELOPE_TAG
from convhist.operators.ordered import last_value, position, previous_row, scan
from convhist.operators.skew import lookup_join

KEY = ["session_ref"]
DISPOSITIONS = ("exact", "degraded", "skipped", "synthesized", "blocked")
CODE_PATTERN = r"^[a-z0-9]+(?:[._-][a-z0-9]+)*$"
# Content kinds by category.
REASONING_KINDS = ("thinking", "redacted_thinking")
RESOURCE_KINDS = ("image", "document", "file")
REFERENCE_KINDS = ("container_upload", "document_reference", "image_reference")
SILENT_KINDS = ("text", "event")


def portable_findings(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(session_ref, code, disposition, n): gap codes, notes and unexpected roles through a rule table.

    ``rules``: code, finding, disposition. A code without a rule blocks the session under
    ``unclassified``. Codes are counted before they meet the rules, so the join is tiny.
    """
    gaps = items.filter("kind = 'gap'").select(*KEY, F.col("code"))
    notes = items.select(*KEY, F.explode("notes").alias("code"))
    roles = items.filter("kind = 'message' AND role NOT IN ('user', 'assistant')").select(*KEY, F.concat(F.lit("role."), "role").alias("code"))
    counts = gaps.unionByName(notes).unionByName(roles).groupBy(*KEY, "code").agg(F.count(F.lit(1)).alias("n"))
    named = lookup_join(counts, rules, ["code"], "left", KEY)
    return named.groupBy(
        *KEY, F.coalesce("finding", F.lit("unclassified")).alias("code"), F.coalesce("disposition", F.lit("blocked")).alias("disposition")
    ).agg(F.sum("n").alias("n"))


def merge_findings(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum counts by (code, disposition); an invalid code, disposition or count raises."""
    good = F.col("code").rlike(CODE_PATTERN) & F.col("disposition").isin(*DISPOSITIONS) & (F.col("n") > 0)
    bad = F.raise_error(F.concat(F.lit("conversion finding is invalid: "), F.coalesce("code", F.lit("")))).cast("bigint")
    checked = findings.withColumn("n", F.when(F.coalesce(good, F.lit(False)), F.col("n")).otherwise(bad))
    return checked.groupBy(*(keys or []), "code", "disposition").agg(F.sum("n").alias("n"))


def conversion_status(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """blocked if any finding blocks, else degraded if any is not exact, else exact."""
    rank = F.when(F.col("disposition") == "blocked", 2).when(F.col("disposition") != "exact", 1).otherwise(0)
    worst = findings.groupBy(*KEY).agg(F.max(rank).alias("_r"))
    state = F.when(F.col("_r") == 2, "blocked").when(F.col("_r") == 1, "degraded").otherwise("exact")
    return sessions.select(*KEY).join(worst, KEY, "left").select(*KEY, state.alias("status"))


def sequence_valid(messages: DataFrame, tools_closed: DataFrame | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Per session: first failing check of the merged message sequence, or ``ok``.

    ``messages``: session_ref, ordinal, role, ts. First speaker user, last assistant, roles
    alternate, times never fall, tools closed (``tools_closed``: session_ref, closed).
    """
    rows = scan(messages, KEY, "ordinal", {"_r": previous_row(F.col("role")), "_t": last_value(F.col("ts"), strict=True)}, chunk_rows)
    facts = rows.groupBy(*KEY).agg(
        F.min_by("role", "ordinal").alias("_first"), F.max_by("role", "ordinal").alias("_last"),
        F.bool_or(F.coalesce(F.col("_r.v") == F.col("role"), F.lit(False))).alias("_repeat"),
        F.bool_or(F.col("ts").isNull() | F.coalesce(F.col("ts") < F.col("_t"), F.lit(False))).alias("_time"),
    )
    closed = F.lit(True)
    if tools_closed is not None:
        facts = facts.join(tools_closed.groupBy(*KEY).agg(F.bool_and("closed").alias("_closed")), KEY, "left")
        closed = F.coalesce("_closed", F.lit(True))
    status = (
        F.when(F.col("_first") != "user", "first_not_user").when(F.col("_last") != "assistant", "last_not_assistant")
        .when(F.col("_repeat"), "not_alternating").when(~closed, "tools_open").when(F.col("_time"), "times_not_monotone").otherwise("ok")
    )
    return facts.select(*KEY, status.alias("status"))


def envelope(name: str, payload: Column, tag: str = ENVELOPE_TAG) -> Column:
    """Text envelope around the JSON of historical evidence."""
    return F.concat(F.lit(f"<<<{tag}_{name}_V1>>>\n"), payload, F.lit(f"\n<<<END_{tag}_{name}_V1>>>"))


# Envelope name by block kind and the notice that opens its payload.
BLOCK_ENVELOPES = {
    "tool": ("HISTORICAL_TOOL_EVIDENCE", "Historical tool evidence"),
    "resource": ("HISTORICAL_RESOURCE", "Historical resource"),
    "reference": ("HISTORICAL_REFERENCE", "Historical reference"),
    "citations": ("HISTORICAL_CITATIONS", "Historical citations"),
    "context": ("HISTORICAL_CONTEXT", "Historical context"),
    "work_state": ("HISTORICAL_WORK_STATE", "Historical work state"),
    "event": ("HISTORICAL_EVENT", "Historical event"),
    "reasoning": ("HISTORICAL_REASONING_SUMMARY", "Historical reasoning summary"),
    "reasoning_trace": ("HISTORICAL_REASONING_TRACE", "Historical reasoning trace"),
}
# Block kinds that only one role may carry.
USER_ONLY, ASSISTANT_ONLY = ("context", "work_state"), ("event", "reasoning", "reasoning_trace", "tool")


def render_block(block: Column, source: Column) -> Column:
    """Text of a block: plain text as it is, evidence as an envelope around its JSON payload.

    Null members of the wide block struct vanish, which leaves exactly the members of its kind.
    """
    rendered = F.when(block["kind"] == "text", block["text"])
    for kind, (name, notice) in BLOCK_ENVELOPES.items():
        body = F.to_json(F.struct(F.lit(notice).alias("notice"), source.alias("source_agent"), block.dropFields("kind").alias("content")))
        rendered = rendered.when(block["kind"] == kind, envelope(name, body))
    return rendered


def portable_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with rendered text, (session_ref, ordinal, issue) of blocks a role may not carry).

    ``messages``: session_ref, ordinal, role, source_agent, blocks ARRAY of wide structs.
    """
    text = F.array_join(F.transform("blocks", lambda b: render_block(b, F.col("source_agent"))), "\n\n")
    issue = (
        F.when(F.size("blocks") == 0, "no_blocks")
        .when(F.exists("blocks", lambda b: F.coalesce((b["kind"] == "text") & (b["text"] == ""), F.lit(False))), "empty_text")
        .when((F.col("role") != "user") & F.exists("blocks", lambda b: b["kind"].isin(*USER_ONLY)), "user_only_block")
        .when((F.col("role") != "assistant") & F.exists("blocks", lambda b: b["kind"].isin(*ASSISTANT_ONLY)), "assistant_only_block")
    )
    rows = messages.withColumn("issue", issue)
    good = rows.filter("issue IS NULL").withColumn("rendered", text).drop("issue")
    return good, rows.filter("issue IS NOT NULL").select("session_ref", "ordinal", "issue")


def conversion_plan(statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items ordered blocked, degraded, exact, then reference; one row of counts)."""
    order = F.when(F.col("status") == "blocked", 0).when(F.col("status") == "degraded", 1).otherwise(2)
    counts = statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("blocked", "degraded", "exact")])
    return statuses.withColumn("rank", order.cast("bigint")).orderBy("rank", "session_ref"), counts


def project_rows(messages: DataFrame, conversions: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Target-shaped linear record chain: each record's parent is the record before it.

    ``messages``: session_ref, ordinal, role, rendered, ts, model. ``conversions``: session_ref,
    conversion_key, title. A titled session starts with a session-info record (ordinal -1).
    """
    head = conversions.select(*KEY, "conversion_key", "title")
    rows = lookup_join(messages, head, KEY, "inner", ["ordinal"])
    info = rows.groupBy(*KEY, "conversion_key", "title").agg(F.min_by("ts", "ordinal").alias("ts")).filter(F.trim("title") != "")
    info = info.select(
        *KEY, F.lit(-1).cast("bigint").alias("ordinal"), F.lit("session_info").alias("type"), F.lit("").alias("role"), F.col("title").alias("text"),
        F.lit("").alias("model"), "ts", derived_uuid(F.col("conversion_key"), "target.session-info").alias("record_id"),
    )
    body = rows.select(
        *KEY, "ordinal", F.lit("message").alias("type"), "role", F.col("rendered").alias("text"), F.when(F.col("role") == "assistant", F.col("model")).otherwise("").alias("model"), "ts",
        derived_uuid(F.col("conversion_key"), F.concat(F.lit("target.message."), "ordinal")).alias("record_id"),
    )
    chained = scan(info.unionByName(body), KEY, "ordinal", {"_p": last_value(F.col("record_id"), strict=True), "record_no": position()}, chunk_rows)
    return chained.withColumnRenamed("_p", "parent_id")


def kind_counts(items: DataFrame) -> DataFrame:
    """Content kinds per session, counted by category."""
    kind = F.col("kind")
    category = (
        F.when(kind.isin(*REASONING_KINDS), "reasoning").when(kind.contains("tool"), "tool")
        .when(kind.isin(*RESOURCE_KINDS) | kind.contains("resource"), "resource").when(kind.isin(*REFERENCE_KINDS), "reference").otherwise("unknown")
    )
    rows = items.select(*KEY, F.explode("content_kinds").alias("kind")).filter(~kind.isin(*SILENT_KINDS))
    return rows.groupBy(*KEY, category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
