"""Tool calls, work items, side files: pairing, closure checks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.paths import path_within
from convhist.functions.text import utf8_prefix
from convhist.operators.ordered import position, previous_row, running_sum, scan, total_min, total_sum
from convhist.operators.skew import lookup_join

TOOL_BYTES = 4 * 1024
TOOL_VALUE_BYTES = 1024
# Accepted todo statuses and priorities.
TODO_STATUSES = ("pending", "in_progress", "completed", "cancelled")
TODO_PRIORITIES = ("high", "medium", "low")


def _or(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def pair_tools(events: DataFrame, group: list[str], chunk_rows: int | None = None) -> DataFrame:
    """Close tool calls: a result joins the call right before it under the same call id.

    A later call replaces an open one, a result closes it, an orphan result and an unanswered call
    vanish, an exchange stands for itself. As-of join by a scan over (group, call id), so a call id
    used by very many rows is still split.
    """
    call = F.struct("phase", "name", "namespace", "input")
    turns = scan(events.filter("phase <> 'exchange'"), [*group, "call_id"], "ordinal", {"_p": previous_row(call)}, chunk_rows)
    closed = turns.filter((F.col("phase") == "result") & (F.col("_p.v.phase") == "call")).withColumn("_call", F.col("_p.v")).drop("_p")
    alone = events.filter("phase = 'exchange'").withColumn("_call", F.lit(None).cast(closed.schema["_call"].dataType))
    return answer_fields(closed.unionByName(alone), group)


def answer_fields(rows: DataFrame, group: list[str], extra: list[str] = []) -> DataFrame:
    """Fields of closed calls: what a result leaves empty comes from its call, the struct ``_call`` (or null)."""
    blank = F.lit("")
    return rows.select(
        *group, "ordinal", "call_id",
        _or(F.col("name"), F.coalesce(F.nullif(F.col("_call.name"), blank), F.lit("unknown"))).alias("name"),
        _or(F.col("namespace"), F.coalesce(F.col("_call.namespace"), blank)).alias("namespace"),
        _or(F.col("status"), F.when(F.col("error") == "", "completed").otherwise("error")).alias("status"),
        _or(F.col("input"), F.coalesce(F.col("_call.input"), blank)).alias("input"),
        "output", "error", *extra,
    )


def tool_summary(events: DataFrame) -> DataFrame:
    """Status and name defaults; JSON values cut to 1 KiB at a character boundary."""
    short = lambda c: utf8_prefix(F.coalesce(F.col(c), F.lit("")), TOOL_VALUE_BYTES).alias(c)
    status = _or(F.coalesce("status", F.lit("")), F.when(F.coalesce("error", F.lit("")) == "", "").otherwise("error"))
    kept = [c for c in events.columns if c not in ("status", "input", "output", "error", "name", "namespace")]
    return events.select(
        *kept, F.coalesce("name", F.lit("")).alias("name"), F.coalesce("namespace", F.lit("")).alias("namespace"),
        status.alias("status"), short("input"), short("output"), short("error"),
    )


def tool_budget(paired: DataFrame, group: list[str], limit: int = TOOL_BYTES, chunk_rows: int | None = None) -> DataFrame:
    """Keep the prefix of tools whose JSON fits the byte budget; adds ``kept`` and ``omitted_tools``."""
    json = F.to_json(F.struct("name", "namespace", "status", "input", "output", "error"))
    sized = paired.withColumn("tool_bytes", F.octet_length(json).cast("bigint"))
    rows = scan(sized, group, "ordinal", {"running_bytes": running_sum(F.col("tool_bytes"))}, chunk_rows)
    rows = rows.withColumn("kept", F.col("running_bytes") <= limit)
    return scan(rows, group, "ordinal", {"omitted_tools": total_sum((~F.col("kept")).cast("bigint"))}, chunk_rows)


def beat_tools(budgeted: DataFrame, group: list[str]) -> DataFrame:
    """One JSON list of kept tools per group; its size is bounded by the byte budget."""
    one = F.struct("ordinal", "name", "namespace", "status", "input", "output", "error")
    tools = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), one))), lambda t: t.dropFields("ordinal"))
    return budgeted.groupBy(*group).agg(F.to_json(tools).alias("tools"), F.max("omitted_tools").alias("omitted_tools"))


def tools_closed(events: DataFrame, message: list[str]) -> DataFrame:
    """Per message: each call has exactly one later result, ids are not reused, no orphans."""
    at = lambda phase: F.when(F.col("phase") == phase, F.col("ordinal"))
    per_call = events.groupBy(*message, "call_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count(at("exchange")).alias("_x"),
        F.count(at("call")).alias("_c"), F.count(at("result")).alias("_r"),
        F.min(at("call")).alias("_at_call"), F.min(at("result")).alias("_at_result"),
    )
    single = (F.col("_n") == 1) & (F.col("_x") == 1)
    pair = (F.col("_n") == 2) & (F.col("_c") == 1) & (F.col("_r") == 1) & (F.col("_at_call") < F.col("_at_result"))
    return per_call.groupBy(*message).agg(F.bool_and(F.coalesce(single | pair, F.lit(False))).alias("closed"))


def tool_batches_valid(events: DataFrame, batch: list[str]) -> DataFrame:
    """Stricter live form: call and result agree on family (or shell with function), turn and name."""
    side = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c))).alias(f"_{phase}_{c}")
    facts = [side(p, c) for p in ("call", "result") for c in ("family", "turn_id", "name")]
    per_call = events.groupBy(*batch, "call_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("phase") == "exchange").alias("_x"),
        F.count_if(F.col("phase") == "call").alias("_c"), F.count_if(F.col("phase") == "result").alias("_r"),
        F.min(F.when(F.col("phase") == "call", F.col("ordinal"))).alias("_at_call"),
        F.min(F.when(F.col("phase") == "result", F.col("ordinal"))).alias("_at_result"), *facts,
    )
    family = (F.col("_call_family") == F.col("_result_family")) | (
        (F.col("_call_family") == "local_shell") & (F.col("_result_family") == "function")
    )
    turn = F.col("_call_turn_id").isNull() | F.col("_result_turn_id").isNull() | (F.col("_call_turn_id") == F.col("_result_turn_id"))
    name = F.col("_result_name").isNull() | F.col("_result_name").eqNullSafe(F.col("_call_name"))
    single = (F.col("_n") == 1) & (F.col("_x") == 1)
    pair = (F.col("_n") == 2) & (F.col("_c") == 1) & (F.col("_r") == 1) & (F.col("_at_call") < F.col("_at_result"))
    valid = single | (pair & F.coalesce(family & turn & name, F.lit(False)))
    return per_call.groupBy(*batch).agg(F.bool_and(valid).alias("valid"), F.count(F.lit(1)).alias("calls"))


# -- work items -----------------------------------------------------------------------------------


def work_edges(work: DataFrame) -> DataFrame:
    """Both edge lists as (graph_ref, src, dst, kind); src blocks dst."""
    out = work.select("graph_ref", F.col("id").alias("src"), F.explode("blocks").alias("dst"), F.lit("blocks").alias("kind"))
    back = work.select("graph_ref", F.explode("blocked_by").alias("src"), F.col("id").alias("dst"), F.lit("blocked_by").alias("kind"))
    return out.unionByName(back)


def work_graph_valid(work: DataFrame) -> DataFrame:
    """Per graph: ids unique, both edge lists mirror each other, no self, repeated or unknown ids."""
    ids = work.groupBy("graph_ref", "id").agg(F.count(F.lit(1)).alias("_n"))
    twice = ids.filter("_n > 1").select("graph_ref")
    edge = work_edges(work).groupBy("graph_ref", "src", "dst").agg(
        F.count_if(F.col("kind") == "blocks").alias("_out"), F.count_if(F.col("kind") == "blocked_by").alias("_in")
    )
    crooked = edge.filter("src = dst OR _out <> 1 OR _in <> 1").select("graph_ref")
    # An edge stated by both ends names existing items; a one-sided edge is already crooked.
    bad = twice.unionByName(crooked).distinct().withColumn("_bad", F.lit(True))
    graphs = work.select("graph_ref").distinct()
    return graphs.join(bad, "graph_ref", "left").select("graph_ref", F.col("_bad").isNull().alias("valid"))


def active_work(work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open items with edges to open items only, counts of completed items and of metadata)."""
    active = work.filter("status <> 'completed'")
    ids = active.select("graph_ref", F.col("id").alias("dst"))
    for column in ("blocks", "blocked_by"):
        edges = active.select("graph_ref", "id", F.posexplode(column).alias("_p", "dst"))
        kept = edges.join(ids, ["graph_ref", "dst"], "left_semi")
        lists = kept.groupBy("graph_ref", "id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_p", "dst"))), lambda e: e["dst"]).alias(f"_{column}")
        )
        active = active.join(lists, ["graph_ref", "id"], "left").withColumn(
            column, F.coalesce(f"_{column}", F.array().cast(active.schema[column].dataType))
        ).drop(f"_{column}")
    counts = work.groupBy("graph_ref").agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if("has_metadata").alias("with_metadata")
    )
    return active, counts


def todo_state(todos: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per session: verified if positions run 0..n-1 and all values are known, else unverified."""
    rows = scan(todos, ["session_ref"], "row_no", {"_i": position()}, chunk_rows)
    fine = (
        (F.col("position") == F.col("_i") - 1)
        & F.col("content").isNotNull()
        & F.col("status").isin(*TODO_STATUSES)
        & F.col("priority").isin(*TODO_PRIORITIES)
    )
    return rows.groupBy("session_ref").agg(
        F.when(F.bool_and(F.coalesce(fine, F.lit(False))), "verified").otherwise("unverified").alias("state"),
        F.count(F.lit(1)).alias("items"),
    )


def task_children_closed(rows: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per child task: foreground first completed then resumed; background started, updated, and
    exactly one later notification that follows the last update. A child is one or the other.

    ``rows``: session_ref, child_id, ordinal, kind in foreground_completed, foreground_resumed,
    background_started, background_updated, notification.
    """
    kind, at = F.col("kind"), F.col("ordinal")
    background = kind.startswith("background")
    rows = scan(rows, ["session_ref", "child_id"], "ordinal", {"_start": total_min(F.when(background, at))}, chunk_rows)
    late = (kind == "notification") & (at > F.col("_start"))
    facts = rows.groupBy("session_ref", "child_id").agg(
        F.count_if(kind.startswith("foreground")).alias("_fg"), F.count_if(background).alias("_bg"),
        F.min_by(kind, F.when(kind.startswith("foreground"), at)).alias("_first_fg"),
        F.min_by(kind, F.when(background, at)).alias("_first_bg"),
        F.count_if(kind == "foreground_completed").alias("_done"), F.count_if(kind == "background_started").alias("_started"),
        F.count_if(late).alias("_notes"), F.min(F.when(late, at)).alias("_note_at"), F.max(F.when(background, at)).alias("_last_bg"),
    )
    fg = (F.col("_fg") == 0) | ((F.col("_first_fg") == "foreground_completed") & (F.col("_done") == 1))
    bg = (F.col("_bg") == 0) | (
        (F.col("_first_bg") == "background_started") & (F.col("_started") == 1) & (F.col("_notes") == 1) & (F.col("_note_at") > F.col("_last_bg"))
    )
    one = (F.col("_fg") == 0) | (F.col("_bg") == 0)
    return facts.filter("_fg + _bg > 0").select("session_ref", "child_id", F.coalesce(fg & bg & one, F.lit(False)).alias("closed"))


def task_sessions_closed(children: DataFrame) -> DataFrame:
    """Per session: closed iff all its child tasks are, with their number."""
    return children.groupBy("session_ref").agg(F.bool_and("closed").alias("closed"), F.count(F.lit(1)).alias("children"))


# -- files and events that belong to tool results -----------------------------------------------


def tool_output_owner(references: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Status of each referenced output file: owned, unavailable, ambiguous or unclassified.

    One owner means smallest and largest referencing session agree, so no distinct set is built.
    """
    paths = references.groupBy("path").agg(F.min("session_ref").alias("owner"), F.max("session_ref").alias("_other"))
    joined = paths.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    status = (
        F.when(~path_within(F.col("path"), F.lit(root)), "unclassified")
        .when(F.col("owner") != F.col("_other"), "ambiguous")
        .when(F.col("_there").isNull(), "unavailable")
        .otherwise("owned")
    )
    return joined.select("path", status.alias("status"), F.when(status.isin("owned", "unavailable"), F.col("owner")).alias("owner"))


def result_file_binding(calls: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """Violations of the one-to-one binding of persisted result references, calls and files."""

    def say(df: DataFrame, code: str, subject: str) -> DataFrame:
        return df.select(F.lit(code).alias("violation"), F.col(subject).alias("subject")).distinct()

    twice = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    unpaired = references.join(calls, ["call_id", "transcript"], "left_anti")
    parts = [
        say(twice(calls, "call_id"), "call_repeated", "call_id"),
        say(twice(references, "call_id"), "result_repeated", "call_id"),
        say(unpaired, "result_without_call", "call_id"),
        say(twice(references, "file"), "file_shared", "file"),
        say(references.join(files, "file", "left_anti"), "file_missing", "file"),
        say(files.join(references, "file", "left_anti"), "file_unreferenced", "file"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def subagent_bundle(transcripts: DataFrame, metadata: DataFrame, main_tools: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per sub-transcript: ok, or the first reason why its bundle is invalid.

    ``transcripts``: session_ref, agent_id. ``metadata``: session_ref, agent_id, tool_use_id, cwd.
    ``main_tools``: session_ref, tool_use_id. ``allowed``: session_ref, cwd.
    """
    key = ["session_ref", "agent_id"]
    uses = main_tools.groupBy("session_ref", "tool_use_id").agg(F.count(F.lit(1)).alias("_uses"))
    places = allowed.select("session_ref", "cwd").distinct().withColumn("_inside", F.lit(True))
    both = transcripts.select(*key, F.lit(True).alias("_t")).join(
        metadata.select(*key, "tool_use_id", "cwd", F.lit(True).alias("_m")), key, "full"
    )
    both = both.join(uses, ["session_ref", "tool_use_id"], "left").join(places, ["session_ref", "cwd"], "left")
    status = (
        F.when(F.col("_t").isNull(), "transcript_missing")
        .when(F.col("_m").isNull(), "metadata_missing")
        .when(F.coalesce("_uses", F.lit(0)) != 1, "tool_use_not_unique")
        .when(F.col("_inside").isNull(), "directory_not_allowed")
        .otherwise("ok")
    )
    return both.select(*key, status.alias("status"))


def event_closed(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per message: exactly one start and one end event, in order, the end matching the message row."""
    key = ["session_ref", "message_id"]
    is_start, is_end = F.col("kind") == "start", F.col("kind") == "end"
    facts = ledger.groupBy(*key).agg(
        F.count_if(is_start).alias("_starts"), F.count_if(is_end).alias("_ends"),
        F.max(F.when(is_start, F.struct("seq", "at", "reason"))).alias("_s"),
        F.max(F.when(is_end, F.struct("seq", "at", "reason", "text"))).alias("_e"),
    )
    joined = messages.join(facts, key, "left")
    closed = (
        (F.col("_starts") == 1) & (F.col("_ends") == 1) & (F.col("_s.seq") < F.col("_e.seq")) & (F.col("_s.at") <= F.col("_e.at"))
        & (F.col("_s.reason") == F.col("_e.reason")) & (F.col("_e.seq") == F.col("seq")) & (F.col("_e.at") == F.col("at"))
        & (F.col("_e.text") == F.col("text"))
    )
    return joined.select(*key, F.coalesce(closed, F.lit(False)).alias("closed"))


def status_rollup(rows: DataFrame, key: str = "session_ref", status: str = "status") -> DataFrame:
    """Worst status per session: present > unknown > empty, as the maximum of a rank."""
    rank = F.when(F.col(status) == "present", 2).when(F.col(status) == "unknown", 1).otherwise(0)
    best = rows.groupBy(key).agg(F.max(rank).alias("_r"))
    return best.select(key, F.when(F.col("_r") == 2, "present").when(F.col("_r") == 1, "unknown").otherwise("empty").alias(status))


def attach_results(
    retained: DataFrame, active: DataFrame, everything: DataFrame, folded_sessions: DataFrame
) -> DataFrame:
    """Outcome of each retained result file: materialised, private, inactive or unmaterialised.

    ``retained``: session_ref, call_id, in_main. ``active`` / ``everything``: tool results as
    session_ref, call_id, has_resources. ``folded_sessions``: sessions whose transcript was
    compacted or retracted, where a result may legitimately be inactive.
    """
    key = ["session_ref", "call_id"]
    main = retained.filter("in_main").groupBy(*key).agg(F.count(F.lit(1)).alias("_bindings"))
    private = retained.filter("NOT in_main").groupBy("session_ref").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("private"))
    live = active.groupBy(*key).agg(F.count(F.lit(1)).alias("_live"), F.bool_or("has_resources").alias("_taken"))
    known = everything.groupBy(*key).agg(F.count(F.lit(1)).alias("_known"))
    joined = lookup_join(
        main.join(live, key, "left").join(known, key, "left"),
        folded_sessions.select("session_ref").distinct().withColumn("_folded", F.lit(True)), ["session_ref"], "left", ["call_id"],
    )
    live_n = F.coalesce("_live", F.lit(0))
    outcome = (
        F.when(F.col("_bindings") != 1, "unmaterialised")
        .when((live_n == 0) & F.coalesce("_folded", F.lit(False)) & (F.coalesce("_known", F.lit(0)) == 1), "inactive")
        .when((live_n != 1) | F.coalesce("_taken", F.lit(False)), "unmaterialised")
        .otherwise("materialised")
    )
    counted = joined.groupBy("session_ref", outcome.alias("outcome")).agg(F.sum("_bindings").alias("n"))
    return counted.unionByName(private)
