"""Transcript assembly: ordered folds over the records of a session, written as scans and joins.

Nothing here gathers a session: running state is a chunked scan, "latest" is a map-side combined
``max_by``, validity is a boolean aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convhist.operators.graphs import chain_ends, path_to_root
from convhist.operators.ordered import (
    last_value,
    next_value,
    position,
    previous_row,
    remaining_min,
    runs,
    running_max,
    running_min,
    running_sum,
    scan,
    total_max,
    total_min,
)
from convhist.operators.skew import lookup_join
from convhist.session import materialize

KEY = ["session_ref"]
LONG_GAP_RUN = 4
TOP_NOTES = 12
# Gap codes that do not stop a later rollback.
TRANSPARENT_GAPS = ("response.reasoning", "response_context", "world_state", "inter_agent_communication_metadata")


def session_header(metadata: DataFrame) -> DataFrame:
    """The header record of each session: (session_ref, record_no, header_id, status).

    ``metadata``: session_ref, record_no, header_id, expected_id (nullable). One record is taken as
    it is; of several, the first must carry the expected id and be the only one that does.
    """
    first = F.min_by(F.struct("record_no", "header_id"), F.col("record_no"))
    facts = metadata.groupBy(*KEY).agg(
        first.alias("_f"), F.count(F.lit(1)).alias("_n"), F.max("expected_id").alias("_expected"),
    )
    rows = lookup_join(metadata, facts, KEY, "inner", ["record_no"])
    expected = F.coalesce("_expected", "_f.header_id")
    same = rows.groupBy(*KEY).agg(
        F.max("_f").alias("_f"), F.max("_n").alias("_n"), F.max("_expected").alias("_expected"),
        F.count_if(F.col("header_id") == expected).alias("_same"),
    )
    status = (
        F.when((F.col("_n") > 1) & (F.col("_f.header_id") != F.coalesce("_expected", "_f.header_id")), "unidentified")
        .when((F.col("_n") > 1) & (F.col("_same") != 1), "ambiguous")
        .when(F.col("_expected").isNotNull() & (F.col("_f.header_id") != F.col("_expected")), "disagrees")
        .otherwise("ok")
    )
    return same.select(*KEY, F.col("_f.record_no").alias("record_no"), F.col("_f.header_id").alias("header_id"), status.alias("status"))


def last_setting(records: DataFrame, value: str, order: str = "record_no", name: str | None = None) -> DataFrame:
    """Last non-null setting per session."""
    key = F.when(F.col(value).isNotNull(), F.col(order))
    return records.groupBy(*KEY).agg(F.max_by(value, key).alias(name or value))


def forward_fill(records: DataFrame, value: str, name: str, order: str = "record_no", chunk_rows: int | None = None) -> DataFrame:
    """Setting in force at each record: the latest one up to it."""
    return scan(records, KEY, order, {name: last_value(F.col(value))}, chunk_rows)


def session_title(records: DataFrame, fallback: str = "Untitled session") -> DataFrame:
    """Custom title beats generated title beats first user text; the last setter of each wins."""
    from convhist.functions.text import compact_title

    at = lambda kind: F.when(F.col("kind") == kind, F.col("record_no"))
    picked = records.groupBy(*KEY).agg(
        F.max_by("text", at("custom_title")).alias("_c"), F.max_by("text", at("generated_title")).alias("_g"),
        F.min_by("text", at("user")).alias("_u"),
    )
    usable = [F.nullif(compact_title(F.col(c), 160), F.lit("")) for c in ("_c", "_g", "_u")]
    return picked.select(*KEY, F.coalesce(*usable, F.lit(fallback)).alias("title"))


def session_times(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """created = header time; updated = latest of header, file time and entry times; bad texts ignored.

    ``headers``: session_ref, header_time, file_time (strings). ``entries``: session_ref, entry_time.
    """
    parse = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    latest = entries.groupBy(*KEY).agg(F.max(parse(F.col("entry_time"))).alias("_e"))
    joined = headers.join(latest, KEY, "left")
    created = parse(F.col("header_time"))
    return joined.select(*KEY, created.alias("created_at"), F.greatest(created, parse(F.col("file_time")), F.col("_e")).alias("updated_at"))


# -- record trees ---------------------------------------------------------------------------------


def active_path(records: DataFrame) -> DataFrame:
    """Records on the path from the last record to its root; other branches stay in the input."""
    leaf = records.groupBy(*KEY).agg(F.max_by("record_id", "record_no").alias("record_id"))
    path = path_to_root(leaf, records, KEY, "record_id", "parent_id")
    return records.join(path.withColumnRenamed("node", "record_id"), [*KEY, "record_id"], "left_semi")


def tree_stats(records: DataFrame) -> DataFrame:
    """Roots, branch points, records and leaf per session."""
    fan = records.filter("parent_id IS NOT NULL").groupBy(*KEY, "parent_id").agg(F.count(F.lit(1)).alias("_n"))
    branches = fan.groupBy(*KEY).agg(F.count_if(F.col("_n") > 1).alias("branch_points"))
    totals = records.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.max_by("record_id", "record_no").alias("leaf"),
    )
    return totals.join(branches, KEY, "left").withColumn("branch_points", F.coalesce("branch_points", F.lit(0).cast("bigint")))


def tree_violations(records: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """(session_ref, record_id, violation): repeated ids, parents or targets not seen earlier."""
    first = records.groupBy(*KEY, "record_id").agg(F.min("record_no").alias("_at"), F.count(F.lit(1)).alias("_n"))
    report = first.filter("_n > 1").select(*KEY, "record_id", F.lit("repeated_id").alias("violation"))
    for column, code in [("parent_id", "parent_not_earlier"), *[(t, f"{t}_not_earlier") for t in targets or ()]]:
        asked = records.filter(F.col(column).isNotNull()).select(*KEY, F.col("record_id").alias("_child"), "record_no", F.col(column).alias("record_id"))
        late = lookup_join(asked, first.select(*KEY, "record_id", "_at"), [*KEY, "record_id"], "left", ["_child"])
        late = late.filter(F.col("_at").isNull() | (F.col("_at") >= F.col("record_no")))
        report = report.unionByName(late.select(*KEY, F.col("_child").alias("record_id"), F.lit(code).alias("violation")))
    return report


# -- compaction, rollback, retraction, replacement ------------------------------------------------


def forward_compaction(items: DataFrame, compactions: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """The latest compaction replaces everything up to it: replacement messages, then the rest.

    ``compactions``: session_ref, ordinal, replacement ARRAY<STRUCT<role, text>> (null = unusable).
    Adds ``section`` 0 for replacement rows (ordinal = their place) and 1 for retained items.
    """
    usable = compactions.filter("replacement IS NOT NULL")
    last = usable.groupBy(*KEY).agg(F.max("ordinal").alias("_cut"), F.max_by("replacement", "ordinal").alias("_new"))
    kept = lookup_join(items, last.select(*KEY, "_cut"), KEY, "left", ["ordinal"])
    kept = kept.filter(F.col("_cut").isNull() | (F.col("ordinal") > F.col("_cut")))
    fresh = last.select(*KEY, F.posexplode("_new").alias("_p", "_m"))
    return fresh.select(
        *KEY, F.lit(0).alias("section"), F.col("_p").cast("bigint").alias("ordinal"), F.col("_m.role").alias("role"), F.col("_m.text").alias("text")
    ).unionByName(kept.select(*KEY, F.lit(1).alias("section"), "ordinal", "role", "text"))


def partial_compaction(items: DataFrame, checkpoints: DataFrame, preserved: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Keep a verified list of messages before (*from*) or after (*up_to*) the summary.

    ``checkpoints``: session_ref, mode, summary_ordinal (one per session). ``preserved``:
    session_ref, seq, ordinal, parent_ordinal. The list is valid if its ordinals rise, lie before
    the summary, and each parent is the entry before it; an invalid list leaves the items alone.
    Adds ``section`` and ``place`` (sort by both); preserved times are re-based in *up_to* mode.
    """
    rows = lookup_join(preserved, checkpoints, KEY, "inner", ["seq"])
    rows = scan(rows, KEY, "seq", {"_p": previous_row(F.col("ordinal"))}, chunk_rows)
    before = F.col("_p.v")
    chained = before.isNull() | ((F.col("ordinal") > before) & F.col("parent_ordinal").eqNullSafe(before))
    verdict = rows.groupBy(*KEY).agg(F.bool_and(chained & (F.col("ordinal") < F.col("summary_ordinal"))).alias("_valid"))
    marks = checkpoints.join(verdict.filter("_valid"), KEY, "left_semi")
    summaries = items.join(marks.select(*KEY, F.col("summary_ordinal").alias("ordinal")), [*KEY, "ordinal"], "inner")
    marks = marks.join(summaries.select(*KEY, F.col("ts").alias("_at")), KEY, "inner")
    joined = lookup_join(items, marks, KEY, "left", ["ordinal"])
    joined = joined.join(preserved.select(*KEY, "ordinal", "seq"), [*KEY, "ordinal"], "left")
    active = F.col("mode").isNotNull()
    upto = F.col("mode") == "up_to"
    is_summary = F.col("ordinal") == F.col("summary_ordinal")
    is_kept = F.col("seq").isNotNull() & (F.col("ordinal") < F.col("summary_ordinal"))
    section = (
        F.when(~active, 2).when(is_summary, F.when(upto, 0).otherwise(1)).when(is_kept, F.when(upto, 1).otherwise(0))
        .when(F.col("ordinal") > F.col("summary_ordinal"), 2)
    )
    rebased = active & upto & is_kept
    return joined.withColumn("section", section).filter("section IS NOT NULL").select(
        *KEY, F.col("section").cast("bigint").alias("section"),
        F.when(active & is_kept, F.col("seq")).otherwise(F.col("ordinal")).alias("place"), "ordinal",
        F.when(active & is_summary, "user").otherwise(F.col("role")).alias("role"), "text",
        F.when(rebased, F.col("_at")).otherwise(F.col("ts")).alias("ts"),
    )


def compaction_tail(items: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """The retained run right before the latest boundary moves behind the summary.

    ``items``: session_ref, ordinal (dense), kind, role, text, ts, in_tail, is_boundary. Times of
    moved rows become the summary's; a leading assistant row is merged into the summary. Adds
    ``section`` / ``place`` as sort key; sessions without such a run come back unchanged.
    """
    at = F.col("ordinal")
    rows = scan(items, KEY, "ordinal", {"_b": total_max(F.when(F.col("is_boundary"), at))}, chunk_rows)
    outside = (at < F.col("_b")) & ~((F.col("kind") == "message") & F.col("in_tail"))
    after = at == F.col("_b") + 1
    speaks = after & (F.col("kind") == "message") & (F.col("role") == "assistant")
    rows = scan(
        rows, KEY, "ordinal",
        {
            "_o": total_max(F.when(outside, at)), "_first": total_min(at),
            "_at": total_max(F.when(speaks, F.col("ts"))),
        },
        chunk_rows,
    )
    begin = F.coalesce(F.col("_o") + 1, F.col("_first"))
    active = F.col("_b").isNotNull() & F.col("_at").isNotNull() & (begin < F.col("_b"))
    rows = rows.withColumn("_begin", begin).withColumn("_active", F.coalesce(active, F.lit(False)))
    rows = scan(
        rows, KEY, "ordinal",
        {"_lead": total_max(F.when(F.col("_active") & (at == F.col("_begin")) & (F.col("role") == "assistant"), F.col("text")))},
        chunk_rows,
    )
    on = F.col("_active")
    merged_away = on & F.col("_lead").isNotNull() & (at == F.col("_begin"))
    dropped = on & (at < F.col("_begin"))
    tail = on & (at >= F.col("_begin")) & (at < F.col("_b"))
    section = F.when(~on, 4).when(at == F.col("_b"), 0).when(after, 1).when(tail, 2).otherwise(3)
    text = F.when(on & after & F.col("_lead").isNotNull(), F.concat("text", F.lit("\n\n"), F.col("_lead"))).otherwise(F.col("text"))
    return rows.filter(~merged_away & ~dropped).select(
        *KEY, section.cast("bigint").alias("section"), at.alias("place"), "role", text.alias("text"),
        F.when(tail, F.col("_at")).otherwise(F.col("ts")).alias("ts"),
    )


def apply_rollbacks(items: DataFrame, protected_turns: DataFrame | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Undo the last N user turns at each rollback event; returns the surviving items.

    ``items``: session_ref, ordinal, kind, role, code, ts, rollback_turns (null unless the row is a
    rollback), eligible (session-level: times monotone and display mirror matched).

    User turns form a stack: a turn pushes, a rollback pops up to N. With S = turns minus popped
    turns so far, the stack height is S minus its running minimum below zero, and an item survives
    iff the height never again falls below its own. So the whole fold is three scans. A rollback
    takes no effect -- and as an opaque gap blocks all later ones -- if its time is not unique, an
    opaque gap precedes it, no turn is left, or it would cut into the first ``protected`` turns.
    """
    rows = items.select(*KEY, "ordinal", "kind", "role", "code", "ts", "rollback_turns", "eligible")
    if protected_turns is None:
        rows = rows.withColumn("protected", F.lit(0))
    else:
        rows = lookup_join(rows, protected_turns, KEY, "left", ["ordinal"])
    busy = rows.groupBy(*KEY, "ts").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*KEY, "ts", F.lit(True).alias("_busy"))
    rows = rows.join(busy, [*KEY, "ts"], "left")
    is_rollback = F.col("rollback_turns").isNotNull()
    # Only flags and small numbers go through the scans; each stage is written once before two read it.
    rows = materialize(
        rows.select(
            *KEY, "ordinal", F.coalesce("protected", F.lit(0)).cast("bigint").alias("protected"),
            ((F.col("kind") == "message") & (F.col("role") == "user")).cast("bigint").alias("turn"),
            F.coalesce("rollback_turns", F.lit(0)).cast("bigint").alias("back"), is_rollback.alias("rollback"),
            (is_rollback & F.col("eligible") & F.col("_busy").isNull()).alias("wanted"),
            ((F.col("kind") == "gap") & ~F.col("code").isin(*TRANSPARENT_GAPS) & ~is_rollback).alias("opaque"),
        )
    )

    def heights(df: DataFrame, effective: Column) -> DataFrame:
        move = F.col("turn") - F.when(effective, F.col("back")).otherwise(0)
        df = materialize(scan(df, KEY, "ordinal", {"_s": running_sum(move)}, chunk_rows))
        df = scan(df, KEY, "ordinal", {"_m": running_min(F.col("_s"))}, chunk_rows)
        return materialize(df.withColumn("_h", F.col("_s") - F.least(F.col("_m"), F.lit(0))).drop("_s", "_m"))

    tried = heights(rows, F.col("wanted"))
    before = F.coalesce(F.col("_was"), F.lit(0))
    stuck = (before == 0) | (before - F.least(F.col("back"), before) < F.col("protected"))
    tried = scan(tried, KEY, "ordinal", {"_was": last_value(F.col("_h"), strict=True)}, chunk_rows)
    blocks = F.col("opaque") | (F.col("rollback") & (~F.col("wanted") | stuck))
    first = tried.filter(blocks).groupBy(*KEY).agg(F.min("ordinal").alias("_block"))
    rows = lookup_join(rows, first, KEY, "left", ["ordinal"]).withColumn(
        "effective", F.col("wanted") & (F.col("_block").isNull() | (F.col("ordinal") < F.col("_block")))
    ).drop("_block")
    rows = heights(materialize(rows), F.col("effective"))
    rows = scan(rows, KEY, "ordinal", {"_low": remaining_min(F.col("_h"))}, chunk_rows)
    survives = ~F.col("effective") & (F.coalesce("_low", F.col("_h")) >= F.col("_h"))
    return items.join(rows.filter(survives).select(*KEY, "ordinal"), [*KEY, "ordinal"], "left_semi")


def apply_retractions(items: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving items, verdict per episode).

    ``items``: session_ref, ordinal, role, kind, message_id. ``episodes``: session_ref, episode_no,
    replacement_id, superseded ARRAY. An episode is valid if the replacement and all superseded ids
    name exactly one assistant message each, earlier than the replacement. Episodes that share a
    message are decided in order: each round settles every episode that is the first claimant of
    all its messages, and rejects those that overlap a settled one. An episode with one earlier rival
    is settled iff that one isn't, so chains of those are decided at once, by pointer doubling to the
    start of the chain; only denser overlaps take rounds.
    """
    where = items.groupBy(*KEY, "message_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ordinal").alias("_at"),
        F.bool_and((F.col("kind") == "message") & (F.col("role") == "assistant")).alias("_speaks"),
    )
    claims = episodes.select(*KEY, "episode_no", "replacement_id", F.explode(F.array_distinct("superseded")).alias("message_id"))
    claims = claims.join(where, [*KEY, "message_id"], "left")
    new = where.select(*KEY, F.col("message_id").alias("replacement_id"), F.col("_n").alias("_rn"), F.col("_at").alias("_rat"), F.col("_speaks").alias("_rs"))
    claims = claims.join(new, [*KEY, "replacement_id"], "left")
    fine = F.coalesce((F.col("_n") == 1) & F.col("_speaks") & (F.col("_rn") == 1) & F.col("_rs") & (F.col("_at") < F.col("_rat")), F.lit(False))
    ids = [*KEY, "episode_no"]
    sound = claims.groupBy(*ids).agg(F.bool_and(fine).alias("_ok")).filter("_ok").select(*ids)
    open_claims = materialize(claims.join(sound, ids, "left_semi").select(*ids, "message_id"))
    settled = None
    while not open_claims.isEmpty():
        claimants = open_claims.groupBy(*KEY, "message_id").agg(F.min("episode_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
        late = F.col("episode_no") != F.col("_first")
        rivals = open_claims.join(claimants, [*KEY, "message_id"]).groupBy(*ids).agg(
            F.min(F.when(late, F.col("_first"))).alias("_rival"), F.max(F.when(late, F.col("_first"))).alias("_other"), F.max(F.when(late, F.col("_n"))).alias("_most")
        )
        rivals = materialize(rivals)
        won = rivals.filter("_rival IS NULL").select(*ids)
        steps = rivals.filter("_rival = _other AND _most = 2").select(
            F.struct(*ids).alias("node"), F.struct(*KEY, F.col("_rival").alias("episode_no")).alias("up"), F.lit(1).cast("bigint").alias("w")
        )
        even = chain_ends(steps)[0].filter("w % 2 = 0").join(won.select(F.struct(*ids).alias("up")), "up", "left_semi").select("node.*")
        won = won.unionByName(even)
        taken = materialize(open_claims.join(won, ids, "left_semi"))
        settled = taken if settled is None else settled.unionByName(taken)
        clash = open_claims.join(taken.select(*KEY, "message_id"), [*KEY, "message_id"], "left_semi").select(*ids).distinct()
        open_claims = materialize(open_claims.join(clash, ids, "left_anti"))
    if settled is None:
        settled = open_claims
    applied = settled.select(*ids).distinct().withColumn("_a", F.lit(True))
    verdicts = episodes.select(*ids).join(applied, ids, "left").select(*ids, F.coalesce("_a", F.lit(False)).alias("applied"))
    gone = settled.select(*KEY, "message_id").distinct()
    return items.join(gone, [*KEY, "message_id"], "left_anti"), verdicts


def apply_replacements(results: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results with replaced output, outcome per replaced call id).

    ``results``: session_ref, call_id, record_no, active, replaceable, output. ``replacements``:
    session_ref, call_id, record_no, replacement; the latest one per call id counts.
    """
    key = [*KEY, "call_id"]
    latest = replacements.groupBy(*key).agg(F.max_by("replacement", "record_no").alias("_new"))
    facts = results.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("active").alias("_active"), F.bool_and("replaceable").alias("_can"),
        F.bool_and(F.col("replaceable") | ~F.col("active")).alias("_can_active"),
    )
    folded = results.groupBy(*KEY).agg(F.bool_or(~F.col("active")).alias("_folded"))
    judged = lookup_join(latest.join(facts, key, "left"), folded, KEY, "left", ["call_id"])
    outcome = (
        F.when((F.coalesce("_all", F.lit(0)) != 1) | ~F.coalesce("_can", F.lit(False)), "unsupported")
        .when((F.col("_active") == 0) & F.col("_folded"), "inactive")
        .when(F.col("_active") != 1, "unsupported")
        .otherwise("applied")
    )
    judged = judged.withColumn("outcome", outcome)
    new = judged.filter("outcome = 'applied'").select(*key, "_new")
    changed = results.join(new, key, "left").withColumn("output", F.coalesce(F.when(F.col("active"), F.col("_new")), F.col("output"))).drop("_new")
    return changed, judged.select(*key, "outcome")


def reconcile_mirror(model: DataFrame, display: DataFrame, chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Match display messages to model messages as an ordered subsequence, greedily.

    ``model`` / ``display``: session_ref, ordinal (dense from 0), content_key (hash of role, text
    and media). Returns (display rows with ``match`` = model ordinal, verdict per session).

    The greedy match is the least solution of "match(i) is the first equal model message behind
    all earlier matches". It is reached by raising lower bounds: start from the k-th occurrence for
    the k-th equal display message, then repeat two scans (running maximum, next occurrence) until
    nothing moves. Ordinary mirrors settle in the first round; no session is ever gathered. A session where nothing moved is
    final, so a round works on the other sessions alone.
    """
    content = [*KEY, "content_key"]
    model = materialize(model.select(*content, "ordinal"))
    shown = scan(display, content, "ordinal", {"_k": position()}, chunk_rows)
    known = scan(model, content, "ordinal", {"_k": position()}, chunk_rows).select(*content, "_k", F.col("ordinal").alias("match"))
    state, settled = materialize(shown.join(known, [*content, "_k"], "left").drop("_k")), None
    spots = model.select(*content, (F.col("ordinal") * 2).alias("_o"), F.col("ordinal").alias("_pos"), F.lit(None).cast("bigint").alias("_i"))
    while True:
        bound = scan(state, KEY, "ordinal", {"_x": running_max(F.col("match"), strict=True)}, chunk_rows)
        bound = bound.withColumn("_x", F.coalesce("_x", F.lit(-1)))
        late = materialize(bound.filter(F.col("match").isNotNull() & (F.col("match") <= F.col("_x"))).select(*content, "ordinal", "_x"))
        if late.isEmpty():
            break
        moving = materialize(late.select(*KEY).distinct())
        final = materialize(state.join(moving, KEY, "left_anti"))
        settled = final if settled is None else settled.unionByName(final)
        asked = late.select(*content, (F.col("_x") * 2 + 1).alias("_o"), F.lit(None).cast("bigint").alias("_pos"), F.col("ordinal").alias("_i"))
        # Questions of one bound tie, but only occurrences carry a value, so their order is irrelevant.
        found = scan(spots.join(moving, KEY, "left_semi").unionByName(asked), content, "_o", {"_next": next_value(F.col("_pos"))}, chunk_rows)
        found = found.filter("_i IS NOT NULL").select(*KEY, F.col("_i").alias("ordinal"), "_next", F.lit(True).alias("_hit"))
        moved = state.join(moving, KEY, "left_semi").join(found, [*KEY, "ordinal"], "left")
        state = materialize(moved.withColumn("match", F.when(F.col("_hit"), F.col("_next")).otherwise(F.col("match"))).drop("_next", "_hit"))
    if settled is not None:
        state = materialize(state.unionByName(settled))
    verdict = state.groupBy(*KEY).agg(F.bool_and(F.col("match").isNotNull()).alias("matched"))
    return state, verdict


def mirrored_conversation(model: DataFrame, display: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Matched sessions keep their matched model rows and turn extras into gaps; others fall back
    to the display list. Adds ``source`` (model, gap, display)."""
    state, verdict = reconcile_mirror(model, display, chunk_rows)
    has = verdict.withColumnRenamed("matched", "_matched")
    rows = lookup_join(model, has, KEY, "left", ["ordinal"])
    hits = state.filter("match IS NOT NULL").select(*KEY, F.col("match").alias("ordinal"), F.lit(True).alias("_hit"))
    rows = rows.join(hits, [*KEY, "ordinal"], "left")
    own = rows.filter("_matched IS NULL OR _matched").withColumn(
        "source", F.when(F.col("_matched").isNull() | F.col("_hit"), "model").otherwise("gap")
    )
    shown = lookup_join(display, has, KEY, "inner", ["ordinal"]).filter("NOT _matched").withColumn("source", F.lit("display"))
    columns = [*KEY, "ordinal", "content_key", "source"]
    return own.select(*columns).unionByName(shown.select(*columns))


def merge_carriers(legacy: DataFrame, current: DataFrame, mixed_code: str = "message_carriers.mixed") -> DataFrame:
    """Union of two message stores: current only where legacy covers nothing, else legacy plus the
    uncovered messages and one gap. ``place`` orders by valid time, then store, then position.

    Both: session_ref, message_id, ordinal, ts, text.
    """
    covered = legacy.select(*KEY).distinct().withColumn("_legacy", F.lit(True))
    new = lookup_join(current, covered, KEY, "left", ["ordinal"])
    fresh = new.filter("_legacy IS NULL").drop("_legacy")
    extra = new.filter("_legacy").drop("_legacy").join(legacy.select(*KEY, "message_id").distinct(), [*KEY, "message_id"], "left_anti")
    gap = extra.groupBy(*KEY).agg(F.min_by("ts", "ordinal").alias("ts")).select(
        *KEY, F.lit("").alias("message_id"), F.lit(-1).cast("bigint").alias("ordinal"), "ts", F.lit(mixed_code).alias("text")
    )
    columns = [*KEY, "message_id", "ordinal", "ts", "text"]
    tag = lambda df, n: df.select(*columns, F.lit(n).alias("_store"))
    rows = tag(legacy, 0).unionByName(tag(fresh, 1)).unionByName(tag(extra, 1)).unionByName(tag(gap, 2))
    return rows.withColumn("place", F.struct(F.col("ts").isNull().alias("unknown"), "ts", "_store", "ordinal")).drop("_store")


# -- inheritance ----------------------------------------------------------------------------------


def inherit_history(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """Full history of each session: ancestor prefixes up to their cut-offs, then its own records.

    ``sessions``: session_ref, base_ref, cutoff (both null without a base), compacted. A compacted session inherits
    nothing further up. A cycle raises; see :func:`inheritance_issues` for bases that don't exist.

    Bases at distance 1, 2, 4, ... with the least cut-off on the way come from pointer doubling, and each round doubles the
    distance up to which the pairs (session, ancestor) are known, so the rounds are the logarithm of the longest chain.
    Pairs whose cut-off lies below every record are left out, and with them all that is further up.
    """
    based = sessions.filter("base_ref IS NOT NULL AND NOT compacted")
    jump = materialize(based.select(F.col("session_ref").alias("owner"), F.col("base_ref").alias("up"), F.col("cutoff").alias("_cut")))
    jumps, left = [], max(jump.count(), 1).bit_length() + 1
    while not jump.isEmpty():
        if len(jumps) > left:
            raise ValueError("history base relation contains a cycle")
        jumps.append(jump)
        hop = jump.select(F.col("owner").alias("up"), F.col("up").alias("_far"), F.col("_cut").alias("_more"))
        jump = materialize(lookup_join(jump, hop, ["up"], "inner").select("owner", F.col("_far").alias("up"), F.least("_cut", "_more").alias("_cut")))
    lowest = records.agg(F.min("record_no")).head()[0]
    seen = F.col("cutoff").isNull() | (F.col("cutoff") > F.lit(lowest))
    pairs = materialize(
        sessions.select("session_ref", F.col("session_ref").alias("owner"), F.lit(None).cast("bigint").alias("cutoff"), F.lit(0).cast("bigint").alias("distance"))
    )
    for k, jump in enumerate(jumps):
        up = pairs.join(jump, "owner").select(
            "session_ref", F.col("up").alias("owner"), F.least("cutoff", "_cut").alias("cutoff"), (F.col("distance") + (1 << k)).alias("distance")
        )
        pairs = pairs.unionByName(materialize(up.filter(seen)))
    joined = records.withColumnRenamed("session_ref", "owner").join(pairs, "owner")
    return joined.filter(F.col("cutoff").isNull() | (F.col("record_no") < F.col("cutoff")))


def inheritance_issues(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """(session_ref, issue): base_missing, or cutoff_outside where the base has no record just before the cut-off."""
    based = sessions.filter("base_ref IS NOT NULL").select("session_ref", "base_ref", "cutoff")
    known = sessions.select(F.col("session_ref").alias("base_ref")).distinct()
    missing = based.join(known, "base_ref", "left_anti").select("session_ref", F.lit("base_missing").alias("issue"))
    ends = records.groupBy(F.col("session_ref").alias("base_ref")).agg(F.max("record_no").alias("_last"))
    held = based.join(known, "base_ref", "left_semi").filter("cutoff IS NOT NULL").join(ends, "base_ref", "left")
    outside = held.filter((F.col("cutoff") < 0) | (F.col("cutoff") > F.coalesce(F.col("_last") + 1, F.lit(0))))
    return missing.unionByName(outside.select("session_ref", F.lit("cutoff_outside").alias("issue")))


def split_inherited(items: DataFrame, starts: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Rows below the start ordinal form the inherited projection, where runs of user messages merge.

    Adds ``projection`` and ``run``; merge with :func:`coalesce_runs` over (projection, run).
    """
    rows = lookup_join(items, starts, KEY, "left", ["ordinal"])
    own = F.col("start_ordinal").isNull() | (F.col("ordinal") >= F.col("start_ordinal"))
    rows = rows.withColumn("projection", F.when(own, "own").otherwise("inherited")).drop("start_ordinal")
    mergeable = (F.col("projection") == "inherited") & (F.col("role") == "user")
    rows = rows.withColumn("_same", F.when(mergeable, F.lit(-1).cast("bigint")).otherwise(F.col("ordinal")))
    return runs(rows, KEY, "ordinal", ["projection", "_same"], "run", chunk_rows).drop("_same")


def coalesce_runs(rows: DataFrame, order: str = "ordinal", separator: str = "\n\n", extra: list[str] | None = None, chunk_rows: int = 4_096) -> DataFrame:
    """Merge each run into one message: texts in order, last time, last non-empty model, merge count.

    Concatenation runs in two steps (per chunk of a run, then per run), so one long run is joined
    from partial texts; what meets in one task is the merged message itself, i.e. the result.
    """
    keys = [*KEY, *(extra or []), "run"]
    chunk = F.expr(f"`{order}` div {chunk_rows}L").alias("_chunk")
    text = lambda o, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda r: r[c]), separator)
    model_at = F.when(F.col("model") != "", F.col(order))
    parts = rows.groupBy(*keys, chunk).agg(
        text(order, "text").alias("text"), F.min(order).alias("first"), F.max(order).alias("last"), F.max_by("ts", order).alias("ts"),
        F.max_by("model", model_at).alias("_model"), F.max(model_at).alias("_model_at"), F.first("role").alias("role"), F.count(F.lit(1)).alias("_n"),
    )
    return parts.groupBy(*keys).agg(
        text("_chunk", "text").alias("text"), F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("ts", "last").alias("ts"),
        F.coalesce(F.max_by("_model", "_model_at"), F.lit("")).alias("model"), F.first("role").alias("role"), (F.sum("_n") - 1).alias("merged"),
    )


def same_role_runs(messages: DataFrame, order: str = "ordinal", chunk_rows: int | None = None) -> DataFrame:
    return runs(messages, KEY, order, ["role"], "run", chunk_rows)


def pending_evidence(rows: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Tool and reasoning records attach to the next assistant message unless a user message or the
    end comes first; then they are gaps. Adds ``attached_to`` (null = gap)."""
    at = F.col("ordinal")
    speaks = lambda role: F.when((F.col("kind") == "message") & (F.col("role") == role), at)
    marked = scan(rows, KEY, "ordinal", {"_a": next_value(speaks("assistant")), "_u": next_value(speaks("user"))}, chunk_rows)
    joins = F.col("_a").isNotNull() & (F.col("_u").isNull() | (F.col("_a") < F.col("_u")))
    return marked.filter("kind = 'evidence'").withColumn("attached_to", F.when(joins, F.col("_a"))).drop("_a", "_u")


# -- checks and counts ----------------------------------------------------------------------------


def ordinals_valid(records: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per session: declared ordinals are present everywhere or nowhere, rise strictly, start right.

    ``records``: session_ref, record_no, declared (nullable), expected_start.
    """
    rows = scan(records, KEY, "record_no", {"_p": previous_row(F.col("declared"))}, chunk_rows)
    rising = F.col("_p").isNull() | F.coalesce(F.col("declared") > F.col("_p.v"), F.lit(True))
    return rows.groupBy(*KEY).agg(
        F.when(F.count("declared") == 0, "absent")
        .when(F.count("declared") != F.count(F.lit(1)), "mixed")
        .when(~F.bool_and(rising), "not_increasing")
        .when(F.min_by("declared", "record_no") != F.max("expected_start"), "wrong_start")
        .otherwise("ok")
        .alias("status")
    )


def monotonic_times(items: DataFrame, order: str = "ordinal", chunk_rows: int | None = None) -> DataFrame:
    """Per session: number of rows whose time is unknown or earlier than the latest one before."""
    rows = scan(items, KEY, order, {"_max": running_max(F.col("ts"), strict=True), "_last": last_value(F.col("ts"), strict=True)}, chunk_rows)
    bad = F.col("ts").isNull() | F.coalesce(F.col("ts") < F.col("_last"), F.lit(False))
    return rows.groupBy(*KEY).agg(F.count_if(bad).alias("invalid_times"), F.count_if(F.col("ts") < F.col("_max")).alias("below_maximum"))


def record_dispositions(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Classify records by a rule table and count per (session, code, disposition).

    ``records``: session_ref, type, fields ARRAY<STRING>. ``rules``: type, required ARRAY<STRING>,
    code, disposition, priority. Records without a fitting rule are unknown. The rule table is a
    few dozen fixed rows; the best rule per record is chosen by priority without a shuffle.
    """
    packed = rules.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("priority", "required", "code", "disposition"))).alias("_rules"))
    typed = lookup_join(records.groupBy(*KEY, "type", "fields").agg(F.count(F.lit(1)).alias("_n")), packed, ["type"], "left", KEY)
    fits = F.filter(F.coalesce("_rules", F.array()), lambda r: F.size(F.array_except(r["required"], F.col("fields"))) == 0)
    best = F.try_element_at(fits, F.lit(1))
    named = typed.select(
        *KEY, F.coalesce(best["code"], F.lit("record.unknown")).alias("code"), F.coalesce(best["disposition"], F.lit("unknown")).alias("disposition"), "_n"
    )
    return named.groupBy(*KEY, "code", "disposition").agg(F.sum("_n").alias("n"))


def latest_links(links: DataFrame, keys: list[str], value: str, order: str = "record_no") -> DataFrame:
    """Last link per key (a session, or a session and address)."""
    return links.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def gap_runs(items: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Runs of consecutive gaps with counts per code; runs of four or more are collapsed for display."""
    rows = runs(items.select(*KEY, "ordinal", "kind", "code", "label"), KEY, "ordinal", ["kind"], "run", chunk_rows).filter("kind = 'gap'")
    name = F.when(F.col("code") == "", F.col("label")).otherwise(F.col("code"))
    per_code = rows.groupBy(*KEY, "run", name.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("_first"))
    return per_code.groupBy(*KEY, "run").agg(
        F.min("_first").alias("first"), F.sum("n").alias("gaps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "code", "n"))), lambda r: F.concat(r["code"], F.lit("="), r["n"])), ",").alias("counts"),
    ).withColumn("collapsed", F.col("gaps") >= LONG_GAP_RUN)


def note_counts(items: DataFrame, top: int = TOP_NOTES) -> tuple[DataFrame, DataFrame]:
    """(top annotation codes per session with their rank, count of the remaining codes).

    Ranks run over the distinct codes of a session, which are few, never over its items.
    """
    counts = items.select(*KEY, F.explode("notes").alias("code")).groupBy(*KEY, "code").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("n").desc(), "code"))
    ranked = counts.withColumn("rank", rank.cast("bigint"))
    rest = ranked.groupBy(*KEY).agg(F.count_if(F.col("rank") > top).alias("other_codes"), F.sum(F.when(F.col("rank") > top, F.col("n")).otherwise(0)).alias("other_notes"))
    return ranked.filter(F.col("rank") <= top), rest


def ambient_first_seen(announcements: DataFrame) -> DataFrame:
    """First announcement of each (session, key); later repeats are counted, not listed."""
    return announcements.groupBy(*KEY, "key").agg(F.min("record_no").alias("first_record"), (F.count(F.lit(1)) - 1).alias("repeats"))
