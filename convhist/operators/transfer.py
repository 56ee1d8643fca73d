"""Transfer planning: selection, paging, path mapping, classification, merge checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convhist.functions.ids import UUID_PATTERN, encode_cursor, kind_order
from convhist.functions.paths import normalize_posix
from convhist.operators.catalog import ancestor_paths, display_title
from convhist.operators.graphs import forest_depth, select_exportable
from convhist.operators.skew import lookup_join
from convhist.session import materialize

MAX_INSPECT, DEFAULT_INSPECT = 200, 50
QUALITY = ("native", "exact", "degraded", "blocked")


def plan_export(requested: DataFrame, sessions: DataFrame, edges: DataFrame, blocked: DataFrame, owned: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries in closure, sessions per source kind, skipped with reason)."""
    chosen, skipped = select_exportable(requested, sessions, edges, blocked, owned, strict)
    entries = sessions.join(chosen, "session_ref", "left_semi")
    counts = entries.groupBy("agent", kind_order(F.col("agent")).alias("kind_order")).agg(F.count(F.lit(1)).alias("sessions"))
    return entries, counts, skipped


def inspect_bundle(entries: DataFrame, limit: int = DEFAULT_INSPECT, after: str | None = None) -> DataFrame:
    """Keyset page by reference; ``next_cursor`` is set on the last row if more rows follow.

    Distributed top-(limit + 1). A cursor outside the selection raises.
    """
    if not 1 <= limit <= MAX_INSPECT:
        raise ValueError("inspect limit must be between 1 and 200")
    rows = entries
    if after is not None:
        if entries.filter(F.col("session_ref") == after).isEmpty():
            raise ValueError("inspect cursor is outside the selection")
        rows = entries.filter(F.col("session_ref") > after)
    page = rows.orderBy("session_ref").limit(limit + 1)
    # At most limit + 1 (201) rows reach this window.
    order = Window.orderBy("session_ref")
    page = page.withColumn("_n", F.row_number().over(order)).withColumn("_more", F.lead("session_ref").over(order).isNotNull())
    cursor = F.when((F.col("_n") == limit) & F.col("_more"), encode_cursor(F.col("session_ref")))
    return page.filter(F.col("_n") <= limit).withColumn("next_cursor", cursor).drop("_n", "_more")


def workspace_rollup(entries: DataFrame) -> DataFrame:
    """Sessions and source kinds (product order) per workspace. Four kinds at most, so the set is bounded."""
    kinds = F.array_sort(F.collect_set(F.struct(kind_order(F.col("agent")).alias("o"), "agent")))
    return entries.groupBy("context").agg(F.count(F.lit(1)).alias("sessions"), F.array_join(F.transform(kinds, lambda k: k["agent"]), ",").alias("agents"))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def bundle_violations(entries: DataFrame, objects: DataFrame, bindings: DataFrame) -> DataFrame:
    """(violation, subject): repeated sessions, unreferenced or doubly used objects, dangling bindings.

    ``entries``: session_ref. ``objects``: object_id. ``bindings``: session_ref, object_id, usage
    (native or resource).
    """
    say = lambda df, code, subject: df.select(F.lit(code).alias("violation"), F.col(subject).alias("subject")).distinct()
    twice = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    mixed = bindings.groupBy("object_id").agg((F.min("usage") != F.max("usage")).alias("_m")).filter("_m")
    return _union([
        say(twice(entries, "session_ref"), "session_repeated", "session_ref"), say(twice(objects, "object_id"), "object_repeated", "object_id"),
        say(objects.join(bindings, "object_id", "left_anti"), "object_unreferenced", "object_id"), say(mixed, "object_mixed", "object_id"),
        say(bindings.join(objects, "object_id", "left_anti"), "object_missing", "object_id"),
        say(bindings.join(entries, "session_ref", "left_anti"), "session_missing", "session_ref"),
    ])


# -- path mapping ---------------------------------------------------------------------------------


def check_mappings(rules: DataFrame) -> DataFrame:
    """(source, issue) for relative, ineffective and ambiguous rules."""
    keyed = rules.select("source", "target", _clean(F.col("source")).alias("_s"), _clean(F.col("target")).alias("_t"))
    several = keyed.groupBy("_s").agg((F.min("_t") != F.max("_t")).alias("_many"))
    joined = keyed.join(several, "_s")
    issue = (
        F.when(~F.col("source").startswith("/") | ~F.col("target").startswith("/"), "not_absolute")
        .when(F.col("_s") == F.col("_t"), "no_effect")
        .when(F.col("_many"), "ambiguous")
    )
    return joined.select("source", issue.alias("issue")).filter("issue IS NOT NULL").distinct()


def _clean(path: Column) -> Column:
    return F.regexp_replace(normalize_posix(path), "(?<=.)/$", "")


def map_paths(paths: DataFrame, rules: DataFrame, column: str = "path") -> tuple[DataFrame, DataFrame]:
    """Longest-source-prefix mapping on whole segments: (paths with ``mapped`` and ``rule_source``,
    rules that no path used).

    A path lists its ancestors (as many as it is deep), so matching is an equi-join on distinct
    paths; the deepest hit wins by a map-side combined ``max_by``.
    """
    each = rules.select(_clean(F.col("source")).alias("_dir"), F.col("source").alias("rule_source"), _clean(F.col("target")).alias("_target"))
    book = each.groupBy("_dir").agg(F.min("rule_source").alias("rule_source"), F.min("_target").alias("_low"), F.max("_target").alias("_high"))
    doubt = F.raise_error(F.concat(F.lit("ambiguous targets for "), "_dir")).cast("string")
    book = book.select("_dir", "rule_source", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(doubt).alias("_target"))
    distinct = paths.select(F.col(column).alias("_raw")).distinct().withColumn("_clean", _clean(F.col("_raw")))
    chains = distinct.withColumn("_dir", F.explode(F.array_distinct(ancestor_paths(F.col("_clean")))))
    hits = lookup_join(chains, book, ["_dir"], "inner", ["_raw"])
    best = hits.groupBy("_raw").agg(F.max_by(F.struct("_dir", "_target", "rule_source"), F.length("_dir")).alias("_b"))
    known = distinct.join(best, "_raw", "left")
    rest = F.substring(F.col("_clean"), F.length("_b._dir") + 1, F.length("_clean"))
    rest = F.when(F.col("_b._dir") == "/", F.col("_clean")).otherwise(rest)
    target = F.when(F.col("_b._target") == "/", F.when(rest == "", "/").otherwise(rest)).otherwise(F.concat("_b._target", rest))
    mapped = known.select("_raw", F.when(F.col("_b").isNull(), F.col("_clean")).otherwise(target).alias("mapped"), F.col("_b.rule_source").alias("rule_source"))
    result = lookup_join(paths.withColumnRenamed(column, "_raw"), mapped, ["_raw"], "inner").withColumnRenamed("_raw", column)
    used = mapped.select(_clean(F.col("rule_source")).alias("_dir")).distinct()
    unused = each.select("_dir", F.col("rule_source").alias("source")).distinct().join(used, "_dir", "left_anti").select("source")
    return result, unused


def workspace_plan(entries: DataFrame, rules: DataFrame, directories: DataFrame) -> DataFrame:
    """Sessions per (source, target, status, availability) with kinds in product order.

    ``directories``: path, state (available or not_directory); unlisted directories are missing.
    The sessions themselves stay rows: join back on (source, target).
    """
    mapped, _ = map_paths(entries.withColumn("source", _clean(F.col("context"))), rules, "source")
    seen = directories.select(F.col("path").alias("mapped"), "state")
    rows = lookup_join(mapped, seen, ["mapped"], "left", ["session_ref"])
    status = F.when(F.col("mapped") == F.col("source"), "unchanged").otherwise("mapped")
    kinds = F.array_sort(F.collect_set(F.struct(kind_order(F.col("agent")).alias("o"), "agent")))
    return rows.groupBy("source", F.col("mapped").alias("target"), status.alias("status"), F.coalesce("state", F.lit("missing")).alias("availability")).agg(
        F.count_distinct("session_ref").alias("sessions"), F.array_join(F.transform(kinds, lambda k: k["agent"]), ",").alias("agents")
    )


# -- classification against a target ---------------------------------------------------------------


def classify_import(source: dict[str, DataFrame], target: dict[str, DataFrame], head: str) -> DataFrame:
    """Per session: new, already_present or conflict with the first matching reason.

    Every table has session_ref, row_key, row_hash; ``head`` names the session table itself. New
    means the target has none of the session's rows anywhere; already present means the same rows
    everywhere and no later ones; everything else is a conflict.
    """
    facts = None
    for name, rows in source.items():
        joined = rows.select("session_ref", "row_key", F.col("row_hash").alias("_s")).join(
            target[name].select("session_ref", "row_key", F.col("row_hash").alias("_t")), ["session_ref", "row_key"], "full"
        )
        is_head = F.lit(name == head)
        both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
        part = joined.groupBy("session_ref").agg(
            F.count("_s").alias("source_rows"), F.count("_t").alias("target_rows"), F.count_if(both & (F.col("_s") == F.col("_t"))).alias("equal_rows"),
            F.count_if(is_head & F.col("_s").isNotNull()).alias("head_source"), F.count_if(is_head & F.col("_t").isNotNull()).alias("head_target"),
            F.count_if(is_head & both & (F.col("_s") != F.col("_t"))).alias("head_differs"),
        )
        facts = part if facts is None else facts.unionByName(part)
    total = facts.groupBy("session_ref").agg(*[F.sum(c).alias(c) for c in facts.columns if c != "session_ref"]).filter("head_source > 0")
    reason = (
        F.when(F.col("head_differs") > 0, "session_row_differs")
        .when(F.col("target_rows") == 0, F.lit(None))
        .when(F.col("head_target") == 0, "occupied_without_session")
        .when((F.col("equal_rows") != F.col("source_rows")) | (F.col("target_rows") != F.col("source_rows")), "partial_or_later_rows")
    )
    state = F.when(reason.isNotNull(), "conflict").when(F.col("target_rows") == 0, "new").otherwise("already_present")
    return total.select("session_ref", state.alias("classification"), reason.alias("reason"))


def route(entries: DataFrame, per_session: DataFrame, default_target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Destination per session: its own target, else the global one, else its own kind.

    Also returns requested sessions that are not part of the selection.
    """
    own = per_session.select("session_ref", "target_agent")
    chosen = entries.join(own, "session_ref", "left")
    target = F.coalesce("target_agent", F.lit(default_target), "agent")
    return chosen.withColumn("target_agent", target), own.join(entries, "session_ref", "left_anti").select("session_ref")


def route_summary(routed: DataFrame, conversions: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions and worst quality per route, merged findings per route). A rank maximum gives the worst."""
    rows = routed.select("session_ref", F.col("agent").alias("source_agent"), "target_agent").join(
        conversions.select("session_ref", "status"), "session_ref", "left"
    )
    rank = F.when(F.col("source_agent") == F.col("target_agent"), 0)
    for index, name in enumerate(QUALITY[1:], start=1):
        rank = rank.when(F.col("status") == name, index)
    names = F.array(*[F.lit(q) for q in QUALITY])
    summary = rows.groupBy("source_agent", "target_agent").agg(F.count(F.lit(1)).alias("sessions"), F.max(rank).alias("_r"))
    summary = summary.select("source_agent", "target_agent", "sessions", F.element_at(names, F.col("_r") + 1).alias("quality"))
    merged = findings.join(rows.filter("source_agent <> target_agent").select("session_ref", "source_agent", "target_agent"), "session_ref")
    merged = merged.groupBy("source_agent", "target_agent", "code", "disposition").agg(F.sum("n").alias("n"))
    return summary, merged


def import_result(items: DataFrame, entries: DataFrame, workspaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined items, one row of totals, items that miss their entry or workspace)."""
    lost = items.join(entries, "session_ref", "left_anti").select("session_ref")
    rows = items.join(entries.select("session_ref", "context", "agent"), "session_ref")
    joined = lookup_join(rows, workspaces.select("context", "target"), ["context"], "left", ["session_ref"])
    lost = lost.unionByName(joined.filter("target IS NULL").select("session_ref"))
    totals = items.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("classification") == "new").alias("new_sessions"),
        F.count_if(F.col("written")).alias("written"), F.count_if(F.col("classification") == "already_present").alias("already_present"),
    )
    return joined.filter("target IS NOT NULL"), totals, lost


# -- resources ------------------------------------------------------------------------------------


def dedupe_resources(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one object per digest with a content-derived object id, paths with different contents)."""
    objects = resources.groupBy("sha256").agg(F.min("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("bindings"))
    objects = objects.withColumn("object_id", F.concat(F.lit("object-"), F.substring("sha256", 1, 16)))
    clash = resources.groupBy("session_ref", "path").agg((F.min("sha256") != F.max("sha256")).alias("_c")).filter("_c").select("session_ref", "path")
    return objects, clash


def resource_plan(resources: DataFrame, target: DataFrame) -> DataFrame:
    """Per destination: sessions, collision, and new / already_present / conflict.

    ``resources``: session_ref, destination, sha256, size_bytes. ``target``: destination, sha256, size_bytes.
    """
    content = F.struct("sha256", "size_bytes")
    plan = resources.groupBy("destination").agg(
        F.count_distinct("session_ref").alias("sessions"), F.min(content).alias("_c"), (F.min(content) != F.max(content)).alias("collision")
    )
    there = target.select("destination", F.struct("sha256", "size_bytes").alias("_t"))
    joined = plan.join(there, "destination", "left")
    state = (
        F.when(F.col("collision"), "collision").when(F.col("_t").isNull(), "new").when(F.col("_t") == F.col("_c"), "already_present").otherwise("conflict")
    )
    return joined.select("destination", "sessions", state.alias("classification"))


def resource_closure(referenced: DataFrame, extracted: DataFrame) -> DataFrame:
    """(sha256, status): referenced but missing, or extracted but unused."""
    missing = referenced.select("sha256").distinct().join(extracted, "sha256", "left_anti").select("sha256", F.lit("missing").alias("status"))
    return missing.unionByName(extracted.select("sha256").distinct().join(referenced, "sha256", "left_anti").select("sha256", F.lit("extra").alias("status")))


def batch_ready(sessions: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: conflicts among sessions and resources, destinations with two contents, verdict."""
    content = F.struct("sha256", "size_bytes")
    clashes = resources.groupBy("destination").agg((F.min(content) != F.max(content)).alias("_c")).agg(F.count_if("_c").alias("clashes"))
    s = sessions.agg(F.count_if(F.col("classification") == "conflict").alias("session_conflicts"))
    r = resources.agg(F.count_if(F.col("classification") == "conflict").alias("resource_conflicts"))
    # Three one-row results side by side: union and a maximum per column.
    row = s.unionByName(r, allowMissingColumns=True).unionByName(clashes, allowMissingColumns=True)
    row = row.agg(*[F.max(c).alias(c) for c in ("session_conflicts", "resource_conflicts", "clashes")])
    return row.withColumn("ready", (F.col("session_conflicts") == 0) & (F.col("resource_conflicts") == 0) & (F.col("clashes") == 0))


# -- providers and consistency --------------------------------------------------------------------


def provider_usage(sessions: DataFrame, current: str | None) -> DataFrame:
    return sessions.groupBy("provider").agg(F.count(F.lit(1)).alias("sessions")).withColumn(
        "current", F.coalesce(F.col("provider") == F.lit(current), F.lit(False))
    )


_LEAST = -(1 << 63)
# Where the length of a decimal number changes, and the length from there on.
_LENGTHS = [(_LEAST, 20), *((1 - 10**j, j + 1) for j in range(18, 0, -1)), (0, 1), *((10**j, j + 1) for j in range(1, 19))]


def _digits(number: Column) -> Column:
    return F.length(number.cast("string"))


def _growth_steps(offset: Column, own: Column) -> Column:
    """How a log grows, as a step function of the shift of its base: sorted (start, value), valid from start on."""
    step = lambda start, length: F.struct(
        (F.lit(start) if start == _LEAST else F.lit(start) - offset).cast("bigint").alias("start"), (own + length - _digits(offset)).cast("bigint").alias("value")
    )
    return F.array(*[step(start, length) for start, length in _LENGTHS])


def _step_at(steps: Column, place: Column) -> Column:
    return F.element_at(F.filter(steps, lambda s: s["start"] <= place), -1)["value"]


def provider_unify(sessions: DataFrame, target: str) -> DataFrame:
    """Before/after provider per session and the moved end offset of its history base.

    ``sessions``: session_ref, provider, base_ref (nullable), base_offset, own_delta (bytes its log
    grows by the new provider). A log moves by its own rewrite plus the change in digits of its own
    base offset, which in turn moves with the base's log. So a log's growth is a step function of
    its base's growth, with one step per number of digits, and the composition with an ancestor's
    function has the ancestor's steps: its size never grows. Pointer doubling composes them along
    the base edges, so a chain of n bases takes log n rounds. Sessions behind a missing base or a
    cycle come back with a null offset.
    """
    changed = F.col("provider") != target
    rows = materialize(sessions.select(
        "session_ref", "provider", "base_ref", "base_offset", F.when(changed, F.col("own_delta")).otherwise(0).cast("bigint").alias("_own")
    ))
    root = F.array(F.struct(F.lit(_LEAST).cast("bigint").alias("start"), F.col("_own").alias("value")))
    steps = F.when(F.col("base_ref").isNull(), root).otherwise(_growth_steps(F.col("base_offset"), F.col("_own")))
    # Growth as a function of the growth of `jump`; without a jump it is settled: one value, or null if nothing leads to a root.
    state = rows.select("session_ref", F.col("base_ref").alias("jump"), steps.alias("steps"))
    total, reach = rows.count(), 1
    while reach <= 2 * total:
        waiting = state.filter("jump IS NOT NULL")
        if waiting.isEmpty():
            break
        upper = state.select(F.col("session_ref").alias("jump"), F.col("jump").alias("_next"), F.col("steps").alias("_upper"))
        met = lookup_join(waiting, upper, ["jump"], "left", ["session_ref"])
        through = F.transform("_upper", lambda u: F.struct(u["start"].alias("start"), _step_at(F.col("steps"), u["value"]).alias("value")))
        state = materialize(state.filter("jump IS NULL").unionByName(met.select("session_ref", F.col("_next").alias("jump"), through.alias("steps"))))
        reach *= 2
    growth = state.filter("jump IS NULL AND steps IS NOT NULL").select(F.col("session_ref").alias("base_ref"), F.col("steps")[0]["value"].alias("_shift"))
    after = (F.col("base_offset") + F.col("_shift")).alias("after_offset")
    return lookup_join(rows, growth, ["base_ref"], "left", ["session_ref"]).select(
        "session_ref", F.col("provider").alias("before"), F.lit(target).alias("after"), changed.alias("changed"), after
    )


def lineage_levels(sessions: DataFrame, node: str = "session_ref", parent: str = "base_ref") -> DataFrame:
    """Projection order of a base forest: bases have smaller depth than their dependents."""
    return forest_depth(sessions, [], node, parent).select(F.col("node").alias(node), "depth")


def consistency_report(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(session_ref, issue) of file metadata against table rows; missing counterparts included."""
    fields = ("provider", "cwd", "path", "archived")
    tag = lambda df, p: df.select("session_ref", F.lit(True).alias(f"_{p}"), *[F.col(c).alias(f"_{p}_{c}") for c in fields])
    joined = tag(files, "f").join(tag(rows, "r"), "session_ref", "full")
    both = F.col("_f").isNotNull() & F.col("_r").isNotNull()
    clean = lambda c, p: normalize_posix(F.col(f"_{p}_{c}")) if c in ("cwd", "path") else F.col(f"_{p}_{c}")
    checks = [F.when(both & ~clean(c, "f").eqNullSafe(clean(c, "r")), F.lit(f"{c}_disagrees")) for c in fields]
    issues = F.array_compact(F.array(F.when(F.col("_r").isNull(), F.lit("row_missing")), F.when(F.col("_f").isNull(), F.lit("file_missing")), *checks))
    return joined.select("session_ref", F.explode(issues).alias("issue"))


def selection_catalog(entries: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(display rows sorted by kind order and reference, skipped sessions without repeats)."""
    rows = entries.select("session_ref", "agent", display_title().alias("title"), "context", kind_order(F.col("agent")).alias("kind_order"))
    return rows.orderBy("kind_order", "session_ref"), skipped.groupBy("session_ref").agg(F.min("reason").alias("reason"))


def resolve_provider(original: Column, policy: str, current: str | None = None, explicit: str | None = None) -> Column:
    """preserve, current or an explicit id; an unresolved current provider or a bad id raises."""
    if policy == "preserve":
        return original
    chosen = current if policy == "current" else explicit
    if policy not in ("current", "explicit") or not chosen:
        raise ValueError("provider cannot be resolved")
    valid = F.lit(chosen).rlike(r"^[A-Za-z0-9._-]{1,128}$")
    return F.when(valid, F.lit(chosen)).otherwise(F.raise_error(F.lit("provider id is invalid")).cast("string"))


def member_spans(text: str) -> list[tuple[str, object, int, int]]:
    """(name, value, start, end) of the members of a JSON object, with the span of each value in the text."""
    space = json.decoder.WHITESPACE.match
    at = space(text, 0).end()
    found, at = [], space(text, at + 1).end()
    while text[at] == '"':
        name, at = json.decoder.scanstring(text, at + 1)
        at = space(text, space(text, at).end() + 1).end()
        value, end = _DECODER.raw_decode(text, at)
        found.append((name, value, at, end))
        at = space(text, end).end()
        if text[at] == ",":
            at = space(text, at + 1).end()
    return found


_DECODER = json.JSONDecoder()


def _spliced(fields: list[str]):
    """Texts with members of the given names replaced where they hold the old value; all other bytes stay."""

    @F.pandas_udf("string")
    def splice(payload: pd.Series, old: pd.DataFrame, new: pd.DataFrame) -> pd.Series:
        out = []
        for text, olds, news in zip(payload, old.itertuples(index=False), new.itertuples(index=False), strict=True):
            if text is not None:
                for name, value, start, end in reversed(member_spans(text)):
                    if name in fields and value == olds[fields.index(name)] != news[fields.index(name)]:
                        text = text[:start] + json.dumps(news[fields.index(name)], ensure_ascii=False) + text[end:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return splice


def rewrite_fields(records: DataFrame, changes: dict[str, tuple[str, str]], only: str = "session_meta") -> tuple[DataFrame, DataFrame]:
    """Replace text fields of metadata payloads where the old value still matches.

    ``records``: session_ref, record_no, type, payload (JSON object), plus the columns that ``changes``
    names: field -> (old column, new column). Only the value of the named member is replaced; unknown
    members and the rest of the text stay as they are. Rows that match go to Python, all others don't.
    Returns the rewritten records and, per session, the number of changed rows and the change in bytes.
    """
    schema = T.StructType([T.StructField(field, T.StringType()) for field in changes])
    parsed, matching = F.from_json("payload", schema), F.lit(False)
    for field, (old, new) in changes.items():
        matching = matching | F.coalesce((parsed[field] == F.col(old)) & (F.col(old) != F.col(new)), F.lit(False))
    rows = records.withColumn("_hit", F.coalesce((F.col("type") == only) & matching, F.lit(False)))
    pair = lambda side: F.struct(*[F.col(c[side]).alias(f) for f, c in changes.items()])
    spliced = _spliced(list(changes))(F.when(F.col("_hit"), F.col("payload")), pair(0), pair(1))
    rows = rows.withColumn("_new", F.when(F.col("_hit"), spliced).otherwise(F.col("payload")))
    delta = F.octet_length("_new") - F.octet_length("payload")
    report = rows.groupBy("session_ref").agg(F.count_if("_hit").alias("changed"), F.sum(delta).cast("bigint").alias("byte_delta"))
    return rows.withColumn("payload", F.col("_new")).drop("_hit", "_new"), report


def three_way(before: DataFrame, after: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Position of each item: before, after, unchanged or diverged. All inputs: key columns, digest."""
    side = lambda df, n: df.select(*key, F.col("digest").alias(n))
    rows = side(before, "_b").join(side(after, "_a"), key, "full").join(side(current, "_c"), key, "full")
    is_before, is_after = F.col("_c").eqNullSafe(F.col("_b")), F.col("_c").eqNullSafe(F.col("_a"))
    state = F.when(is_before & is_after, "unchanged").when(is_before, "before").when(is_after, "after").otherwise("diverged")
    return rows.select(*key, state.alias("position"))


def three_way_rollup(positions: DataFrame, session: str = "session_ref") -> DataFrame:
    states = ("before", "after", "unchanged", "diverged")
    counts = [F.count_if(F.col("position") == s).alias(f"n_{s}") for s in states]
    return positions.groupBy(session).agg(*counts).withColumn("ready", F.col("n_diverged") == 0)


def shared_dimension(source: DataFrame, target: DataFrame, rules: DataFrame) -> DataFrame:
    """Dimension rows: the target's row wins where the id exists, else the source row with mapped
    path and cleared list. Both: id, path, name, listed."""
    mapped, _ = map_paths(source, rules, "path")
    fresh = mapped.select("id", F.struct(F.col("mapped").alias("path"), "name", F.lit("[]").alias("listed")).alias("_s"))
    kept = target.select("id", F.struct("path", "name", "listed").alias("_t"))
    return fresh.join(kept, "id", "left").select("id", F.col("_t").isNotNull().alias("from_target"), F.coalesce("_t", "_s").alias("_r")).select("id", "from_target", "_r.*")


def merge_state(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged rows, keys whose rows differ between two stores), by one full outer join."""
    pack = lambda df, n: df.select(key, F.struct(*columns).alias(n))
    rows = pack(left, "_l").join(pack(right, "_r"), key, "full")
    clash = F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_l").eqNullSafe(F.col("_r"))
    return rows.filter(~clash).select(key, F.coalesce("_l", "_r").alias("_v")).select(key, "_v.*"), rows.filter(clash).select(key)


def valid_uuid(value: Column) -> Column:
    return value.rlike(UUID_PATTERN)
