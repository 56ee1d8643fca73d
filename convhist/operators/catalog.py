"""Listing, selection, library overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.ids import SOURCE_KINDS, valid_reference
from convhist.functions.paths import normalize_posix
from convhist.functions.text import trim_space
from convhist.operators.skew import lookup_join

VIEWS = ("active", "archived", "deleted", "all")
# Page and overlay limits.
MAX_OFFSET, MAX_LIMIT, DEFAULT_LIMIT = 100_000, 1_000, 50
MAX_NAME_BYTES, MAX_TAGS, MAX_TAG_BYTES = 4 * 1024, 64, 256


def library_state(archived: str = "archived", deleted: str = "deleted") -> Column:
    """deleted beats archived beats active."""
    return F.when(F.col(deleted), "deleted").when(F.col(archived), "archived").otherwise("active")


def in_view(view: str) -> Column:
    if view not in VIEWS:
        raise ValueError(f"unsupported view: {view}")
    return F.lit(True) if view == "all" else library_state() == view


def display_title() -> Column:
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("title"))


def check_page(offset: int, limit: int) -> None:
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError("offset must be between 0 and 100000")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError("limit must be between 1 and 1000")


def session_order() -> list[Column]:
    """Newest first, unknown times last, then by reference."""
    return [F.col("updated_at").desc_nulls_last(), F.col("session_ref").asc()]


def select_kinds(requested: list[str] | None) -> list[str]:
    """Requested source kinds without repeats, in product order; all of them by default."""
    unknown = set(requested or ()) - set(SOURCE_KINDS)
    if unknown:
        raise ValueError(f"unsupported source kind: {sorted(unknown)[0]}")
    return [kind for kind in SOURCE_KINDS if not requested or kind in requested]


def visible_sessions(sessions: DataFrame, kinds: list[str] | None = None, view: str = "active") -> DataFrame:
    """Sessions of the kinds and view; the kind filter is literal and prunes partitions."""
    return sessions.filter(F.col("agent").isin(*select_kinds(kinds))).filter(in_view(view))


def summaries(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_ref", "agent", display_title().alias("title"), "context", "model", "provider", "updated_at",
        library_state().alias("library_state"), "tags",
    )


def list_sessions(
    sessions: DataFrame, kinds: list[str] | None = None, view: str = "active", offset: int = 0, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """One page of session summaries. Runs as a distributed top-(offset + limit)."""
    check_page(offset, limit)
    page = visible_sessions(sessions, kinds, view).orderBy(*session_order()).offset(offset).limit(limit)
    return summaries(page)


def page_metadata(matching: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Total, returned, remaining and next offset (null on the last page)."""
    check_page(offset, limit)
    total = matching.agg(F.count(F.lit(1)).alias("total"))
    returned = F.greatest(F.least(F.col("total") - offset, F.lit(limit)), F.lit(0))
    remaining = F.greatest(F.col("total") - offset - F.col("returned"), F.lit(0))
    return total.withColumn("returned", returned.cast("bigint")).select(
        "total", F.lit(offset).cast("bigint").alias("offset"), F.lit(limit).cast("bigint").alias("limit"), "returned",
        remaining.cast("bigint").alias("remaining"),
        F.when(remaining > 0, F.col("returned") + offset).cast("bigint").alias("next_offset"),
    )


def show_session(sessions: DataFrame, items: DataFrame, reference: str) -> DataFrame:
    """The conversation of one session in order.

    The source kind is read from the reference itself, so a table partitioned by kind reads one
    partition; the reference filter is pushed down to the item scan.
    """
    kind = reference.split(":", 1)[0]
    if kind not in SOURCE_KINDS:
        raise ValueError("invalid session reference")
    head = sessions.filter((F.col("agent") == kind) & (F.col("session_ref") == reference))
    head = head.select("session_ref", F.struct(display_title().alias("title"), F.col("name").alias("library_name")).alias("_h"))
    # A reference that stands twice is an error, not a choice; what is broadcast is one row.
    head = head.groupBy("session_ref").agg(F.min("_h").alias("_h"), F.count(F.lit(1)).alias("_n"))
    repeated = F.raise_error(F.concat(F.lit("repeated session reference "), "session_ref")).cast("string")
    head = head.select("session_ref", F.when(F.col("_n") > 1, repeated).otherwise(F.col("_h.title")).alias("title"), F.col("_h.library_name").alias("library_name"))
    return items.filter(F.col("session_ref") == reference).join(F.broadcast(head), "session_ref").orderBy("ordinal")


def select_by_reference(sessions: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions asked for, and the asked references that do not exist."""
    wanted = requested.select("session_ref").distinct()
    return sessions.join(wanted, "session_ref", "left_semi"), wanted.join(sessions, "session_ref", "left_anti")


def require_all(selected: DataFrame, missing: DataFrame, what: str = "session") -> DataFrame:
    """Raise naming one missing item; reads at most one row of the report."""
    first = missing.orderBy(*missing.columns).head(1)
    if first:
        raise ValueError(f"{what} was not found: {first[0][0]}")
    return selected


def select_by_workspace(sessions: DataFrame, workspaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact workspace identity after path normalisation; plus workspaces without a session."""
    keyed = sessions.withColumn("_path", normalize_posix(F.col("context")))
    wanted = workspaces.select(normalize_posix(F.col("workspace")).alias("_path"), "workspace").distinct()
    return keyed.join(wanted, "_path", "left_semi").drop("_path"), wanted.join(keyed, "_path", "left_anti").select("workspace")


def ancestor_paths(path: Column) -> Column:
    """The absolute path and all its ancestors; an equi-join on them replaces a prefix theta join."""
    segments = F.filter(F.split(path, "/"), lambda part: part != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(segments)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/")),
    )
    return F.when(path.startswith("/"), prefixes).otherwise(F.array().cast("array<string>"))


def sessions_in_tree(sessions: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(workspace, session) pairs where the session's directory is the workspace or lies below it.

    Each session lists its ancestor directories (as many as the path is deep), so the match is an
    equi-join at any number of workspaces instead of a nested loop. Relative contexts never match.
    """
    chains = sessions.withColumn("_dir", F.explode(F.array_distinct(ancestor_paths(normalize_posix(F.col("context"))))))
    wanted = workspaces.select(
        F.regexp_replace(normalize_posix(F.col("workspace")), "(?<=.)/$", "").alias("_dir"), "workspace"
    ).distinct()
    return lookup_join(chains, wanted, ["_dir"], "inner", ["session_ref"]).drop("_dir")


def scope_counts(
    sessions: DataFrame, mode: str, workspaces: DataFrame | None = None, references: DataFrame | None = None,
    since: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Select by exactly one of all / workspace / session, then by time.

    Returns the selected sessions and one row of counts: selected, outside the scope, before
    ``since``, deleted. Deleted sessions are not eligible, but those in scope are counted.
    """
    if mode not in ("all", "workspace", "session"):
        raise ValueError("selection accepts only one of workspace, session or all")
    if mode == "all":
        marked = sessions.withColumn("_scoped", F.lit(True))
    else:
        if mode == "session":
            inside = sessions.join(references.select("session_ref").distinct(), "session_ref", "left_semi")
        else:
            inside = sessions_in_tree(sessions, workspaces)
        inside = inside.select("session_ref").distinct().withColumn("_scoped", F.lit(True))
        marked = sessions.join(inside, "session_ref", "left").withColumn("_scoped", F.coalesce("_scoped", F.lit(False)))
    late = F.lit(True) if since is None else F.coalesce(F.col("updated_at") >= F.lit(since).cast("timestamp_ntz"), F.lit(False))
    live, scoped = ~F.col("deleted"), F.col("_scoped")
    counts = marked.agg(
        F.count_if(live & scoped & late).alias("selected"),
        F.count_if(live & ~scoped).alias("outside_scope"),
        F.count_if(live & scoped & ~late).alias("before_since"),
        F.count_if(~live & scoped).alias("deleted_in_scope"),
    )
    return marked.filter(live & scoped & late).drop("_scoped"), counts


# -- library overlay ----------------------------------------------------------------------------


def apply_overlay(sessions: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay rows win over captured name, tags and flags; unseen sessions start empty and active."""
    own = overlay.select(
        "session_ref", F.struct("name", "tags", "archived", "deleted").alias("_o")
    )
    joined = sessions.join(own, "session_ref", "left")
    defaults = {"name": F.lit(""), "tags": F.array().cast("array<string>"), "archived": F.lit(False), "deleted": F.lit(False)}
    for field, empty in defaults.items():
        captured = F.col(field) if field in sessions.columns else F.lit(None)
        joined = joined.withColumn(field, F.coalesce(F.col(f"_o.{field}"), captured, empty))
    return joined.drop("_o")


def _valid_text(value: Column, limit: int, allow_empty: bool) -> Column:
    sound = (F.octet_length(value) <= limit) & (trim_space(value) == value) & ~value.rlike(r"[\x00-\x1f\x7f]")
    return sound if allow_empty else sound & (value != "")


def valid_library(name: Column, tags: Column) -> Column:
    """Name and tag limits: trimmed, no control characters, bounded, tags strictly ascending."""
    return F.coalesce(
        _valid_text(name, MAX_NAME_BYTES, True)
        & (F.size(tags) <= MAX_TAGS)
        & F.forall(tags, lambda tag: _valid_text(tag, MAX_TAG_BYTES, False))
        & (tags == F.array_sort(F.array_distinct(tags))),
        F.lit(False),
    )


def operation_issue(op: Column, name: Column, add: Column, remove: Column) -> Column:
    """Reason why a mutation is malformed, null if it is fine."""
    no_tags = (F.size(add) == 0) & (F.size(remove) == 0)
    none = F.array().cast("array<string>")
    union = F.array_sort(F.array_union(add, remove))
    return (
        F.when(~op.isin("rename", "tag", "archive", "unarchive", "delete", "undelete"), "invalid_operation")
        .when((op == "rename") & (name.isNull() | ~no_tags | ~valid_library(name, none)), "invalid_rename")
        .when(
            (op == "tag") & (name.isNotNull() | no_tags | F.arrays_overlap(add, remove) | ~valid_library(F.lit(""), union)),
            "invalid_tag",
        )
        .when(~op.isin("rename", "tag") & (name.isNotNull() | ~no_tags), "invalid_arguments")
    )


def mutate_library(library: DataFrame, operations: DataFrame) -> DataFrame:
    """Apply one mutation per session; returns before, after, changed, and an issue or conflict.

    ``operations``: session_ref, op, new_name, add_tags, remove_tags (one row per session). Rows
    with an issue leave the library untouched.
    """
    joined = operations.join(library, "session_ref", "left")
    op = F.col("op")
    add = F.array_distinct(F.coalesce("add_tags", F.array().cast("array<string>")))
    remove = F.array_distinct(F.coalesce("remove_tags", F.array().cast("array<string>")))
    after_tags = F.when(op == "tag", F.array_sort(F.array_except(F.array_union(F.col("tags"), add), remove))).otherwise(F.col("tags"))
    after_name = F.when(op == "rename", F.col("new_name")).otherwise(F.col("name"))
    issue = (
        F.when(~valid_reference(F.col("session_ref")), "invalid_reference")
        .when(F.col("archived").isNull(), "not_found")
        .when(operation_issue(op, F.col("new_name"), add, remove).isNotNull(), operation_issue(op, F.col("new_name"), add, remove))
        .when(op.isin("archive", "unarchive") & F.col("deleted"), "conflict_deleted")
        .when(~valid_library(after_name, after_tags), "invalid_result")
    )
    joined = joined.withColumn("issue", issue)
    fine = F.col("issue").isNull()
    after = F.struct(
        F.when(fine, after_name).otherwise(F.col("name")).alias("name"),
        F.when(fine, after_tags).otherwise(F.col("tags")).alias("tags"),
        F.when(fine & op.isin("archive", "unarchive"), op == "archive").otherwise(F.col("archived")).alias("archived"),
        F.when(fine & op.isin("delete", "undelete"), op == "delete").otherwise(F.col("deleted")).alias("deleted"),
    )
    before = F.struct("name", "tags", "archived", "deleted")
    return joined.select("session_ref", "op", "issue", before.alias("before"), after.alias("after")).withColumn(
        "changed", ~F.col("before").eqNullSafe(F.col("after"))
    )


def library_view(value: Column) -> Column:
    """State, and for a deleted session the state it would be restored to."""
    state = F.when(value["deleted"], "deleted").when(value["archived"], "archived").otherwise("active")
    restore = F.when(value["deleted"], F.when(value["archived"], "archived").otherwise("active"))
    return F.struct(value["name"].alias("name"), value["tags"].alias("tags"), state.alias("state"), restore.alias("restore_state"))


def upsert_library(library: DataFrame, mutated: DataFrame) -> DataFrame:
    """Library after the changed rows replaced their predecessors."""
    changed = mutated.filter("changed").select("session_ref", "after.*")
    kept = library.join(changed.select("session_ref"), "session_ref", "left_anti")
    return kept.select(*changed.columns).unionByName(changed)


