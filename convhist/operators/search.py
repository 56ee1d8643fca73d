"""Literal search: one hit per session, the first match in priority order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.text import matches, snippet, trim_space
from convhist.operators.catalog import DEFAULT_LIMIT, check_page, session_order

FIELDS = ("name", "tag", "title", "context", "model", "session_ref", "content")


def check_query(query: str) -> str:
    if query == "" or "\0" in query or len(query.encode("utf-8")) > 512:
        raise ValueError("search query must be non-empty UTF-8 without NUL and at most 512 bytes")
    return query


def block_search_text(block: Column) -> Column:
    """Searchable strings of one wide content block, in field order, empty ones dropped."""
    kind = block["kind"]
    tool, resource, reference = block["tool"], block["resource"], block["reference"]

    def resource_fields(r: Column) -> list[Column]:
        return [r["name"], r["media_type"], r["source_reference"], r["relative_path"], r["sha256"]]

    def reference_fields(r: Column) -> list[Column]:
        return [r["type"], r["namespace"], r["locator"], r["title"], r["context"], r["citations"]]

    def nested(values: Column, fields) -> Column:
        return F.flatten(F.transform(F.coalesce(values, F.array()), lambda r: F.array(*fields(r))))

    work = F.flatten(
        F.transform(
            block["work_items"],
            lambda w: F.concat(
                F.array(w["id"], w["title"], w["description"], w["active_label"], w["assignee"], w["priority"], w["status"]),
                F.coalesce(w["blocks"], F.array().cast("array<string>")),
                F.coalesce(w["blocked_by"], F.array().cast("array<string>")),
            ),
        )
    )
    empty = F.array().cast("array<string>")
    texts = (
        F.when(kind.isin("text", "reasoning_trace"), F.array(block["text"]))
        .when(kind == "citations", F.array(block["citations"]))
        .when(kind == "context", F.array(block["source_role"], block["text"]))
        .when(kind == "event", F.array(block["event"], block["reason"]))
        .when(kind == "work_state", F.concat(F.array(block["source_kind"]), work))
        .when(kind == "reasoning", block["summary"])
        .when(kind == "reference", F.array(*reference_fields(reference)))
        .when(kind == "resource", F.array(*resource_fields(resource)))
        .when(
            kind == "tool",
            F.concat(
                F.array(tool["call_id"], tool["name"], tool["namespace"], tool["status"], tool["input"], tool["output"], tool["error"]),
                F.coalesce(nested(tool["resources"], resource_fields), empty),
                F.coalesce(nested(tool["references"], reference_fields), empty),
            ),
        )
    )
    return F.filter(F.coalesce(texts, empty), lambda text: F.coalesce(text, F.lit("")) != "")


def _place(priority: int, ordinal: Column, part: Column | None = None) -> Column:
    """Sortable place of a value: metadata, then conversation, then the extra search text."""
    part = F.lit(0) if part is None else part
    return F.struct(
        F.lit(priority).cast("bigint").alias("p"), ordinal.cast("bigint").alias("o"), part.cast("bigint").alias("s")
    ).alias("place")


def first_hits(sessions: DataFrame, items: DataFrame, query: str, search_text: DataFrame | None = None) -> DataFrame:
    """(session_ref, field, snippet) of the first match per session.

    Metadata and content are matched row by row next to their scans; only matching rows are
    aggregated, by a map-side combined ``min_by`` on the place. A match in metadata outranks any
    content, so content of sessions already hit still takes part in the same aggregate -- one pass.
    """
    check_query(query)
    meta = sessions.select(
        "session_ref",
        F.posexplode(
            F.concat(
                F.array(F.struct(F.lit("name").alias("field"), F.col("name").alias("value"))),
                F.transform("tags", lambda tag: F.struct(F.lit("tag").alias("field"), tag.alias("value"))),
                F.array(*[
                    F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
                    for c in ("title", "context", "model", "session_ref")
                ]),
            )
        ).alias("_o", "_v"),
    ).select("session_ref", _place(0, F.col("_o")), "_v.field", "_v.value")
    said = F.when(F.col("kind") == "gap", F.col("label")).otherwise(F.col("text"))
    content = items.select(
        "session_ref", _place(1, F.col("ordinal")),
        F.lit("content").alias("field"), said.alias("value"),
    )
    parts = [meta, content]
    if "blocks" in items.columns:
        texts = F.flatten(F.transform(F.coalesce("blocks", F.array()), block_search_text))
        parts.append(
            items.filter("kind <> 'gap'").select("session_ref", "ordinal", F.posexplode(texts).alias("_b", "value")).select(
                "session_ref", _place(1, F.col("ordinal"), F.col("_b") + 1),
                F.lit("content").alias("field"), "value",
            )
        )
    if search_text is not None:
        parts.append(
            search_text.select(
                "session_ref", _place(2, F.col("position")),
                F.lit("content").alias("field"), "value",
            )
        )
    # Each part is filtered on its own, so the match runs in the scan stage of its table.
    hits = [p.filter(matches(F.col("value"), query)).select("session_ref", "place", "field", snippet(F.col("value"), query).alias("snippet")) for p in parts]
    merged = hits[0]
    for part in hits[1:]:
        merged = merged.unionByName(part)
    best = merged.groupBy("session_ref").agg(F.min_by(F.struct("field", "snippet"), F.col("place")).alias("_h"))
    return best.select("session_ref", "_h.field", "_h.snippet")


def search(
    sessions: DataFrame, items: DataFrame, query: str, offset: int = 0, limit: int = DEFAULT_LIMIT,
    search_text: DataFrame | None = None,
) -> DataFrame:
    """One page of hits in session order; ``sessions`` is already restricted to kinds and view."""
    check_page(offset, limit)
    hits = first_hits(sessions, items, query, search_text)
    page = sessions.join(hits, "session_ref").orderBy(*session_order()).offset(offset).limit(limit)
    return page.select("session_ref", "agent", "title", "updated_at", "field", "snippet")


def extra_search_text(entries: DataFrame, value: str = "text") -> DataFrame:
    """Distinct non-empty trimmed strings of all entries of a session with their first position.

    Rows, not arrays: a session with very many strings stays distributed.
    """
    cleaned = entries.select("session_ref", "ordinal", trim_space(F.col(value)).alias("value")).filter("value <> ''")
    return cleaned.groupBy("session_ref", "value").agg(F.min("ordinal").alias("position"))

