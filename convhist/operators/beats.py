"""Turn windows ("beats"), their bounded evidence, and byte-bounded text cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convhist.functions.ids import canonical_digest, framed, framed_digest, multiset_digest, structural_text
from convhist.functions.paths import normalize_posix
from convhist.functions.text import (
    ENVELOPE_TAG,
    envelope_name,
    envelope_payload,
    envelopes,
    exceeds,
    strip_envelopes,
    token_estimate,
    utf8_bytes,
    utf8_prefix,
)
from convhist.operators.ordered import (
    following_row,
    last_value,
    next_value,
    position,
    previous_row,
    running_sum,
    scan,
    total_max,
)
from convhist.operators.skew import lookup_join

# Byte budgets of one beat and its cards.
ADJACENT_USER_BYTES = 3 * 1024
PRECEDING_ASSISTANT_BYTES = 4 * 1024
FOLLOWING_ASSISTANT_BYTES = 6 * 1024
CARD_TEXT_BYTES = 8 * 1024
PARSER_VERSION = "beats/1"


def visible_text(text: Column, blocks: Column | None = None, tag: str = ENVELOPE_TAG) -> Column:
    """Text blocks joined by a blank line (else the raw text), envelopes removed, trimmed."""
    if blocks is not None:
        joined = F.array_join(
            F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: b["text"]), "\n\n"
        )
        text = F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, joined).otherwise(text)
    return strip_envelopes(text, tag)


def with_visible(items: DataFrame, tag: str = ENVELOPE_TAG) -> DataFrame:
    """Adds ``visible``; ``tag`` names the envelopes that the exporting tool embeds in texts."""
    blocks = F.col("blocks") if "blocks" in items.columns else None
    return items.withColumn("visible", visible_text(F.col("text"), blocks, tag))


def spoken_items(items: DataFrame, tag: str = ENVELOPE_TAG) -> DataFrame:
    """What beats, evidence and digests read of items, with ``visible`` and ``evidence``: stored once, they pass ``known``."""
    return with_visible(items, tag).select(
        "session_ref", "ordinal", "kind", "role", "ts", "code", "label", "visible", evidence_identity(items, tag).alias("evidence")
    )


def _is_gap() -> Column:
    return F.col("kind") == "gap"


def _says(role: str) -> Column:
    return ~_is_gap() & (F.col("role") == role)


def beats(
    items: DataFrame, chunk_rows: int | None = None, tag: str = ENVELOPE_TAG, adjacent_bytes: int = ADJACENT_USER_BYTES, known: bool = False
) -> DataFrame:
    """One row per user message with visible text, with its neighbours and the end of its turn; ``known``: see :func:`spoken_items`.

    The first scan looks at every item but carries two integers only; the second runs over the
    boundary rows (user messages and gaps) and carries at most ``adjacent_bytes`` of text.
    """
    # Only user texts travel; assistant texts, the bulk of a corpus, stay out of this shuffle.
    said = F.when(_says("user"), F.col("visible")).alias("visible")
    rows = (items if known else with_visible(items, tag)).select("session_ref", "ordinal", "kind", "role", "ts", said)
    assistant = F.when(_says("assistant"), F.col("ordinal"))
    rows = scan(
        rows, ["session_ref"], "ordinal",
        {"_before": last_value(assistant, strict=True), "_final": total_max(assistant)}, chunk_rows,
    )
    spoken = _says("user") & (F.col("visible") != "")
    edge = F.struct(
        "ordinal", "ts", _is_gap().alias("gap"), F.col("_before").alias("assistant_before"),
        F.when(spoken, utf8_prefix(F.col("visible"), adjacent_bytes)).alias("text"),
        F.when(spoken, exceeds(F.col("visible"), adjacent_bytes)).alias("truncated"),
    )
    edges = rows.filter(_is_gap() | _says("user"))
    edges = scan(
        edges, ["session_ref"], "ordinal", {"_p": previous_row(edge), "_n": following_row(edge)}, chunk_rows
    )
    own = F.col("ordinal")
    following = F.col("_n.v")
    last_assistant = F.when(F.col("_n").isNull(), F.col("_final")).otherwise(following["assistant_before"])
    neighbours = []
    for name, side in (("previous", F.col("_p.v")), ("next", following)):
        found = side["text"].isNotNull()
        for field in ("ordinal", "ts", "text", "truncated"):
            neighbours.append(F.when(found, side[field]).alias(f"{name}_user_{field}"))
    return edges.filter(spoken).select(
        "session_ref",
        own.alias("turn_start"),
        F.when(following["gap"], following["ordinal"]).otherwise(F.greatest(own, last_assistant)).alias("turn_end"),
        F.col("ts").alias("user_ts"),
        F.col("visible").alias("user_text"),
        *neighbours,
    )


def assistant_evidence(
    items: DataFrame, chunk_rows: int | None = None, tag: str = ENVELOPE_TAG,
    before_bytes: int = PRECEDING_ASSISTANT_BYTES, after_bytes: int = FOLLOWING_ASSISTANT_BYTES, known: bool = False,
) -> DataFrame:
    """Assistant messages before and after each beat, within their byte budgets; ``known``: see :func:`spoken_items`.

    A message is cut at the first budget overrun; later messages of that side are left out. The
    rows kept per beat are therefore bounded by the budget itself.
    """
    # No more than the larger budget of a message can be kept, so the shuffles carry that prefix and
    # the true size; user rows carry a flag instead of their text.
    most = max(before_bytes, after_bytes)
    rows = (items if known else with_visible(items, tag)).select(
        "session_ref", "ordinal", "kind", "role", "ts", (F.col("visible") != "").alias("spoken"),
        F.when(_says("assistant"), utf8_prefix(F.col("visible"), most)).alias("head"),
        F.when(_says("assistant"), utf8_bytes(F.col("visible"))).alias("size"),
    )
    edge = F.when(_is_gap() | _says("user"), F.struct("ordinal", (_says("user") & F.col("spoken")).alias("user")))
    rows = scan(
        rows, ["session_ref"], "ordinal",
        {"_p": last_value(edge, strict=True), "_n": next_value(edge, strict=True)}, chunk_rows,
    ).filter(_says("assistant") & F.col("spoken"))
    sides = F.array_compact(
        F.array(
            F.when(F.col("_p.user"), F.struct(F.lit("after").alias("side"), F.col("_p.ordinal").alias("turn_start"))),
            F.when(F.col("_n.user"), F.struct(F.lit("before").alias("side"), F.col("_n.ordinal").alias("turn_start"))),
        )
    )
    rows = rows.select("session_ref", "ordinal", "ts", "head", "size", F.inline(sides))
    rows = scan(
        rows, ["session_ref", "turn_start", "side"], "ordinal", {"_used": running_sum(F.col("size"), strict=True)}, chunk_rows
    )
    budget = F.when(F.col("side") == "after", after_bytes).otherwise(before_bytes)
    left = budget - F.col("_used")
    return rows.filter(left > 0).select(
        "session_ref", "turn_start", "side", "ordinal", "ts",
        utf8_prefix(F.col("head"), left).alias("text"),
        (F.col("size") > left).alias("truncated"),
    )


def _fragment_end(view: Column, limit: int) -> Column:
    """Length of the fragment that a longer text begins with.

    ``view``: the ``limit + 1`` bytes from its start on, one character per byte. The fragment ends behind the last blank
    line of its second half, else behind the last line break there, else at the last whole character. A blank line may
    begin on the last byte.
    """
    byte = lambda at: F.substring(view, at + 1, 1)
    inner = [byte(limit - k).between("\x80", "\xbf") for k in range(3)]
    whole = limit - F.when(~inner[0], 0).when(~inner[1], 1).when(~inner[2], 2).otherwise(3)
    half = F.floor(whole / 2).cast("int")
    late = lambda extra: F.reverse(F.substring(view, half + 1, whole - half + extra))
    blank, line = F.locate("\n\n", late(1)), F.locate("\n", late(0))
    return F.when(blank > 0, whole + 2 - blank).when(line > 0, whole + 1 - line).otherwise(whole)


def _fragment_ends(text: Column, limit: int) -> Column:
    """Byte offsets where the fragments of a text of more than ``limit`` bytes end: a fold over its fragments.

    Each step reads ``limit + 1`` bytes; a fragment has more than half of the limit, which bounds the number of steps.
    """
    raw = text.cast("binary")
    size = utf8_bytes(text)
    steps = F.sequence(F.lit(1).cast("bigint"), F.floor(size / ((limit - 3) // 2 + 1)) + 1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("ends"), raw.alias("raw"), size.alias("size"))

    def cut(state: Column, _: Column) -> Column:
        view = F.decode(F.substring(state["raw"], (state["at"] + 1).cast("int"), F.lit(limit + 1)), "ISO-8859-1")
        end = F.when(state["size"] - state["at"] <= limit, state["size"]).otherwise(state["at"] + _fragment_end(view, limit)).cast("bigint")
        done = state["at"] >= state["size"]
        return F.struct(
            F.when(done, state["at"]).otherwise(end).alias("at"), F.when(done, state["ends"]).otherwise(F.array_append(state["ends"], end)).alias("ends"),
            state["raw"].alias("raw"), state["size"].alias("size"),
        )

    return F.aggregate(steps, start, cut, lambda state: state["ends"])


def split_text(df: DataFrame, text: str, limit: int = CARD_TEXT_BYTES) -> DataFrame:
    """Explode a text into fragments of about ``limit`` bytes at paragraph or line breaks.

    Column expressions throughout. Texts up to the limit stay one fragment.
    """
    if limit < 64:
        raise ValueError("text byte limit must be at least 64")
    size = utf8_bytes(F.col(text))
    whole = F.when(size > 0, F.array(size.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    ends = F.when(size > limit, _fragment_ends(F.col(text), limit)).otherwise(whole)
    pieces = (
        df.withColumn("_ends", ends)
        .withColumn("fragment_count", F.size("_ends").cast("bigint"))
        .select("*", F.posexplode("_ends").alias("_i", "byte_end"))
        .withColumn("byte_start", F.when(F.col("_i") == 0, F.lit(0)).otherwise(F.expr("_ends[_i - 1]")).cast("bigint"))
    )
    body = F.substring(
        F.col(text).cast("binary"), (F.col("byte_start") + 1).cast("int"),
        (F.col("byte_end") - F.col("byte_start")).cast("int"),
    )
    return pieces.withColumn("fragment_index", F.col("_i").cast("bigint")).withColumn(
        "fragment_text", body.cast("string")
    ).drop("_ends", "_i")


def project_key(context: Column) -> Column:
    """Hash of the normalised working directory; the empty directory keeps its own key."""
    return F.concat(F.lit("project1_"), F.sha2(F.when(context == "", "").otherwise(normalize_posix(context)), 256))


# What of a block of each kind tells conversations apart; the other kinds count by their text. Texts and
# tool calls are compared elsewhere.
EVIDENCE_MEMBERS = {
    "citations": ("citations",),
    "context": ("source_role", "text"),
    "event": ("event", "reason"),
    "reasoning": ("summary",),
    "reference": ("reference",),
    "resource": ("resource",),
    "work_state": ("source_kind", "work_items"),
}
RESOURCE_MEMBERS = ("media_type", "name", "sha256", "size_bytes")
ENVELOPE_CONTEXT = ("notice", "resolve_against", "source_agent")


def block_evidence(blocks: Column, kind: T.ArrayType) -> Column:
    """Canonical text of the evidence in a list of wide blocks, in block order; empty if there is none."""
    fields = {f.name: f.dataType for f in kind.elementType.fields}

    def picked(block: Column, names: tuple[str, ...]) -> Column:
        columns, types = [block["kind"].alias("kind")], [T.StructField("kind", T.StringType())]
        for name in names:
            value, type_ = block[name], fields.get(name)
            if type_ is None:
                continue
            if name == "resource":
                kept = [f for f in type_.fields if f.name in RESOURCE_MEMBERS]
                value, type_ = F.when(value.isNotNull(), F.struct(*[value[f.name].alias(f.name) for f in kept])), T.StructType(kept)
            columns.append(value.alias(name))
            types.append(T.StructField(name, type_))
        return structural_text(F.struct(*columns), T.StructType(types))

    def one(block: Column) -> Column:
        text = F.when(block["kind"].isin("text", "tool"), F.lit(""))
        for name, members in EVIDENCE_MEMBERS.items():
            text = text.when(block["kind"] == name, framed(picked(block, members)))
        return text.otherwise(framed(picked(block, ("text",))))

    return F.array_join(F.transform(blocks, one), "")


def envelope_evidence(text: Column, tag: str = ENVELOPE_TAG) -> Column:
    """Canonical text of the evidence embedded in a text: names and payloads of all envelopes but those of tools."""

    def one(envelope: Column) -> Column:
        payload = F.try_parse_json(envelope_payload(envelope)).cast("map<string,variant>")
        said = F.map_filter(payload, lambda k, _: ~k.isin(*ENVELOPE_CONTEXT))
        return F.concat(framed(envelope_name(envelope, tag)), framed(structural_text(said, T.MapType(T.StringType(), T.VariantType()))))

    found = F.filter(envelopes(text, tag), lambda e: envelope_name(e, tag) != "HISTORICAL_TOOL_EVIDENCE")
    return F.array_join(F.transform(found, one), "")


def evidence_identity(items: DataFrame, tag: str = ENVELOPE_TAG) -> Column:
    """Digest of what a message brings beside text and tools, empty if nothing: from its blocks, else its envelopes."""
    embedded = envelope_evidence(F.col("text"), tag)
    if "blocks" in items.columns:
        embedded = F.when(F.col("blocks").isNull(), embedded).otherwise(block_evidence(F.col("blocks"), items.schema["blocks"].dataType))
    text = F.coalesce(embedded, F.lit(""))
    return F.when(text == "", "").otherwise(F.sha2(text, 256))


def logical_digest(
    items: DataFrame, tools: DataFrame | None = None, chunk_rows: int | None = None, tag: str = ENVELOPE_TAG, known: bool = False
) -> DataFrame:
    """Order-sensitive digest of what a conversation says, equal for migrated copies.

    Positions come from a chunked scan and row digests are summed map-side, so one huge session
    is never gathered in a task. ``tools`` may add a ``tools_digest`` per (session_ref, ordinal);
    an optional column ``blocks`` of ``items`` brings evidence, see :func:`evidence_identity`; ``known``: see
    :func:`spoken_items`.
    """
    # Texts are hashed where they are read; only fixed-size digests are shuffled.
    content = F.when(_is_gap(), framed_digest(F.col("code"), F.col("label"))).otherwise(F.sha2("visible", 256))
    evidence = F.when(_is_gap(), "").otherwise(F.col("evidence") if known else evidence_identity(items, tag))
    rows = (items if known else with_visible(items, tag)).select("session_ref", "ordinal", "kind", "role", "ts", content.alias("content"), evidence.alias("evidence"))
    rows = scan(rows, ["session_ref"], "ordinal", {"_pos": position()}, chunk_rows)
    extra = F.lit("")
    if tools is not None:
        rows = rows.join(tools, ["session_ref", "ordinal"], "left")
        extra = F.coalesce(F.col("tools_digest"), F.lit(""))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    gap = framed_digest(F.col("_pos"), F.lit("gap"), at, F.col("content"))
    said = framed_digest(F.col("_pos"), F.col("role"), at, F.col("content"), extra, F.col("evidence"))
    return rows.groupBy("session_ref").agg(
        multiset_digest("logical1_", F.when(_is_gap(), gap).otherwise(said)).alias("logical_digest")
    )


def cards(
    beat_rows: DataFrame, evidence: DataFrame, sessions: DataFrame, lineages: DataFrame,
    tools: DataFrame | None = None, limit: int = CARD_TEXT_BYTES,
) -> DataFrame:
    """One discovery card per beat fragment with content digest, reference, size and token estimate.

    ``sessions`` brings agent, context and source_revision; ``lineages`` the lineage_ref. Evidence
    lists are bounded by the byte budgets of :func:`assistant_evidence`, so collecting them per
    beat is safe. ``tools`` may bring (session_ref, turn_start, tools, omitted_tools).
    """
    lists = evidence.groupBy("session_ref", "turn_start").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "before", F.struct("ordinal", "text", "truncated")))).alias("preceding_assistant"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "after", F.struct("ordinal", "text", "truncated")))).alias("assistant"),
    )
    empty = F.array().cast("array<struct<ordinal:bigint,text:string,truncated:boolean>>")
    head = sessions.select("session_ref", "agent", "context", "source_revision").join(lineages, "session_ref")
    rows = lookup_join(beat_rows, head, ["session_ref"], "inner", ["turn_start"])
    rows = rows.join(lists, ["session_ref", "turn_start"], "left")
    for name in ("preceding_assistant", "assistant"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), empty))
    if tools is None:
        rows = rows.withColumn("tools", F.lit("[]")).withColumn("omitted_tools", F.lit(0).cast("bigint"))
    else:
        rows = rows.join(tools, ["session_ref", "turn_start"], "left")
        rows = rows.withColumn("tools", F.coalesce("tools", F.lit("[]"))).withColumn(
            "omitted_tools", F.coalesce("omitted_tools", F.lit(0).cast("bigint"))
        )
    rows = split_text(rows, "user_text", limit)
    at = F.date_format("user_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    content = dict(
        turn_start=F.col("turn_start"), turn_end=F.col("turn_end"), user_ts=at,
        fragment_index=F.col("fragment_index"), user_text=F.col("fragment_text"),
        previous_user=F.col("previous_user_text"), next_user=F.col("next_user_text"),
        preceding_assistant=F.col("preceding_assistant"), assistant=F.col("assistant"),
        tools=F.col("tools"), omitted_tools=F.col("omitted_tools"),
    )
    rows = rows.withColumn("content_digest", canonical_digest("content1_", **content))
    rows = rows.withColumn(
        "card_ref",
        F.concat(F.lit("card1_"), framed_digest(
            F.lit(PARSER_VERSION), F.col("session_ref"), F.col("source_revision"), F.col("turn_start"),
            F.col("fragment_index"), F.col("content_digest"))),
    ).withColumn(
        "beat_ref",
        F.concat(F.lit("beat1_"), framed_digest(
            F.lit(PARSER_VERSION), F.col("session_ref"), F.col("source_revision"), F.col("turn_start"), F.col("user_text"))),
    ).withColumn("project_key", project_key(F.col("context")))
    request = F.to_json(
        F.struct(
            F.col("card_ref").alias("discovery_id"), "agent", "project_key", "context", at.alias("timestamp"),
            "turn_start", "turn_end", "byte_start", "byte_end", F.col("fragment_text").alias("user_text"),
            F.col("previous_user_text").alias("previous_user"), "preceding_assistant", "assistant", "tools",
            "omitted_tools", F.col("next_user_text").alias("next_user"),
        ),
        {"ignoreNullFields": "false"},
    )
    rows = rows.withColumn("_request", request)
    return rows.withColumn("request_bytes", utf8_bytes(F.col("_request"))).withColumn(
        "estimated_tokens", token_estimate(F.col("_request"))
    ).drop("_request", "user_text")


def fold_duplicates(card_rows: DataFrame) -> DataFrame:
    """Per (lineage, content digest) keep the smallest card reference, by an aggregate and a semi-join.

    Reads ``card_rows`` twice: pass a stored table rather than a long plan.
    """
    kept = card_rows.groupBy("lineage_ref", "content_digest").agg(F.min("card_ref").alias("card_ref"))
    return card_rows.join(kept.select("card_ref"), "card_ref", "left_semi")


def corpus_profile(session_rows: DataFrame, card_rows: DataFrame, folded: DataFrame) -> DataFrame:
    """Per source kind and in total: sessions, beats, cards, lineages, projects, queued and folded cards.

    ``session_rows``: session_ref, agent, archived, logical_digest, updated_at. Distinct counts run
    on one narrow union, so each group is pre-aggregated before it is shuffled.
    """
    by_session = session_rows.rollup("agent").agg(
        F.grouping("agent").alias("_all"),
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("archived").alias("archived"),
        F.min("updated_at").alias("earliest"),
        F.max("updated_at").alias("latest"),
    )
    copies = session_rows.groupBy("agent", "logical_digest").agg(F.count(F.lit(1)).alias("n"))
    duplicates = (
        copies.groupBy("agent").agg(F.sum(F.col("n") - 1).alias("duplicates")).withColumn("_all", F.lit(0))
    ).unionByName(
        copies.groupBy("logical_digest").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"))
        .withColumn("agent", F.lit(None).cast("string")).withColumn("_all", F.lit(1))
    )
    by_card = card_rows.rollup("agent").agg(
        F.grouping("agent").alias("_all"),
        F.count(F.lit(1)).alias("cards"),
        F.count_distinct("beat_ref").alias("beats"),
        F.count_distinct("lineage_ref").alias("lineages"),
        F.count_distinct("project_key").alias("projects"),
    )
    queued = folded.rollup("agent").agg(F.grouping("agent").alias("_all"), F.count(F.lit(1)).alias("queued"))

    def keyed(df: DataFrame) -> DataFrame:
        label = F.when(F.col("_all") == 1, "total").otherwise(F.col("agent"))
        return df.withColumn("scope", label).drop("agent", "_all")

    joined = keyed(by_session)
    for part in (by_card, queued, duplicates):
        joined = joined.join(keyed(part), "scope", "left")
    zero = {c: 0 for c in ("cards", "beats", "lineages", "projects", "queued", "duplicates")}
    return joined.fillna(zero).withColumn("folded", F.col("cards") - F.col("queued"))
