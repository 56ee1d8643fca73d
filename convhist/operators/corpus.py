"""From conversations to planned requests: tools of turns, lineages, cards, folding, order and budget in one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.functions.ids import framed_digest, multiset_digest
from convhist.operators import beats as B
from convhist.operators import budget as J
from convhist.operators import graphs as H
from convhist.operators import tools as G
from convhist.operators.ordered import last_value, scan
from convhist.session import materialize

TURN = ["session_ref", "turn_start"]


def message_tools(events: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Closed calls of each session with cut values; ``events``: session_ref, ordinal, phase, call_id and the tool fields."""
    return G.pair_tools(G.tool_summary(events), ["session_ref"], chunk_rows)


def tool_digests(paired: DataFrame) -> DataFrame:
    """(session_ref, ordinal, tools_digest) for :func:`beats.logical_digest`: what the tools of a message say."""
    one = framed_digest(*[F.col(c) for c in ("name", "namespace", "status", "input", "output", "error")])
    return paired.groupBy("session_ref", "ordinal").agg(multiset_digest("tools1_", one).alias("tools_digest"))


def turn_tools(paired: DataFrame, beat_rows: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """(session_ref, turn_start, tools, omitted_tools): tools within each turn, within the byte budget.

    The turn of a tool is the last one that starts at or before it, found by a scan; a turn's own place sorts before
    tools of the same ordinal.
    """
    span = F.struct("turn_start", "turn_end")
    starts = beat_rows.select("session_ref", (F.col("turn_start") * 2).alias("_o"), span.alias("_span"))
    placed = paired.withColumn("_o", F.col("ordinal") * 2 + 1).withColumn("_is_tool", F.lit(True))
    rows = scan(placed.unionByName(starts, allowMissingColumns=True), ["session_ref"], "_o", {"_in": last_value(F.col("_span"))}, chunk_rows)
    inside = rows.filter("_is_tool AND ordinal <= _in.turn_end").withColumn("turn_start", F.col("_in.turn_start")).drop("_o", "_span", "_in", "_is_tool")
    return G.beat_tools(G.tool_budget(inside, TURN, chunk_rows=chunk_rows), TURN)


def discovery_queue(items: DataFrame, sessions: DataFrame, keys: DataFrame, events: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Cards of all conversations, each content once per lineage, in round-robin order over projects and lineages.

    ``items`` may bring ``blocks``; ``sessions``: session_ref, agent, context, source_revision; ``keys``: see
    :func:`graphs.relation_keys`; ``events``: see :func:`message_tools`. Conversations with the same logical digest, tools
    and evidence included, or with a common key are one lineage.
    """
    paired = materialize(message_tools(events, chunk_rows))
    # Stored once: digests, beats and evidence read the visible texts, each in several passes.
    spoken = materialize(B.spoken_items(items))
    digests = B.logical_digest(spoken, tool_digests(paired), chunk_rows, known=True)
    lineages = materialize(H.lineages(materialize(digests), keys))
    beat_rows = materialize(B.beats(spoken, chunk_rows, known=True))
    cards = B.cards(beat_rows, B.assistant_evidence(spoken, chunk_rows, known=True), sessions, lineages, turn_tools(paired, beat_rows, chunk_rows))
    return J.stratified_order(materialize(B.fold_duplicates(materialize(cards))))


def discovery_plan(queue: DataFrame, total_tokens: int, request_tokens: int = J.DEFAULT_REQUEST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(picked cards with their request, summary) of a queue; see :func:`budget.plan_budget`."""
    return J.plan_budget(queue, total_tokens, request_tokens=request_tokens)
