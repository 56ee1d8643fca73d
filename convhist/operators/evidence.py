"""Labelled evidence: quotes, labelling hook, validation, occurrences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convhist.functions.ids import framed_digest
from convhist.functions.text import normalize_phrase, sentences, trim_space
from convhist.operators.skew import lookup_join

# Enumerations and limits of labelled evidence.
TOPICS = (
    "research_writing", "research_literature", "research_experimentation", "research_analysis", "software_development",
    "software_testing", "software_debugging", "data_analysis", "version_control", "project_workflow",
    "communication_style", "general",
)
BASES = (
    "explicit_constraint", "explicit_preference", "substantive_correction", "stated_workflow", "failure_prevention",
    "evaluation_criterion", "contextual_follow_up", "task_request",
)
LENSES = ("style", "workflow", "quality", "scope", "verification", "correction")
MAX_EVENTS, MAX_LENSES, MAX_QUOTES = 6, 3, 6
MAX_QUOTE_CHARS, TARGET_QUOTE_CHARS = 900, 450


def quote_chunks(text: Column) -> Column:
    """Sentences glued up to at least 450 and at most 900 characters, trimmed.

    Card texts are bounded by the card byte budget, so this per-row fold stays small.
    """
    pieces = sentences(text)
    short = F.flatten(
        F.transform(
            pieces,
            lambda piece: F.transform(
                F.sequence(F.lit(0), F.greatest((F.ceil(F.length(piece) / MAX_QUOTE_CHARS) - 1).cast("int"), F.lit(0))),
                lambda i: F.substring(piece, i * MAX_QUOTE_CHARS + 1, F.lit(MAX_QUOTE_CHARS)),
            ),
        )
    )

    def flushed(out: Column, current: Column) -> Column:
        return F.when(trim_space(current) == "", out).otherwise(F.array_append(out, trim_space(current)))

    def step(state: Column, piece: Column) -> Column:
        current, out = state["current"], state["out"]
        blank = trim_space(piece) == ""
        too_long = (current != "") & (F.length(current) + F.length(piece) > MAX_QUOTE_CHARS)
        grown = F.when(too_long, piece).otherwise(F.concat(current, piece))
        kept = F.when(too_long, flushed(out, current)).otherwise(out)
        full = F.length(grown) >= TARGET_QUOTE_CHARS
        return F.when(
            blank, F.struct(F.when(current == "", "").otherwise(F.concat(current, piece)).alias("current"), out.alias("out"))
        ).otherwise(
            F.struct(F.when(full, "").otherwise(grown).alias("current"), F.when(full, flushed(kept, grown)).otherwise(kept).alias("out"))
        )

    start = F.struct(F.lit("").alias("current"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(short, start, step, lambda state: flushed(state["out"], state["current"]))


def quote_candidates(cards: DataFrame, user_text: str = "user_text", next_text: str = "next_user_text") -> DataFrame:
    """(card_ref, quote_id, source, text): quotes numbered over user text, then next-user text."""
    tagged = lambda column, source: F.transform(
        quote_chunks(F.coalesce(F.col(column), F.lit(""))), lambda q: F.struct(F.lit(source).alias("source"), q.alias("text"))
    )
    both = F.concat(tagged(user_text, "user_text"), tagged(next_text, "next_user"))
    rows = cards.select("card_ref", F.posexplode(both).alias("_i", "_q"))
    return rows.select("card_ref", F.concat(F.lit("u"), "_i").alias("quote_id"), "_q.source", "_q.text")


RESPONSE_SCHEMA = T.StructType([T.StructField("card_ref", T.StringType()), T.StructField("response", T.StringType())])


def label_cards(batches: DataFrame, label: Callable[[pd.DataFrame], pd.DataFrame], batch: str = "batch_no") -> DataFrame:
    """Apply a user-supplied labeller to each request batch: (card_ref, response JSON).

    A batch has at most eight cards, so grouping by it is bounded; Spark spreads the batches.
    """
    columns = ["card_ref", "response"]
    return batches.groupBy(batch).applyInPandas(lambda frame: label(frame)[columns], RESPONSE_SCHEMA)


def label_partitions(cards: DataFrame, label: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Labeller without batch requirement: Arrow batches of each partition, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield label(frame)[["card_ref", "response"]]

    return cards.mapInPandas(run, RESPONSE_SCHEMA)


_RESPONSE = "struct<task_anchor:string,episode_summary:string,events:array<string>>"
_EVENT = (
    "struct<topic:string,basis:string,lenses:array<string>,observation:string,"
    "behavior_signature:struct<situation:string,behavior:string,target:string>,user_quote_ids:array<string>>"
)
_CARD_KEYS = ("episode_summary", "events", "task_anchor")
_EVENT_KEYS = ("basis", "behavior_signature", "lenses", "observation", "topic", "user_quote_ids")


def _text_issue(value: Column, limit: int) -> Column:
    trimmed = trim_space(value)
    return value.isNull() | (trimmed == "") | (F.length(value) > limit)


def _keys_differ(json: Column, keys: tuple[str, ...]) -> Column:
    found = F.array_sort(F.json_object_keys(json))
    return ~found.eqNullSafe(F.array(*[F.lit(k) for k in keys]))


def _codes(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items()]))


def validate_evidence(requested: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Check labelled output; returns (issues per requested card, valid event rows, discarded refs).

    ``requested``: card_ref, quote_ids ARRAY. ``responses``: card_ref, response (JSON text). A card
    passes only if it was answered once and neither it nor any of its events has an issue.
    """
    discarded = responses.join(requested, "card_ref", "left_anti").select("card_ref").distinct()
    # Of several answers none is taken on trust: the card gets an issue, whatever the others say.
    answers = responses.groupBy("card_ref").agg(F.min("response").alias("response"), F.count(F.lit(1)).alias("_answers"))
    parsed = lookup_join(requested, answers, ["card_ref"], "left").withColumn("_r", F.from_json("response", _RESPONSE))
    count = F.coalesce(F.size("_r.events"), F.lit(0))
    card_codes = F.when(F.col("response").isNull(), F.array(F.lit("missing"))).otherwise(
        _codes({
            "card.repeated": F.col("_answers") > 1,
            "card.keys": _keys_differ(F.col("response"), _CARD_KEYS),
            "task_anchor": _text_issue(F.col("_r.task_anchor"), 200),
            "episode_summary": _text_issue(F.col("_r.episode_summary"), 500),
            "events.count": (count < 1) | (count > MAX_EVENTS),
        })
    )
    parsed = parsed.withColumn("_codes", card_codes)
    events = parsed.select(
        "card_ref", "quote_ids", F.col("_r.task_anchor").alias("task_anchor"), F.col("_r.episode_summary").alias("episode_summary"),
        F.posexplode("_r.events").alias("event_index", "_json"),
    ).withColumn("_e", F.from_json("_json", _EVENT))
    e = F.col("_e")
    signature = e["behavior_signature"]
    quotes, lenses = e["user_quote_ids"], e["lenses"]
    event_codes = _codes({
        "event.keys": _keys_differ(F.col("_json"), _EVENT_KEYS),
        "event.topic": ~e["topic"].isin(*TOPICS),
        "event.basis": ~e["basis"].isin(*BASES),
        "event.lenses": (F.size(lenses) < 1) | (F.size(lenses) > MAX_LENSES) | (F.size(F.array_distinct(lenses)) != F.size(lenses))
        | (F.size(F.array_except(lenses, F.array(*[F.lit(x) for x in LENSES]))) > 0),
        "event.observation": _text_issue(e["observation"], 500),
        "event.signature": _text_issue(signature["situation"], 300) | _text_issue(signature["behavior"], 300) | _text_issue(signature["target"], 300),
        "event.quotes": (F.size(quotes) < 1) | (F.size(quotes) > MAX_QUOTES) | (F.size(F.array_distinct(quotes)) != F.size(quotes))
        | (F.size(F.array_except(quotes, F.col("quote_ids"))) > 0),
    })
    events = events.withColumn("_codes", event_codes)
    found = events.select("card_ref", F.explode("_codes").alias("code")).unionByName(
        parsed.select("card_ref", F.explode("_codes").alias("code"))
    )
    # The set of issue codes is fixed, so a card's list is bounded.
    issues = found.groupBy("card_ref").agg(F.array_sort(F.collect_set("code")).alias("issues"))
    report = requested.select("card_ref").join(issues, "card_ref", "left").withColumn(
        "issues", F.coalesce("issues", F.array().cast("array<string>"))
    )
    clean = report.filter(F.size("issues") == 0).select("card_ref")
    valid = events.join(clean, "card_ref", "left_semi").select(
        "card_ref", "task_anchor", "episode_summary", F.col("event_index").cast("bigint").alias("event_index"), e["topic"].alias("topic"),
        e["basis"].alias("basis"), lenses.alias("lenses"), e["observation"].alias("observation"), signature.alias("behavior"), quotes.alias("quote_ids"),
    )
    return report, valid, discarded


def verify_quotes(quotes: DataFrame, cards: DataFrame) -> DataFrame:
    """Every stored quote must be an exact substring of its source text. Adds ``exact``."""
    texts = cards.select("card_ref", F.col("user_text").alias("_user"), F.col("next_user_text").alias("_next"))
    joined = quotes.join(texts, "card_ref", "left")
    source = F.when(F.col("source") == "user_text", F.col("_user")).otherwise(F.col("_next"))
    return joined.withColumn("exact", F.coalesce(F.contains(source, F.col("text")), F.lit(False))).drop("_user", "_next")


def explode_evidence(cards: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrence rows, cards and results without their counterpart).

    ``cards``: card_ref, lineage_ref, turn_start, user_ts, next_ordinal, next_ts. ``events``: card_ref,
    task_anchor, event_index, topic, basis, lenses, observation, quotes ARRAY<STRUCT<source, text>>.
    An episode is one turn of a lineage; a mention is the user message a quote comes from.
    """
    answered = events.select("card_ref").distinct()
    odd = cards.join(answered, "card_ref", "left_anti").select("card_ref", F.lit("without_result").alias("status")).unionByName(
        answered.join(cards, "card_ref", "left_anti").select("card_ref", F.lit("without_card").alias("status"))
    )
    rows = events.join(cards, "card_ref")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    event = F.to_json(F.struct("topic", "basis", "lenses", "observation", "quotes"))
    mention = lambda q: F.concat(
        F.lit("mention1_"),
        framed_digest(
            F.col("lineage_ref"), F.when(q["source"] == "user_text", F.col("turn_start")).otherwise(F.col("next_ordinal")),
            F.when(q["source"] == "user_text", stamp("user_ts")).otherwise(stamp("next_ts")),
        ),
    )
    rows = rows.withColumn("_anchor", normalize_phrase(F.col("task_anchor")))
    return rows.select(
        "card_ref", "event_index", "topic", "basis", "lenses", "observation", "lineage_ref",
        F.concat(F.lit("occurrence1_"), framed_digest(F.col("card_ref"), F.col("_anchor"), F.col("event_index"), event)).alias("occurrence_ref"),
        F.concat(F.lit("episode1_"), framed_digest(F.col("lineage_ref"), F.col("turn_start"), stamp("user_ts"))).alias("episode_ref"),
        F.array_distinct(F.transform("quotes", mention)).alias("mention_refs"),
    ), odd
