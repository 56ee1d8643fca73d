"""Review and audit texts as ordered rows, written as one text document per review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.text import quote_lines


def _optional(label: str, value: Column) -> Column:
    shown = F.concat(F.lit(f"\n{label}:\n"), quote_lines(value), F.lit("\n"))
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(shown)


def candidate_text(number: Column) -> Column:
    """Heading and coverage of one candidate group."""
    return F.format_string(
        "## Candidate %d: %s\n\n- Candidate: %s\n- Topic: %s; lens: %s; relation: %s\n"
        "- Coverage: %d occurrences, %d messages, %d sessions, %d lineages, %d projects\n",
        number, F.col("draft"), F.col("group_ref"), F.col("topic"), F.col("lens"), F.col("relation"), F.col("occurrences"),
        F.col("messages"), F.col("sessions"), F.col("lineages"), F.col("projects"),
    )


def evidence_text(number: Column) -> Column:
    """One evidence entry: source, observation, quoted user text, context."""
    return F.concat(
        F.format_string(
            "#### Evidence %d\n\n- Occurrence: %s\n- Source: %s / turn %d / %s\n- Observation: %s\n\nUser text:\n",
            number, F.col("occurrence_ref"), F.col("session_ref"), F.col("turn_start"), F.col("stamp"), F.col("observation"),
        ),
        quote_lines(F.col("user_text")), F.lit("\n"), _optional("Previous user context", F.col("previous_user")),
        _optional("Next user context", F.col("next_user")),
    )


def audit_text(number: Column) -> Column:
    return F.concat(
        F.format_string("## Audit entry %d\n\n- Occurrence: %s; reason: %s\n- Source: %s\n\nUser text:\n", number, F.col("occurrence_ref"), F.col("reason"), F.col("session_ref")),
        quote_lines(F.col("user_text")), F.lit("\n"),
    )


def write_review(rows: DataFrame, path: str) -> None:
    """Write ``text`` of (review_ref, place) ordered rows below ``path/review_ref=...``.

    Range partitioning keeps the parts of a large review in order across files and tasks; a review
    never has to fit into one of them.
    """
    ordered = rows.repartitionByRange("review_ref", "place").sortWithinPartitions("review_ref", "place")
    ordered.select("text", "review_ref").write.mode("errorifexists").partitionBy("review_ref").text(path)
