"""Grouping of evidence and review aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.ids import framed_digest
from convhist.functions.text import trim_space
from convhist.operators.evidence import LENSES, TOPICS
from convhist.operators.ordered import ranked
from convhist.operators.skew import lookup_join
from convhist.session import materialize

# Scopes by topic, relations, group limits.
SCOPE_TOPICS = {
    "writing": ("research_writing", "communication_style"),
    "research": ("research_literature", "research_experimentation", "research_analysis", "data_analysis"),
    "engineering": ("software_development", "software_testing", "software_debugging", "version_control"),
}
RELATIONS = ("shared_principle", "correction_pattern", "workflow_pattern")
MAX_GROUPS, MIN_MEMBERS, MAX_MEMBERS = 8, 2, 12


def topic_scope(topic: Column) -> Column:
    """writing, research, engineering, else workflow -- a literal mapping, so no join at all."""
    scope = F.when(F.lit(False), "")
    for name, topics in SCOPE_TOPICS.items():
        scope = scope.when(topic.isin(*topics), name)
    return scope.otherwise("workflow")


def plan_groups(occurrences: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(occurrences of comparable scopes with request_ref, occurrences with insufficient evidence).

    A scope is comparable iff it has two distinct episodes and two distinct mentions. "At least two
    distinct values" holds iff minimum and maximum differ, so both tests are map-side combined.
    """
    # Written once: the facts, the join and both results read these rows.
    rows = materialize(occurrences.withColumn("scope", topic_scope(F.col("topic"))))
    low, high = F.array_min("mention_refs"), F.array_max("mention_refs")
    facts = rows.groupBy(*keys, "scope").agg(
        (F.min("episode_ref") != F.max("episode_ref")).alias("_episodes"), (F.min(low) != F.max(high)).alias("_mentions")
    )
    facts = facts.select(*keys, "scope", F.coalesce(F.col("_episodes") & F.col("_mentions"), F.lit(False)).alias("_ok"))
    marked = lookup_join(rows, facts, [*keys, "scope"], "inner", ["occurrence_ref"])
    request = F.concat(F.lit("request1_"), framed_digest(*[F.col(k) for k in keys], F.col("scope")))
    comparable = marked.filter("_ok").drop("_ok").withColumn("request_ref", request)
    return comparable, marked.filter("NOT _ok").drop("_ok").withColumn("reason", F.lit("insufficient_evidence"))


def alias_ids(evidence: DataFrame) -> DataFrame:
    """Dense aliases a0.., e0.., l0.. by sorted reference inside each request.

    Ranks come from range partitions, so a request with most of the evidence is still spread.
    """
    rows = ranked(evidence.select("request_ref", "occurrence_ref", "episode_ref", "lineage_ref"), ["request_ref"], ["occurrence_ref"], "_a")
    rows = rows.withColumn("alias", F.concat(F.lit("a"), F.col("_a") - 1)).drop("_a")
    for column, letter in (("episode_ref", "e"), ("lineage_ref", "l")):
        order = ranked(rows.select("request_ref", column).distinct(), ["request_ref"], [column], "_n")
        names = order.select("request_ref", column, F.concat(F.lit(letter), F.col("_n") - 1).alias(column.replace("_ref", "_alias")))
        rows = lookup_join(rows, names, ["request_ref", column], "inner", ["occurrence_ref"])
    return materialize(rows)


def _bad_text(value: Column, limit: int) -> Column:
    return value.isNull() | (trim_space(value) == "") | (F.length(value) > limit)


def validate_groups(groups: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues per request, valid member rows, leftovers).

    ``groups``: request_ref, group_no, lens, hypothesis, topic, relation, event_ids ARRAY (aliases).
    ``aliases``: request_ref, alias, occurrence_ref. Equal groups fold into one; occurrences of a
    valid request that no group names are ``not_grouped``.
    """
    ids = F.col("event_ids")
    checks = {
        "lens": ~F.col("lens").isin(*LENSES), "topic": ~F.col("topic").isin(*TOPICS), "relation": ~F.col("relation").isin(*RELATIONS),
        "hypothesis": _bad_text(F.col("hypothesis"), 500), "members": (F.size(ids) < MIN_MEMBERS) | (F.size(ids) > MAX_MEMBERS),
        "duplicate_members": F.size(F.array_distinct(ids)) != F.size(ids),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in checks.items()]))
    members = groups.select("*", F.posexplode("event_ids").alias("_p", "alias"))
    members = members.join(aliases.select("request_ref", "alias", "occurrence_ref"), ["request_ref", "alias"], "left")
    members = materialize(members)
    found = groups.select("request_ref", F.explode(codes).alias("code"))
    found = found.unionByName(members.filter("occurrence_ref IS NULL").select("request_ref", F.lit("unknown_member").alias("code")))
    many = groups.groupBy("request_ref").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MAX_GROUPS)
    found = found.unionByName(many.select("request_ref", F.lit("too_many_groups").alias("code")))
    issues = materialize(found.groupBy("request_ref").agg(F.array_sort(F.collect_set("code")).alias("issues")))
    good = members.join(issues.select("request_ref"), "request_ref", "left_anti")
    # A valid group has at most twelve members, so its list is bounded.
    folded = good.groupBy("request_ref", "group_no", "lens", "hypothesis", "topic", "relation").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "occurrence_ref"))), lambda m: m["occurrence_ref"]).alias("members")
    )
    reference = F.concat(F.lit("group1_"), framed_digest(
        F.col("request_ref"), F.col("lens"), F.col("hypothesis"), F.col("topic"), F.col("relation"), F.array_join("members", ",")))
    unique = folded.withColumn("group_ref", reference).groupBy("group_ref").agg(
        *[F.first(c).alias(c) for c in ("request_ref", "lens", "hypothesis", "topic", "relation", "members")]
    )
    rows = materialize(unique.select("*", F.explode("members").alias("occurrence_ref")).drop("members"))
    answered = aliases.join(issues.select("request_ref"), "request_ref", "left_anti")
    left = answered.join(rows.select("request_ref", "occurrence_ref"), ["request_ref", "occurrence_ref"], "left_anti")
    return issues, rows, left.select("request_ref", "occurrence_ref", F.lit("not_grouped").alias("reason"))


def audit_complete(evidence: DataFrame, members: DataFrame, unrouted: DataFrame) -> DataFrame:
    """Per request: complete iff each occurrence is either grouped or unrouted exactly once, and
    nothing foreign is listed. Full outer join of the three row sets by occurrence."""
    key = ["request_ref", "occurrence_ref"]
    tag = lambda df, column: df.groupBy(*key).agg(F.count(F.lit(1)).alias(column))
    joined = tag(evidence, "_e").join(tag(members, "_m"), key, "full").join(tag(unrouted, "_u"), key, "full").fillna(0, ["_e", "_m", "_u"])
    grouped, listed = F.col("_m") > 0, F.col("_u")
    fine = (F.col("_e") == 1) & ((grouped & (listed == 0)) | (~grouped & (listed == 1)))
    return joined.groupBy("request_ref").agg(
        F.bool_and(fine).alias("complete"), F.count_if(F.col("_e") == 0).alias("foreign"),
        F.count_if((F.col("_e") > 0) & ~grouped & (listed == 0)).alias("unlisted"), F.count_if(grouped & (listed > 0)).alias("both"),
    )


def group_metrics(members: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences, messages, episodes, sessions, lineages and projects per group."""
    head = ["group_ref", "topic", "lens", "relation"]
    facts = occurrences.select("occurrence_ref", "episode_ref", "mention_refs", "session_ref", "lineage_ref", "project_key", "user_ts")
    rows = members.select(*head, "occurrence_ref").join(facts, "occurrence_ref")
    messages = rows.select("group_ref", F.explode("mention_refs").alias("m")).groupBy("group_ref").agg(F.count_distinct("m").alias("messages"))
    counts = rows.groupBy(*head).agg(
        F.count_distinct("occurrence_ref").alias("occurrences"),
        *[F.count_distinct(c).alias(name) for c, name in (
            ("episode_ref", "episodes"), ("session_ref", "sessions"), ("lineage_ref", "lineages"), ("project_key", "projects"))],
        F.min("user_ts").alias("earliest"), F.max("user_ts").alias("latest"),
    )
    return counts.join(messages, "group_ref")


def routing_totals(occurrences: DataFrame, members: DataFrame, unrouted: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per corpus: occurrences, grouped (distinct), unrouted, groups, requests by status."""
    n = F.count(F.lit(1))
    total = occurrences.groupBy(*keys).agg(n.alias("occurrences"))
    grouped = members.groupBy(*keys).agg(F.count_distinct("occurrence_ref").alias("grouped"), F.count_distinct("group_ref").alias("groups"))
    rest = unrouted.groupBy(*keys).agg(n.alias("unrouted"))
    by_status = requests.groupBy(*keys).agg(
        F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status").startswith("pending")).alias("pending"),
    )
    joined = total
    for part in (grouped, rest, by_status):
        joined = joined.join(part, keys, "left")
    return joined.fillna(0)
