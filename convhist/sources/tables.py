"""Relational extracts: reading, integrity, filtered copies, merges, schema alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.functions.ids import EXACT_JSON
from convhist.operators.graphs import cyclic_nodes
from convhist.operators.ordered import ranked


def scan_tables(spark: SparkSession, path: str, names: list[str], file_format: str = "parquet", options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Table extracts ``path/<name>`` by name; ``file_format='jdbc'`` takes the table name as dbtable."""
    reader = spark.read.format(file_format).options(**(options or {}))
    if file_format == "jdbc":
        return {name: reader.option("dbtable", name).load() for name in names}
    return {name: reader.load(f"{path}/{name}") for name in names}


def ordered_rows(rows: DataFrame, time: str, row_id: str) -> DataFrame:
    """``ordinal`` of each row in its session by (time, id), exact at any session size."""
    numbered = ranked(rows, ["session_id"], [time, row_id], "_n")
    return numbered.withColumn("ordinal", F.col("_n") - 1).drop("_n")


def referential_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(violation, subject) over project, session, message, part and any owned or event tables.

    One map-side combined aggregate per key and one anti-join per foreign key.
    """
    project, session, message, part = (tables[n] for n in ("project", "session", "message", "part"))
    say = lambda df, code, subject: df.select(F.lit(code).alias("violation"), F.col(subject).cast("string").alias("subject"))
    found = []
    for name, rows in (("project", project), ("session", session), ("message", message), ("part", part)):
        twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR id IS NULL")
        found.append(say(twice.withColumn("id", F.coalesce("id", F.lit(""))), f"{name}_id", "id"))
    owner = session.select(F.col("id").alias("session_id"))
    found.append(say(session.join(project.select(F.col("id").alias("project_id")), "project_id", "left_anti"), "session_project", "id"))
    parents = session.filter("parent_id IS NOT NULL")
    found.append(say(parents.filter("parent_id = id"), "session_parent", "id"))
    found.append(say(parents.join(session.select(F.col("id").alias("parent_id")), "parent_id", "left_anti"), "session_parent", "id"))
    found.append(say(message.join(owner, "session_id", "left_anti"), "message_session", "id"))
    known = message.select(F.col("id").alias("message_id"), "session_id")
    found.append(say(part.join(known, ["message_id", "session_id"], "left_anti"), "part_message", "id"))
    for name in ("todo", "session_input", "session_message"):
        if name in tables:
            found.append(say(tables[name].join(owner, "session_id", "left_anti"), f"{name}_session", "id"))
    if "event_sequence" in tables:
        sequence = tables["event_sequence"]
        found.append(say(sequence.join(owner.withColumnRenamed("session_id", "aggregate_id"), "aggregate_id", "left_anti"), "event_sequence_session", "aggregate_id"))
        if "event" in tables:
            found.append(say(tables["event"].join(sequence.select("aggregate_id"), "aggregate_id", "left_anti"), "event_sequence", "id"))
    proper = parents.filter("parent_id <> id").select(F.col("id").alias("session_ref"), "parent_id")
    found.append(say(cyclic_nodes(proper, "session_ref", "parent_id"), "session_parent_cycle", "session_ref"))
    result = found[0]
    for rows in found[1:]:
        result = result.unionByName(rows)
    return result.distinct()


def copy_filtered(tables: dict[str, DataFrame], selected: DataFrame) -> dict[str, DataFrame]:
    """Subset of all tables closed over foreign keys for the selected session ids (column ``id``)."""
    wanted = selected.select("id").distinct()
    session = tables["session"].join(wanted, "id", "left_semi")
    owner = session.select(F.col("id").alias("session_id"))
    message = tables["message"].join(owner, "session_id", "left_semi")
    part = tables["part"]
    by_session = part.join(owner, "session_id", "left_semi")
    by_message = part.join(message.select(F.col("id").alias("message_id")), "message_id", "left_semi").select(*by_session.columns)
    result = {
        "session": session, "message": message, "part": by_session.unionByName(by_message).dropDuplicates(["id"]),
        "project": tables["project"].join(session.select(F.col("project_id").alias("id")), "id", "left_semi"),
    }
    for name, rows in tables.items():
        if name not in result:
            key = "aggregate_id" if "aggregate_id" in rows.columns else "session_id"
            result[name] = rows.join(owner.withColumnRenamed("session_id", key), key, "left_semi")
    return result


def merge_datasets(parts: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(union by primary key, keys that carry different rows).

    Equal rows fold; min and max of the row hash differ exactly when a key has two different rows.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    others = [c for c in rows.columns if c not in key]
    row_hash = F.sha2(F.to_json(F.struct(*others), EXACT_JSON), 256)
    folded = rows.withColumn("_h", row_hash).groupBy(*key).agg(
        F.min("_h").alias("_low"), F.max("_h").alias("_high"), F.min_by(F.struct(*others), "_h").alias("_v")
    )
    same = F.col("_low") == F.col("_high")
    return folded.filter(same).select(*key, "_v.*"), folded.filter(~same).select(*key)


def align_schema(source: DataFrame, target: DataFrame, key: str, required: dict[str, Column], not_null: tuple[str, ...] = ()) -> DataFrame:
    """Source rows in the target's columns; a row already in the target wins.

    ``required``: default expression per target column. ``not_null``: target columns that must not be null (files don't
    tell, so they are named); one that neither the source nor a default fills raises. Source columns and key must exist
    in the target.
    """
    missing = [c for c in source.columns if c not in target.columns]
    if missing or key not in source.columns:
        raise ValueError(f"target lacks columns: {missing or [key]}")
    lacking = [c for c in not_null if c not in source.columns and c not in required]
    if lacking:
        raise ValueError(f"required columns have no default: {lacking}")
    there = target.select(key, F.struct(*target.columns).alias("_t"))
    joined = source.join(there, key, "left")
    columns = []
    for name in target.columns:
        own = F.col(name) if name in source.columns else required.get(name, F.lit(None))
        columns.append(F.when(F.col("_t").isNotNull(), F.col(f"_t.{name}")).otherwise(own).cast(target.schema[name].dataType).alias(name))
    return joined.select(*columns)
