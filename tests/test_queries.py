"""Registered queries against their check SQL in DuckDB, with small chunks so that chunks do split.

By default one query of each family runs; set CONVHIST_ALL_QUERIES=1 for all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from convhist.operators import ordered
from convhist.plans import catalogue
from tools.check import canonical

FAMILIES = [
    "beats", "logical_digest", "list_sessions", "sessions_in_tree", "search_first_hits", "mutate_library", "fingerprint_sources", "diff_snapshots",
    "rebuild_changed", "forward_compaction", "apply_retractions", "coalesce_runs", "gap_runs", "pending_evidence", "pair_tools", "tool_budget",
    "tools_closed", "work_graph_valid", "closure", "topo_order", "relation_keys", "quote_candidates", "validate_evidence", "explode_evidence",
    "cache_upsert", "workspace_plan", "classify_import", "portable_findings", "derived_ids", "project_rows", "classify_paths", "merge_datasets",
    "canonical_digest", "path_identity", "stream_dedupe", "stream_activity", "closure_chains", "topo_chains", "inherit_history",
    "logical_digest_evidence", "discovery_queue",
]
NAMES = list(catalogue.QUERIES) if os.environ.get("CONVHIST_ALL_QUERIES") else FAMILIES


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 5)
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    left = sorted(tuple(canonical(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    relation = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    index = [names.index(c) for c in columns]
    assert left == sorted(tuple(canonical(row[i]) for i in index) for row in relation.fetchall())


def test_every_query_has_a_check():
    assert set(catalogue.QUERIES) == set(catalogue.CHECK_SQL)
