"""Chunked scans, ranks, runs and skew joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from convhist.operators import ordered as O
from convhist.operators.skew import lookup_join


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for key in ("hot", "a", "b"):
        ordinals = rng.sample(range(200), 90 if key == "hot" else 12)
        rows += [(key, o, rng.choice([None, 1, 2, 3, -4]), rng.choice("xyz")) for o in sorted(ordinals)]
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 7, 1000])
def test_scan_equals_python_fold(spark, chunk_rows):
    rows = _rows(chunk_rows)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint, c string").repartition(5)
    v = F.col("v")
    got = O.scan(df, ["k"], "o", {
        "s": O.running_sum(v), "before": O.running_sum(v, strict=True), "mx": O.running_max(v, strict=True), "last": O.last_value(v, strict=True),
        "nxt": O.next_value(v), "low": O.remaining_min(v), "prev": O.previous_row(v), "n": O.position(), "tot": O.total_sum(v),
    }, chunk_rows).collect()
    assert len(got) == len(rows)
    for row in got:
        group = [r for r in rows if r[0] == row.k]
        i = [r[1] for r in group].index(row.o)
        values = [r[2] for r in group]
        known = lambda part: [x for x in part if x is not None]
        assert row.s == sum(known(values[: i + 1]))
        assert row.before == sum(known(values[:i]))
        assert row.mx == max(known(values[:i]), default=None)
        assert row["last"] == (known(values[:i]) or [None])[-1]
        assert row.nxt == (known(values[i + 1:]) or [None])[0]
        assert row.low == min(known(values[i + 1:]), default=None)
        assert (row.prev.v if row.prev else "none") == (values[i - 1] if i else "none")
        assert row.n == i + 1 and row.tot == sum(known(values))


@pytest.mark.parametrize("chunk_rows", [1, 5, 1000])
def test_runs_equal_python(spark, chunk_rows):
    rows = _rows(99)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint, c string")
    got = {(r.k, r.o): r.run for r in O.runs(df, ["k"], "o", ["c"], "run", chunk_rows).collect()}
    for key in ("hot", "a", "b"):
        run, previous = 0, None
        for _, o, _, c in [r for r in rows if r[0] == key]:
            run += c != previous
            previous = c
            assert got[(key, o)] == run


@pytest.mark.parametrize(("fan", "sparse"), [(2, 0), (3, 0), (7, 10**9)])
def test_prefix_tree_of_several_levels(spark, monkeypatch, fan, sparse):
    """Sparse and negative ordinals, a hot key; sparse=0 keeps the tree, a large one cuts by rows."""
    monkeypatch.setattr(O, "FAN", fan)
    monkeypatch.setattr(O, "SPARSE_ROWS", sparse)
    rng = random.Random(fan)
    rows = [(key, o, rng.choice([None, 1, 2, -4]), rng.choice("xy")) for key, n in (("hot", 150), ("a", 3)) for o in sorted(rng.sample(range(-400, 3000), n))]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint, c string").repartition(4)
    v = F.col("v")
    scanned = O.scan(df, ["k"], "o", {
        "s": O.running_sum(v), "mx": O.running_max(v, strict=True), "last": O.last_value(v, strict=True), "nxt": O.next_value(v),
        "low": O.remaining_min(v), "prev": O.previous_row(v), "tot": O.total_sum(v), "top": O.total_max(v), "n": O.position(),
    }, 2)
    got = {(r.k, r.o): r for r in O.runs(scanned, ["k"], "o", ["c"], "run", 2).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "a"):
        group = [r for r in rows if r[0] == key]
        values, run = [r[2] for r in group], 0
        known = lambda part: [x for x in part if x is not None]
        for i, (_, o, _, c) in enumerate(group):
            run += i == 0 or c != group[i - 1][3]
            row = got[key, o]
            assert (row.s, row.n, row.run) == (sum(known(values[: i + 1])), i + 1, run)
            assert row.mx == max(known(values[:i]), default=None) and row.low == min(known(values[i + 1 :]), default=None)
            assert row["last"] == (known(values[:i]) or [None])[-1] and row.nxt == (known(values[i + 1 :]) or [None])[0]
            assert (row.prev.v if row.prev else "none") == (values[i - 1] if i else "none")
            assert row.tot == sum(known(values)) and row.top == max(known(values))


def test_scans_of_empty_tables(spark):
    df = spark.createDataFrame([], "k string, o bigint, c string")
    assert O.scan(df, ["k"], "o", {"n": O.position()}).collect() == []
    assert O.runs(df, ["k"], "o", ["c"], "run").collect() == []
    assert O.ranked(df, ["k"], ["c", "o"], "rank", "size").collect() == []


def test_ranked_any_order(spark):
    rows = [("g", random.Random(i).random(), i) for i in range(300)] + [("h", 0.5, 1)]
    got = O.ranked(spark.createDataFrame(rows, "k string, x double, i bigint"), ["k"], ["x", "i"], "rank", "size").collect()
    expected = {r: n for n, r in enumerate(sorted(r for r in rows if r[0] == "g"), 1)}
    assert all(r["rank"] == (expected[(r.k, r.x, r.i)] if r.k == "g" else 1) and r.size == (300 if r.k == "g" else 1) for r in got)


def test_lookup_join_splits_hot_keys(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(120)], "k string, i bigint")
    small = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(0, 60)], "k string, v string")
    for how in ("left", "inner"):
        got = sorted(lookup_join(big, small, ["k"], how, ["i"]).select("k", "i", "v").collect())
        assert got == sorted(big.join(small, "k", how).select("k", "i", "v").collect())
