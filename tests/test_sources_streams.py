"""Sources, sinks and streams on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from convhist.operators.tools import pair_tools
from convhist.sources import jsonl, review, snapshots
from convhist.streaming import calls, streams


def test_jsonl_order_across_splits_and_policies(spark, tmp_path):
    file = tmp_path / "log.jsonl"
    lines = [json.dumps({"i": i, "pad": "x" * 200}) for i in range(600)]
    lines[10], lines[20], lines[30] = "", "{oops", "[1]"
    file.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = jsonl.scan_jsonl(spark, str(file), policy="note", blank="note").orderBy("record_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in rows] == lines and [r.record_no for r in rows] == list(range(1, 601))
    assert {r.record_no: r.issue for r in rows if r.issue} == {11: "blank", 21: "bad_json", 31: "bad_json"}
    with pytest.raises(Exception, match="invalid record"):
        jsonl.scan_jsonl(spark, str(file), policy="fail").collect()


def test_snapshot_heads_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("event_log:1", "event_log", 1), ("record_tree:1", "record_tree", 2)], "session_ref string, agent string, v int")
    root = str(tmp_path / "lib")
    snapshots.write_snapshot(rows, root, "one", "2026-01-01 00:00:00")
    snapshots.write_snapshot(rows.filter("agent = 'event_log'").withColumn("v", F.lit(9)), root, "two", "2026-01-02 00:00:00")
    assert sorted((r.session_ref, r.v) for r in snapshots.read_current(spark, root).collect()) == [("event_log:1", 9), ("record_tree:1", 2)]
    nothing = rows.select("agent", F.lit("").alias("snapshot_id")).limit(0)
    assert [(r.agent, r.snapshot_id) for r in snapshots.prunable_snapshots(spark, root, nothing).collect()] == [("event_log", "one")]


def test_review_documents_keep_their_order(spark, tmp_path):
    rows = spark.createDataFrame([("r1", i, f"line {i}") for i in range(50)] + [("r2", 0, "only")], "review_ref string, place bigint, text string")
    path = tmp_path / "reviews"
    review.write_review(rows, str(path))
    parts = sorted((path / "review_ref=r1").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"line {i}" for i in range(50)]


def _write_batches(spark, folder, batches):
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "session_ref string, ordinal bigint, phase string, call_id string, ts timestamp")
        for c in ("name", "namespace", "status", "input", "output", "error"):
            df = df.withColumn(c, F.lit(""))
        df.coalesce(1).write.mode("append").json(str(folder))
        del n


def test_pairing_across_micro_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    t = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    batches = [
        [("s", 1, "call", "a", t(0)), ("s", 2, "call", "b", t(0)), ("s", 3, "call", "old", t(0)), ("s", 4, "result", "none", t(0))],
        [("s", 5, "result", "a", t(1)), ("s", 6, "exchange", "x", t(1)), ("s", 7, "call", "a", t(2))],
        [("s", 8, "result", "b", t(30)), ("s", 9, "result", "a", t(30)), ("s", 10, "call", "late", t(30))],
    ]
    source, root = tmp_path / "in", str(tmp_path / "out")
    schema = None
    for index, rows in enumerate(batches):
        _write_batches(spark, source, [rows])
        schema = schema or ", ".join(f"{c} {'bigint' if c == 'ordinal' else 'timestamp' if c == 'ts' else 'string'}" for c in streams.CALL_COLUMNS)
        stream = streams.read_records(spark, str(source), schema, "json", "*.json")
        streams.pair_tools_stream(stream, root, str(tmp_path / "cp"), "INTERVAL 10 DAYS").awaitTermination()
        assert (tmp_path / "out" / "open" / f"batch={index}").exists()
    paired = sorted(r.ordinal for r in spark.read.parquet(f"{root}/paired").collect())
    flat = [r for rows in batches for r in rows]
    df = spark.createDataFrame(flat, "session_ref string, ordinal bigint, phase string, call_id string, ts timestamp")
    for c in ("name", "namespace", "status", "input", "output", "error"):
        df = df.withColumn(c, F.lit(""))
    assert paired == sorted(r.ordinal for r in pair_tools(df, ["session_ref"]).collect()) == [5, 6, 8, 9]
    assert sorted(r.call_id for r in spark.read.parquet(f"{root}/open/batch=2").collect()) == ["late", "old"]


def test_dedupe_across_batches(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "session_ref string, record_id bigint, ts timestamp"
    for _ in range(2):
        spark.createDataFrame([("s", 1, "2026-01-01 00:00:00"), ("s", 2, "2026-01-01 00:01:00")], "session_ref string, record_id bigint, ts string").write.mode("append").json(str(source))
        stream = streams.read_records(spark, str(source), schema, "json", "*.json")
        streams.append_records(streams.dedupe_records(stream, ["session_ref", "record_id"]), out, cp).awaitTermination()
    assert sorted(r.record_id for r in spark.read.parquet(out).collect()) == [1, 2]


CALL_SCHEMA = "session_ref string, ordinal bigint, phase string, call_id string, name string, namespace string, status string, input string, output string, error string, ts timestamp"


def _deliver(spark, tmp_path, rows, **options):
    """One micro-batch of (session, ordinal, phase, call, ts), by a query that starts anew from its checkpoint."""
    made = [(s, o, p, c, f"n{o}" if p == "call" else "", "", "", "", "", "", t) for s, o, p, c, t in rows]
    spark.createDataFrame(made, CALL_SCHEMA.replace("ts timestamp", "ts string")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = calls.pair_calls(streams.read_records(spark, str(tmp_path / "in"), CALL_SCHEMA, "json", "*.json"), **options)
    with calls.state_store(spark):
        streams.append_records(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


def test_calls_late_rows_timers_and_restarts(spark, tmp_path):
    day = "2026-01-0"
    _deliver(spark, tmp_path, [("s", 1, "call", "a", f"{day}1 00:00:00"), ("s", 2, "result", "a", f"{day}1 00:10:00"), ("s", 3, "call", "b", f"{day}1 00:20:00")])
    _deliver(spark, tmp_path, [("s", 5, "result", "b", f"{day}1 03:00:00"), ("s", 6, "call", "old", f"{day}1 03:00:00")])
    # A call that comes late, but within the delay, replaces the open one before the result of the batch before closes it;
    # one behind the watermark is left out.
    _deliver(spark, tmp_path, [("s", 4, "call", "b", f"{day}1 02:30:00"), ("s", 9, "call", "gone", f"{day}1 00:30:00"), ("s", 7, "exchange", "x", f"{day}3 03:00:00"), ("s", 8, "call", "z", f"{day}3 03:00:00")])
    rows = {r.ordinal: (r.call_id, r.name, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {2: ("a", "n1", "paired"), 5: ("b", "n4", "paired"), 6: ("old", "n6", "unanswered"), 7: ("x", "unknown", "paired")}
    assert [(r.ordinal, r.held) for r in calls.unfinished(spark, str(tmp_path / "cp")).collect()] == [(8, "waiting")]


def test_calls_in_any_order_equal_the_batch_pairing(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    events = [("s", i, rng.choice(["call", "result", "exchange"]), f"c{rng.randrange(3)}", str(datetime(2026, 1, 1) + timedelta(minutes=i))) for i in range(90)]
    for part in range(3):
        some = events[part * 30 : part * 30 + 30]
        rng.shuffle(some)
        _deliver(spark, tmp_path, some, timeout=timedelta(days=365))
    _deliver(spark, tmp_path, [("s", 1000, "exchange", "end", "2026-02-01 00:00:00")], timeout=timedelta(days=365))
    got = sorted((r.ordinal, r.call_id, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.ordinal < 1000)
    df = spark.createDataFrame([(s, o, p, c, f"n{o}" if p == "call" else "", "", "", "", "", "") for s, o, p, c, _ in events], CALL_SCHEMA.replace(", ts timestamp", ""))
    assert got == sorted((r.ordinal, r.call_id, r.name) for r in pair_tools(df, ["session_ref"]).collect())


def test_calls_take_few_round_trips_to_the_store():
    from collections import Counter
    from datetime import datetime, timedelta, timezone
    from types import SimpleNamespace

    from pyspark.sql import Row

    trips = Counter()

    class State(list):
        def __getattribute__(self, name):
            if name in ("get", "put", "clear", "exists", "update", "appendList", "appendValue"):
                trips["state"] += 1
            return super().__getattribute__(name)

        def get(self):
            return iter(list(self))

        def put(self, rows):
            self[:] = rows

        def appendList(self, rows):
            self.extend(rows)

    def register(moment):
        trips["timer"] += 1

    processor = calls.CallPairing(timedelta(days=1))
    processor.init(SimpleNamespace(getListState=lambda *_: State(), registerTimer=register))
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    blank = dict.fromkeys(("name", "namespace", "status", "input", "output", "error"), "")
    rows = [Row(session_ref="s", call_id=f"c{i % 20}", ts=start + timedelta(minutes=i), ordinal=i, phase="call" if i < 20 else "result", **blank) for i in range(40)]
    assert not list(processor.handleInputRows((7,), iter(reversed(rows)), None))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: calls._milliseconds(start + timedelta(minutes=29)))
    got = sorted((r.ordinal, r.call_id, r.outcome) for r in processor.handleExpiredTimer((7,), now, None))
    assert got == [(i, f"c{i % 20}", "paired") for i in range(20, 30)]
    assert len(processor.waiting) == 10 and len(processor.open) == 10
    assert trips["timer"] == 2 and trips["state"] <= 6
