"""Tool pairing as a stateful operator: keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convhist.operators.tools import answer_fields

KEY = ["session_ref", "call_id"]
_FIELDS = "phase string, name string, namespace string, status string, input string, output string, error string"
_TEXTS = [f.split()[0] for f in _FIELDS.split(", ")]
_PLACE = "ts timestamp, ordinal long"
_EVENT = f"session_ref string, call_id string, {_PLACE}, {_FIELDS}"
_CALL = "struct<phase string, name string, namespace string, input string>"
EMITTED = f"session_ref string, call_id string, {_PLACE}, {_FIELDS}, _call {_CALL}, outcome string"
#: Groups of call ids that share their state. It only bounds round trips: a call id is never split, and buckets are many.
BUCKETS = 16_384
#: Events of one bucket that go to the store at once.
APPENDED = 10_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _milliseconds(moment: datetime) -> int:
    """Whole milliseconds at or after a moment."""
    return -((datetime(1970, 1, 1, tzinfo=timezone.utc) - moment.astimezone(timezone.utc)) // timedelta(milliseconds=1))


class CallPairing(StatefulProcessor):
    """State of the call ids of one bucket: events that the watermark has not passed, and the calls that are open.

    Events wait under a timer of the earliest one, so late events take their place in order. When time passes it, all that
    are due are applied in the order of (ts, ordinal): a call replaces an open one of its id, a result closes it. Calls that
    stay open for `timeout` end. What is left waits under a timer of its next moment. Every access to state is a round trip
    to the store, so a bucket has two lists, written once per batch, not an entry and a timer per event.
    """

    def __init__(self, timeout: timedelta):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.open = handle.getListState("open", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh, first = [], None
        for row in rows:
            event = (row.session_ref, row.call_id, row.ts, row.ordinal, *(row[f] for f in _TEXTS))
            if row.phase == "exchange":
                yield self._row(event, None, "paired")
                continue
            fresh.append(event)
            first = row.ts if first is None else min(first, row.ts)
            if len(fresh) == APPENDED:
                self.waiting.appendList(fresh)
                fresh = []
        if fresh:
            self.waiting.appendList(fresh)
        if first is not None:
            self.handle.registerTimer(_milliseconds(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # at or after this timer
        # Of several events of a call id at one place the last to come counts.
        waiting = {tuple(event)[:4]: tuple(event) for event in self.waiting.get()}
        due = [event for event in waiting.values() if _milliseconds(event[2]) <= now]
        due.sort(key=lambda event: (event[2], event[3] is not None, event[3] or 0))
        opened = {tuple(event)[:2]: tuple(event) for event in self.open.get()}
        before = dict(opened)
        for event in due:
            del waiting[event[:4]]
            held = opened.pop(event[:2], None)
            if held and held[2] + self.timeout <= event[2]:
                yield self._row(held, None, "unanswered")
                held = None
            if event[4] == "call":
                opened[event[:2]] = event
            elif held:
                yield self._row(event, held, "paired")
        for held in [held for held in opened.values() if _milliseconds(held[2] + self.timeout) <= now]:
            yield self._row(held, None, "unanswered")
            del opened[held[:2]]
        if due:
            self._store(self.waiting, waiting)
        if opened != before:
            self._store(self.open, opened)
        moments = [event[2] for event in waiting.values()] + [held[2] + self.timeout for held in opened.values()]
        if moments:
            self.handle.registerTimer(_milliseconds(min(moments)))

    @staticmethod
    def _store(state, events: dict) -> None:
        if events:
            state.put(list(events.values()))
        else:
            state.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(event: tuple, call: tuple | None, outcome: str) -> Row:
        asked = Row(phase=call[4], name=call[5], namespace=call[6], input=call[8]) if call else None
        return Row(session_ref=event[0], call_id=event[1], ts=event[2], ordinal=event[3], **dict(zip(_TEXTS, event[4:], strict=True)), _call=asked, outcome=outcome)


def pair_calls(stream: DataFrame, delay: str = "1 hour", timeout: timedelta = timedelta(days=1)) -> DataFrame:
    """Paired calls of a stream (outcome ``paired``) and calls that nobody answered in time (``unanswered``).

    ``stream`` has CALL_COLUMNS of :mod:`streams`. Events may come in any order within ``delay`` behind the newest; later
    ones, and those without a time, are left out, as the watermark rules. Results are final when they are emitted. State is
    keyed by a hash of (session, call id) and kept in RocksDB; it holds what the watermark has not passed and open calls no older
    than ``timeout``. Sort order is (ts, ordinal); where ordinals follow times, results are those of the batch pairing.
    Start the query inside :func:`state_store`.
    """
    dealt = stream.withWatermark("ts", delay).withColumn("_bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)))
    rows = dealt.groupBy("_bucket").transformWithState(
        statefulProcessor=CallPairing(timeout), outputStructType=EMITTED, outputMode="Append", timeMode="EventTime"
    )
    return answer_fields(rows, ["session_ref"], ["ts", "outcome"])


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def unfinished(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped query still holds, read from its state store: CALL_COLUMNS and ``held``.

    Events the watermark has not passed are ``waiting``, calls without an answer so far ``open``.
    """
    state = spark.read.format("statestore").option("path", checkpoint)
    waiting = state.option("stateVarName", "waiting").load()
    opened = state.option("stateVarName", "open").load()
    # Of several events of a call id at one place one counts.
    waiting = waiting.select("list_element.*").dropDuplicates([*KEY, "ts", "ordinal"])
    held = waiting.withColumn("held", F.lit("waiting")).unionByName(opened.select("list_element.*", F.lit("open").alias("held")))
    return held.select(*KEY, "ts", "ordinal", *_TEXTS, "held")
