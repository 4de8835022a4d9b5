"""Streaming forms of the extensions that need state, a watermark or timers."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.model import DEDUP_GAP_MS, ORDER
from tidewatch.operators.extensions import FLAP_QUIET_MS, LATENESS_MS
from tidewatch.operators.incidents import INCIDENT
from tidewatch.streaming.jobs import each_batch

LATE_TOPIC = "events.late"
IN_TIME_TOPIC = "events.in-time"


class LatenessProcessor(StatefulProcessor):
    """Compares every row with the newest time its lane has seen before it.

    Spark drops rows behind a watermark. Here they are only marked, so they can be kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("newest", "newest_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = self.store.get()[0] if self.store.exists() else None
        for row in sorted(rows, key=lambda r: (r["arrival_ms"], r["seq"])):
            late = newest is not None and row["event_ms"] < newest - LATENESS_MS
            yield Row("lane", "seq", "event_ms", "newest_ms", "late")(
                key[0], row["seq"], row["event_ms"], newest, late)
            newest = row["event_ms"] if newest is None else max(newest, row["event_ms"])
        self.store.update((newest,))

    def close(self) -> None:
        pass


def late_job(rows: DataFrame, sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Rows (lane, arrival_ms, seq, event_ms) to one topic, those more than 10 s late to another."""
    marked = rows.groupBy("lane").transformWithState(
        LatenessProcessor(), "lane string, seq bigint, event_ms bigint, newest_ms bigint, late boolean",
        "append", "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(batch.filter("late"), LATE_TOPIC, batch_id)
        sink.write(batch.filter("NOT late"), IN_TIME_TOPIC, batch_id)

    return each_batch(marked, write, checkpoint, once)


def closed_cycles(events: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Duplicate cycles, each told once the watermark has passed its last event by the gap."""
    timed = events.select(
        "deduplication_key", F.timestamp_millis("event_ms").alias("at"), "event_ms"
    ).withWatermark("at", lateness)
    # sessions that touch are merged, so an event exactly one gap later still belongs
    session = F.session_window("at", f"{DEDUP_GAP_MS} milliseconds")
    return timed.groupBy(session, F.col("deduplication_key").alias("dedup_key")).agg(
        F.min("event_ms").alias("first_seen_epoch_ms"), F.count(F.lit(1)).alias("occurrences"),
        F.max("event_ms").alias("last_seen_epoch_ms"),
    ).drop("session_window").withColumn("closed_ms", F.col("last_seen_epoch_ms") + DEDUP_GAP_MS)


class QuietFlapProcessor(StatefulProcessor):
    """Sets a timer ten minutes after a flapping row; a row within these takes it back, and a later
    one, in the same micro-batch or another, tells that the time had run out before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("flap", "alert_id string, due_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out = Row("dedup_key", "alert_id", "cleared_ms")
        waiting = self.store.get() if self.store.exists() else None
        timer = waiting and waiting[1]
        for row in sorted(rows, key=lambda r: (r["event_ms"], r["seq"])):
            if waiting and row["event_ms"] > waiting[1]:
                yield out(key[0], *waiting)
            flapping = row["current_state"] == "FLAPPING"
            waiting = (row["alert_id"], row["event_ms"] + FLAP_QUIET_MS) if flapping else None
        due = waiting and waiting[1]
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if waiting is None:
            self.store.clear()
        else:
            if timer != due:
                self.handle.registerTimer(due)
            self.store.update(waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.store.exists():
            alert_id, due = self.store.get()
            self.store.clear()
            yield Row("dedup_key", "alert_id", "cleared_ms")(key[0], alert_id, due)

    def close(self) -> None:
        pass


def quiet_flaps(changes: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Flapping alerts that have been quiet for ten minutes of event time."""
    timed = changes.select(
        "dedup_key", "alert_id", "current_state", "event_ms", "seq",
        F.timestamp_millis("event_ms").alias("at")).withWatermark("at", lateness)
    return timed.groupBy("dedup_key").transformWithState(
        QuietFlapProcessor(), "dedup_key string, alert_id string, cleared_ms bigint", "append", "eventTime")


class FeedbackProcessor(StatefulProcessor):
    """The status of an incident from its own rows and from the feedback on it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("status", "known boolean, state string, assigned_to string, at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, state, assigned, at = self.store.get() if self.store.exists() else (False, None, None, None)
        for row in sorted(rows, key=lambda r: (r["event_ms"], r["state"] is not None)):
            if row["state"] is None:
                known = True
            elif at is None or row["event_ms"] >= at:
                state, assigned, at = row["state"], row["assigned_to"], row["event_ms"]
        self.store.update((known, state, assigned, at))
        if known:
            yield Row(*INCIDENT, "state", "assigned_to")(*key, state or "OPEN", assigned)

    def close(self) -> None:
        pass


def incident_status(incidents: DataFrame, feedback: DataFrame) -> DataFrame:
    """Status per incident, under its full identity, after every micro-batch that touches it."""
    nothing = F.lit(None).cast("string")
    both = incidents.select(
        *INCIDENT, nothing.alias("state"), nothing.alias("assigned_to"), "event_ms"
    ).unionByName(feedback.select(*INCIDENT, "state", "assigned_to", "event_ms"))
    return both.groupBy(*INCIDENT).transformWithState(
        FeedbackProcessor(),
        "service string, created_at_epoch_ms bigint, created_seq bigint, state string, assigned_to string", "append", "none")


class MaintenanceProcessor(StatefulProcessor):
    """Events of an item against the planned windows known so far.

    The windows are held in the order of their begins, only those that reach further than all before
    them, so the last one that has begun tells whether any covers an event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("windows", "begins array<bigint>, ends array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        begins, ends = map(list, self.store.get()) if self.store.exists() else ([], [])
        events = []
        for row in rows:
            if row["to_ms"] is None:
                events.append((row["event_ms"], row["seq"], row["alert_pos"]))
                continue
            at = bisect.bisect_right(begins, row["event_ms"])
            if at == 0 or ends[at - 1] < row["to_ms"]:
                last = at
                while last < len(ends) and ends[last] <= row["to_ms"]:
                    last += 1
                begins[at:last], ends[at:last] = [row["event_ms"]], [row["to_ms"]]
        self.store.update((begins, ends))
        for event_ms, seq, alert_pos in events:
            at = bisect.bisect_right(begins, event_ms)
            yield Row("resource_id", *ORDER, "maintenance")(
                key[0], event_ms, seq, alert_pos, at > 0 and event_ms < ends[at - 1])

    def close(self) -> None:
        pass


def maintenance(events: DataFrame, windows: DataFrame) -> DataFrame:
    """(resource_id, place of the event, maintenance): whether a planned window covers an event.

    Windows count for the events of their own micro-batch and of later ones.
    """
    begun = windows.select(
        F.col("ci").alias("resource_id"), F.col("from_ms").alias("event_ms"), F.lit(None).cast("bigint").alias("seq"),
        F.lit(None).cast("int").alias("alert_pos"), "to_ms")
    both = events.select("resource_id", *ORDER, F.lit(None).cast("bigint").alias("to_ms")).unionByName(begun)
    return both.filter("resource_id IS NOT NULL").groupBy("resource_id").transformWithState(
        MaintenanceProcessor(), "resource_id string, event_ms bigint, seq bigint, alert_pos int, maintenance boolean",
        "append", "none")
