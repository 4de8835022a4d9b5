"""Stateful processors: alert groups with their life cycle, incidents, payment velocity.

Rows of a key are sorted within a micro-batch and taken in arrival order over micro-batches. No
watermark is used: a row is never late, and time may run backwards between micro-batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.model import (
    DEDUP_GAP_MS, FLAP_TOGGLES, FLAP_WINDOW_MS, INCIDENT_GAP_MS, ORDER, REOPEN_MS,
    ROOT_CAUSE_WORDS, VELOCITY_WINDOW_MS,
)


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda row: tuple(row[c] for c in ORDER))


def text_hash(text: str) -> str:
    """The group label hash, see functions.text.polynomial_hash_hex."""
    total = 0
    data = text.encode("utf-16-be")
    for high, low in zip(data[::2], data[1::2]):
        total = (31 * total + 256 * high + low) & 0xFFFFFFFF
    return format(total, "X")


ALERT_STATE = (
    "group_id string, alert_name string, service string, environment string, resources array<string>, "
    "status string, last_ms bigint, count bigint, first_ms bigint, first_seen string, "
    "state string, identity_ms bigint, resolved_ms bigint, toggles bigint, anchor_ms bigint, "
    "forwarded bigint, prev_ms bigint, prev_seq bigint, prev_pos bigint"
)
GROUP_OUT = (
    "event_id string, dedup_key string, status string, group_id string, alert_name string, "
    "service string, environment string, occurrence_count bigint, first_seen string, "
    "last_seen string, first_seen_epoch_ms bigint, last_seen_epoch_ms bigint, "
    "impacted_resources array<string>, is_new boolean, latest_event string"
)
CHANGE_OUT = (
    "event_alert_name string, event_service string, event_environment string, "
    "effective_priority string, resource_id string, current_state string, previous_state string, "
    "transition string, flapping boolean, change_count bigint, identity_ms bigint, "
    "identity_prev struct<event_ms: bigint, seq: bigint, alert_pos: int>"
)
ALERT_OUT = f"{GROUP_OUT}, {CHANGE_OUT}, event_ms bigint, seq bigint, alert_pos int"

# What an event that toggles nothing is called, by the state it finds.
_UNCHANGED = {"RESOLVED": "ALREADY_RESOLVED", "FLAPPING": "FLAPPING_HELD", "OPEN": "UPDATED", "REOPENED": "UPDATED"}


def next_state(state: dict, firing: bool, ms: int) -> str:
    """Move the life-cycle part of the state on by one event and name the transition."""
    if state.get("state") is None:
        state.update(
            state="OPEN" if firing else "RESOLVED", identity_ms=ms, resolved_ms=ms, toggles=0, anchor_ms=ms)
        return "CREATED" if firing else "RESOLVED"
    toggled = firing == (state["state"] == "RESOLVED")
    if ms - state["anchor_ms"] > FLAP_WINDOW_MS:
        state.update(anchor_ms=ms, toggles=0)
    if not toggled:
        return _UNCHANGED[state["state"]]
    state["toggles"] += 1
    if not firing:
        state.update(state="RESOLVED", resolved_ms=ms)
        return "RESOLVED"
    if state["toggles"] > FLAP_TOGGLES:
        state["state"] = "FLAPPING"
        return "FLAPPING_DETECTED"
    if ms - state["resolved_ms"] <= REOPEN_MS:
        state["state"] = "REOPENED"
        return "REOPENED"
    state.update(state="OPEN", identity_ms=ms)
    return "CREATED"


class AlertProcessor(StatefulProcessor):
    """Duplicate cycles and life cycle of an alert key in one pass, since they share the key.

    One row out per event: the alert group after it and, where the event opens a cycle or changes
    the status, the state change as well.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # only resolved alerts are forgotten; an open one keeps its state however long it is silent
        self.open = handle.getValueState("alert", ALERT_STATE)
        self.resolved = handle.getValueState("resolved", ALERT_STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        dedup_key = key[0]
        state = dict.fromkeys(_names(ALERT_STATE))
        for store in (self.open, self.resolved):
            if store.exists():
                state = dict(zip(state, store.get()))
        for row in in_order(rows):
            yield self._take(state, dedup_key, row)
        keep, other = (self.resolved, self.open) if state["state"] == "RESOLVED" else (self.open, self.resolved)
        other.clear()
        keep.update(tuple(state.values()))

    def _take(self, state: dict, dedup_key: str, row: Row) -> Row:
        ms = row["event_ms"]
        resource = row["resource_id"] or "default"
        known = state["last_ms"] is not None
        if not known:
            state.update(
                group_id="GRP-" + text_hash(dedup_key), alert_name=row["alert_name"],
                service=row["service"], environment=row["environment"], resources=[], forwarded=0)
        begins = not known or ms - state["last_ms"] > DEDUP_GAP_MS
        is_new = begins or state["status"].lower() != row["status"].lower()
        if begins:
            state.update(count=0, first_ms=ms, first_seen=row["event_timestamp"])
        state["count"] += 1
        if resource not in state["resources"]:
            state["resources"] = sorted([*state["resources"], resource])
        state.update(status=row["status"], last_ms=ms)
        group = (
            row["event_id"], dedup_key, row["status"], state["group_id"], state["alert_name"],
            state["service"], state["environment"], state["count"], state["first_seen"],
            row["event_timestamp"], state["first_ms"], ms, list(state["resources"]), is_new, row["latest_event"],
        )
        change = (None,) * len(_names(CHANGE_OUT))
        if is_new:
            firing = row["status"].lower() == "firing"
            before, identity = state["state"], state["identity_ms"]
            previous = (state["prev_ms"], state["prev_seq"], state["prev_pos"])
            transition = next_state(state, firing, ms)
            same_identity = before is not None and identity == state["identity_ms"]
            state.update(
                forwarded=state["forwarded"] + 1, prev_ms=ms, prev_seq=row["seq"], prev_pos=row["alert_pos"])
            change = (
                row["alert_name"], row["service"], row["environment"],
                row["effective_priority"] or "P3", row["resource_id"] or "unknown", state["state"],
                before or "NONE", transition, firing and state["state"] == "FLAPPING",
                state["forwarded"], state["identity_ms"], previous if same_identity else None,
            )
        return Row(*_names(ALERT_OUT))(*group, *change, ms, row["seq"], row["alert_pos"])

    def close(self) -> None:
        pass


def _names(ddl: str) -> list[str]:
    """Column names of a flat schema text (nested parts are in angle brackets)."""
    names, depth, part = [], 0, ""
    for char in ddl + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            names.append(part.split()[0])
            part = ""
        else:
            part += char
    return names


INCIDENT_STATE = (
    "created_ms bigint, created_seq bigint, priority string, environment string, "
    "root struct<alert_id: string, alert_name: string, dedup_key: string, identity_ms: bigint, resource_id: string>, "
    "updated_ms bigint, members bigint"
)
INCIDENT_OUT = (
    "service string, status string, priority string, environment string, root_cause_alert_id string, "
    "root_cause_alert_name string, member_count bigint, correlation_rule string, "
    "created_at_epoch_ms bigint, created_seq bigint, updated_at_epoch_ms bigint, alert_id string, "
    "alert_name string, dedup_key string, identity_ms bigint, is_first_of_alert boolean, "
    "event_ms bigint, seq bigint, alert_pos int, alert_priority string, "
    "root struct<alert_id: string, alert_name: string, dedup_key: string, identity_ms: bigint, resource_id: string>"
)
ROOT = ("alert_id", "alert_name", "dedup_key", "identity_ms", "resource_id")
MEMBER_LISTS = ", correlated_alert_ids array<string>, correlated_alert_names array<string>"


class IncidentProcessor(StatefulProcessor):
    """Incidents of a service. The members are a map state of their own, so an incident with many
    alerts is looked up by alert and not loaded whole, unless its rows are to list the members as
    the wire records do."""

    def __init__(self, rule: str, list_members: bool = False):
        self.rule, self.list_members = rule, list_members

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("incident", INCIDENT_STATE)
        self.members = handle.getMapState(
            "members", "dedup_key string, identity_ms bigint", "member_no bigint, alert_id string, alert_name string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        service = key[0]
        names = _names(INCIDENT_STATE)
        state = dict(zip(names, self.store.get())) if self.store.exists() else None
        listed = sorted(tuple(value) for _, value in self.members.iterator()) if self.list_members else []
        out = Row(*_names(INCIDENT_OUT + MEMBER_LISTS if self.list_members else INCIDENT_OUT))
        for row in in_order(rows):
            ms, active = row["event_ms"], row["current_state"] != "RESOLVED"
            lapsed = state is None or ms - state["updated_ms"] > INCIDENT_GAP_MS
            if lapsed and not active:
                continue
            member = (row["dedup_key"], row["identity_ms"])
            if lapsed:
                self.members.clear()
                listed = []
                state = dict(
                    created_ms=ms, created_seq=row["seq"], priority=row["effective_priority"],
                    environment=row["environment"], root=tuple(row[c] for c in ROOT), updated_ms=ms, members=0)
            else:
                rooted = any(word in row["alert_name"].lower() for word in ROOT_CAUSE_WORDS)
                if rooted:
                    state["root"] = tuple(row[c] for c in ROOT)
                if rooted or row["effective_priority"] == "P1":
                    state["priority"] = "P1"
                state["updated_ms"] = ms
            joins = lapsed or not self.members.containsKey(member)
            if joins:
                state["members"] += 1
                entry = (state["members"], row["alert_id"], row["alert_name"])
                self.members.updateValue(member, entry)
                if self.list_members:
                    listed.append(entry)
            lists = ([m[1] for m in listed], [m[2] for m in listed]) if self.list_members else ()
            yield out(
                service, "OPEN", state["priority"], state["environment"], *state["root"][:2],
                state["members"], self.rule, state["created_ms"],
                state["created_seq"], state["updated_ms"], row["alert_id"], row["alert_name"],
                row["dedup_key"], row["identity_ms"], joins, ms, row["seq"], row["alert_pos"],
                row["effective_priority"], tuple(state["root"]), *lists)
        if state is not None:
            self.store.update(tuple(state[name] for name in names))

    def close(self) -> None:
        pass


VELOCITY_OUT = (
    "topic string, source_id string, seq bigint, transaction_id string, account_id string, "
    "amount double, currency string, event_ms bigint, window_count bigint"
)


class VelocityProcessor(StatefulProcessor):
    """Payments with the number of payments of their account in the trailing window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = list(self.store.get()[0]) if self.store.exists() else []
        heapq.heapify(times)    # the oldest first, also where time ran backwards
        names = _names(VELOCITY_OUT)
        for row in sorted(rows, key=lambda r: (r["event_ms"], r["seq"])):
            now = row["event_ms"]
            while times and now - times[0] >= VELOCITY_WINDOW_MS:
                heapq.heappop(times)
            heapq.heappush(times, now)
            yield Row(*names)(*[row[n] for n in names[:-1]], len(times))
        self.store.update((times,))

    def close(self) -> None:
        pass


class LedgerProcessor(StatefulProcessor):
    """The last image of a ledger key. Only the newest change of a micro-batch counts, so the rows
    of a key are gone through once and not held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("last", "changed_ms bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda row: (row["changed_ms"], row["seq"]))
        at = (newest["changed_ms"], newest["seq"])
        if self.store.exists() and tuple(self.store.get()) >= at:
            return
        self.store.update(at)
        names = ("account_id", "amount", "currency", "status", "changed_ms", "seq", "deleted")
        yield Row("transaction_id", *names)(key[0], *(newest[name] for name in names))

    def close(self) -> None:
        pass
