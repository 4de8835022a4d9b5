"""Alert life cycle: open, resolved, reopened and flapping, one change row per event.

The state is a matter of flips, events whose status differs from the one before, and of anchors,
the events that open a toggle window; an anchor depends on the anchor before it. Both are worked
out by chunks of time: what a chunk does to a state that enters it is written down once for each
event that can be its first anchor, these functions are applied one after the other along the key,
and every chunk then knows the state it begins with. The rows themselves stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.text import iso_instant, short_id
from tidewatch.model import FLAP_TOGGLES, FLAP_WINDOW_MS, ORDER, REOPEN_MS
from tidewatch.operators.keyed import CHUNK, CHUNK_MS, Keep, again, in_chunk, in_chunks, of_chunk

KEY = "deduplication_key"

_LONG, _LONGS = pa.int64(), pa.list_(pa.int64())
_POSITION = pa.struct([("event_ms", pa.int64()), ("seq", pa.int64()), ("alert_pos", pa.int32())])

# What a chunk does: facts of its own, and lists with an entry for each possible first anchor.
EFFECT = pa.schema([
    (KEY, pa.string()), (CHUNK, _LONG), ("first_ms", _LONG), ("first_firing", pa.bool_()), ("flips", _LONG),
    ("first_flip_ms", _LONG), ("last_flip_ms", _LONG), ("flip_before_ms", _LONG), ("last_open_ms", _LONG),
    ("events", _LONG), ("last_pos", _POSITION), ("times", _LONGS), ("anchors", pa.list_(_LONGS)),
    ("flips_after", _LONGS), ("toggles_at_last", _LONGS), ("in_force_at_last", _LONGS)])

# The state that enters a chunk.
ENTRY = pa.schema([
    (KEY, pa.string()), (CHUNK, _LONG), ("_in_firing", pa.bool_()), ("_in_flip_ms", _LONG), ("_in_toggles", _LONG),
    ("_in_state", pa.string()), ("_in_identity", _LONG), ("_in_events", _LONG), ("_in_pos", _POSITION), ("_anchors", _LONGS)])

_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    def kind(t: pa.DataType) -> str:
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        if pa.types.is_struct(t):
            return f"struct<{', '.join(f'{f.name}: {kind(f.type)}' for f in t)}>"
        return _DDL[t]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def _anchor_paths(times: np.ndarray) -> np.ndarray:
    """For each distinct time that can be a chunk's first anchor, a row with it and the anchors that
    follow it, as indexes; len(times) stands for none."""
    following = np.append(np.searchsorted(times, times + FLAP_WINDOW_MS, side="right"), len(times))
    # the anchor before lies at most one window before the chunk's first event
    within = int(np.searchsorted(times, times[0] + FLAP_WINDOW_MS, side="right"))
    path = [np.arange(min(within + 1, len(times)))]
    while (path[-1] < len(times)).any():
        path.append(following[path[-1]])
    return np.stack(path[:-1], axis=1)


def _effect(rows: dict[str, np.ndarray]) -> dict:
    """What a chunk does, from its distinct times with flips, rows and openings at each."""
    times, flips = rows["event_ms"], rows["flips"]
    flipping = np.flatnonzero(flips)
    opening = np.flatnonzero(rows["opens"])
    last = flipping[-1] if len(flipping) else -1
    path = _anchor_paths(times)
    before = np.concatenate([[0], np.cumsum(flips)])     # flips before each time, and in all
    end = np.where(path < len(times), path, -1).max(axis=1)
    at_last = np.where(path <= last, path, -1).max(axis=1)      # the anchor in force at the last flip
    return dict(
        first_ms=int(times[0]), flips=int(before[-1]),
        first_flip_ms=int(times[flipping[0]]) if len(flipping) else None,
        last_flip_ms=int(times[last]) if len(flipping) else None,
        last_open_ms=int(times[opening[-1]]) if len(opening) else None,
        events=int(rows["events"].sum()),
        times=times[path[:, 0]].tolist(),
        anchors=[times[p[p < len(times)]].tolist() for p in path],
        flips_after=(before[-1] - before[end]).tolist(),
        toggles_at_last=(before[-1] - before[np.maximum(at_last, 0)]).tolist(),
        in_force_at_last=np.where(at_last >= 0, times[at_last], np.iinfo(np.int64).min).tolist(),
    )


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk from rows sorted by key, chunk and time; a chunk may span batches."""
    held: list[pa.RecordBatch] = []

    def closed(table: pa.Table) -> pa.RecordBatch:
        out = []
        change = pc.or_(
            pc.not_equal(table[KEY].slice(1), table[KEY].slice(0, len(table) - 1)),
            pc.not_equal(table[CHUNK].slice(1), table[CHUNK].slice(0, len(table) - 1)))
        edges = np.concatenate([[0], 1 + np.flatnonzero(change.to_numpy(zero_copy_only=False)), [len(table)]]).tolist()
        numbers = {c: table[c].to_numpy() for c in ("event_ms", "flips", "opens", "events")}
        keys, chunks = table[KEY].take(edges[:-1]).to_pylist(), table[CHUNK].take(edges[:-1]).to_pylist()
        firing = table["first_firing"].take(edges[:-1]).to_pylist()
        ends = [b - 1 for b in edges[1:]]
        last_pos, before = table["last_pos"].take(ends).to_pylist(), table["flip_before_ms"]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            effect = _effect({c: v[a:b] for c, v in numbers.items()})
            at = a + int(np.flatnonzero(numbers["flips"][a:b])[-1]) if effect["flips"] else None
            out.append(effect | {
                KEY: keys[k], CHUNK: chunks[k], "first_firing": firing[k], "last_pos": last_pos[k],
                "flip_before_ms": before[at].as_py() if at is not None else None})
        return pa.RecordBatch.from_pylist(out, EFFECT)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = (batch[KEY][-1].as_py(), batch[CHUNK][-1].as_py())
        if (held[0][KEY][0].as_py(), held[0][CHUNK][0].as_py()) == last:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = pc.and_(pc.equal(table[KEY], last[0]), pc.equal(table[CHUNK], last[1]))
        cut = len(table) - pc.sum(same).as_py()
        yield closed(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield closed(pa.Table.from_batches(held).combine_chunks())


def decided(firing: bool, toggles: int, silent_ms: int | None) -> str:
    """The state after a flip: ``silent_ms`` since the flip before it."""
    if not firing:
        return "RESOLVED"
    if toggles > FLAP_TOGGLES:
        return "FLAPPING"
    return "REOPENED" if silent_ms <= REOPEN_MS else "OPEN"


class Entry:
    """The state of a key between two chunks."""

    def __init__(self):
        self.firing = self.flip_ms = self.anchor = self.toggles = self.state = self.identity = self.pos = None
        self.events = 0

    def pass_chunk(self, c: dict) -> list[int]:
        """Move on over a chunk; returns its anchors."""
        first_ms, fresh = c["first_ms"], self.state is None
        first_flip = not fresh and self.firing != c["first_firing"]
        at = 0 if fresh else int(np.searchsorted(c["times"], self.anchor + FLAP_WINDOW_MS, side="right"))
        anchors = c["anchors"][at] if at < len(c["times"]) else []
        carried_on = (self.toggles or 0) + first_flip + c["flips"]

        def since(anchor: int | None, flips: int) -> int:
            """Toggles up to a flip or to the end, from the anchor in force there."""
            return carried_on if anchor is None else flips + (first_flip and anchor == first_ms)

        flip_before = first_ms if fresh or first_flip else self.flip_ms
        state, identity = self.state, self.identity
        if fresh:
            state, identity = "OPEN" if c["first_firing"] else "RESOLVED", first_ms
        elif first_flip:
            toggles = 1 if anchors and anchors[0] == first_ms else self.toggles + 1
            state = decided(c["first_firing"], toggles, first_ms - self.flip_ms)
            identity = first_ms if state == "OPEN" else identity
        if c["flips"]:
            firing = c["first_firing"] ^ (c["flips"] % 2 == 1)
            if not c["first_firing"] and c["first_flip_ms"] - flip_before > REOPEN_MS:
                identity = c["first_flip_ms"]
            if c["last_open_ms"] is not None:
                identity = c["last_open_ms"]
            force, toggles = (c["in_force_at_last"][at], c["toggles_at_last"][at]) if anchors else (None, None)
            force = force if anchors and force >= first_ms else None
            before = c["flip_before_ms"] if c["flip_before_ms"] is not None else flip_before
            state = decided(firing, since(force, toggles), c["last_flip_ms"] - before)
            flip_before = c["last_flip_ms"]
        else:
            firing = c["first_firing"]
        self.toggles = since(anchors[-1] if anchors else None, c["flips_after"][at] if anchors else None)
        self.anchor = anchors[-1] if anchors else self.anchor
        self.firing, self.flip_ms, self.state, self.identity = firing, flip_before, state, identity
        self.events, self.pos = self.events + c["events"], c["last_pos"]
        return anchors


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the begin of every chunk of one key, from its chunks in order."""
    entry = Entry()
    for batch in batches:
        out = []
        for c in batch.to_pylist():
            known = (entry.firing, entry.flip_ms, entry.toggles, entry.state, entry.identity, entry.events, entry.pos)
            out.append(dict(zip(ENTRY.names, (c[KEY], c[CHUNK], *known, entry.pass_chunk(c)))))
        yield pa.RecordBatch.from_pylist(out, ENTRY)


def _chunk_entries(rows: DataFrame) -> DataFrame:
    """The state that enters every chunk, from rows with what is known inside a chunk."""
    opens = F.col("_firing") & (F.col("event_ms") - F.col("_flip_before") > REOPEN_MS) & F.col("_flip")
    at_times = rows.groupBy(KEY, CHUNK, "event_ms").agg(
        F.sum(F.coalesce(F.col("_flip").cast("long"), F.lit(0))).alias("flips"),
        F.max(F.coalesce(opens, F.lit(False)).cast("long")).alias("opens"),
        F.count(F.lit(1)).alias("events"),
        F.min_by("_firing", F.struct(*ORDER)).alias("first_firing"),
        F.max(F.struct(*ORDER)).alias("last_pos"),
        F.max_by("_flip_before", F.when(F.col("_flip"), F.struct(*ORDER))).alias("flip_before_ms"))
    effects = at_times.sortWithinPartitions(KEY, CHUNK, "event_ms").mapInArrow(_effects, _ddl(EFFECT))
    return effects.repartition(KEY).sortWithinPartitions(KEY, CHUNK).groupBy(KEY).applyInArrow(_entries, _ddl(ENTRY))


def state_changes(alerts: DataFrame, chunk_ms: int = CHUNK_MS, keep: Keep = again) -> DataFrame:
    """One row per unique alert: the transition it caused and the state after it.

    ``dedup_key`` with ``identity_ms`` is the full identity; ``alert_id`` is its label.
    """
    window, before, upto = in_chunk(KEY, ORDER)
    position, ms = F.struct(*ORDER), F.col("event_ms")
    rows = in_chunks(alerts, "event_ms", chunk_ms).withColumn("_firing", F.lower("status") == "firing")
    firing = F.col("_firing")
    rows = rows.withColumn("_flip", F.lag("_firing").over(window) != firing)     # unknown at a chunk's first row
    rows = keep(rows.withColumn("_flip_before", F.last(F.when(F.col("_flip"), ms), ignorenulls=True).over(before)))
    entries = _chunk_entries(rows.select(KEY, CHUNK, *ORDER, "_firing", "_flip", "_flip_before"))
    rows = of_chunk(rows, entries.withColumnsRenamed({KEY: "_key", CHUNK: "_of"}), KEY)

    leads = F.col("_flip").isNull()     # the first row of its chunk
    first = leads & F.col("_in_state").isNull()
    flip = F.coalesce("_flip", F.col("_in_firing") != firing, F.lit(False))
    anchor = F.array_contains("_anchors", ms) & F.coalesce(F.lag("event_ms").over(window) != ms, F.lit(True))
    rows = rows.withColumns({
        "_first": first, "_flip": flip, "_anchor": anchor, "_no": F.row_number().over(window),
        "_before": F.coalesce(F.lag(position).over(window), "_in_pos")})
    rows = rows.withColumns({
        "_flips": F.sum(F.col("_flip").cast("long")).over(upto),
        "_flip_before": F.coalesce(
            F.last(F.when(F.col("_flip") | F.col("_first"), ms), ignorenulls=True).over(before), "_in_flip_ms")})
    base = F.last(F.when(F.col("_anchor"), F.col("_flips") - F.col("_flip").cast("long")), ignorenulls=True).over(upto)
    toggles = F.col("_flips") + F.coalesce(-base, "_in_toggles", F.lit(0))
    rows = rows.withColumn("_toggles", toggles)
    here = (
        F.when((F.col("_first") | F.col("_flip")) & ~firing, "RESOLVED")
        .when(F.col("_first"), "OPEN")
        .when(F.col("_flip") & (F.col("_toggles") > FLAP_TOGGLES), "FLAPPING")
        .when(F.col("_flip") & (ms - F.col("_flip_before") <= REOPEN_MS), "REOPENED")
        .when(F.col("_flip"), "OPEN"))
    rows = rows.withColumn("_decided", here)
    identity = F.when(F.col("_first") | (F.col("_decided") == "OPEN"), ms)
    rows = rows.withColumn("_identity_here", identity)
    rows = rows.withColumns({
        "_state_before": F.coalesce(F.last("_decided", ignorenulls=True).over(before), "_in_state"),
        "_identity": F.coalesce(F.last("_identity_here", ignorenulls=True).over(upto), "_in_identity")})
    here, previous = F.col("_decided"), F.coalesce("_state_before", F.lit("NONE"))
    transition = (
        F.when(here == "OPEN", "CREATED").when(here == "REOPENED", "REOPENED")
        .when(here == "FLAPPING", "FLAPPING_DETECTED").when(here == "RESOLVED", "RESOLVED")
        .when(~firing, "ALREADY_RESOLVED")
        .when(previous == "FLAPPING", "FLAPPING_HELD").otherwise("UPDATED"))
    current = F.coalesce(here, "_state_before")
    out = rows.select(
        F.col(KEY).alias("dedup_key"), "alert_name", "service", "environment",
        current.alias("current_state"), previous.alias("previous_state"), transition.alias("transition"),
        F.coalesce("effective_priority", F.lit("P3")).alias("effective_priority"),
        (firing & (current == "FLAPPING")).alias("flapping"),
        F.lit(False).alias("suppressed"), (F.col("_in_events") + F.col("_no")).alias("occurrence_count"),
        iso_instant(ms).alias("timestamp"),
        ms.alias("timestamp_epoch_ms"),
        F.create_map(
            F.lit("environment"), F.col("environment"), F.lit("testing"), F.lit("true"),
            F.lit("resource_id"), F.coalesce("resource_id", F.lit("unknown")),
        ).alias("enriched_metadata"),
        F.col("_identity").alias("identity_ms"),
        # the row before it with the same alert identity
        F.when(F.col("_identity_here").isNull(), F.col("_before")).alias("identity_prev"),
        *ORDER, F.col("event_id").alias("cause_event_id"))
    return out.withColumn("alert_id", short_id("ALT", F.col("dedup_key"), F.col("identity_ms")))
