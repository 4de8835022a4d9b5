"""Duplicate cycles per alert key: a running group per event, and the events that go on."""

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.text import polynomial_hash_hex
from tidewatch.model import DEDUP_GAP_MS, ORDER
from tidewatch.operators.keyed import CHUNK, CHUNK_MS, Keep, again, carried, in_chunk, with_context

KEY = "deduplication_key"


def _flagged(events: DataFrame, chunk_ms: int, tasks: int = 0) -> DataFrame:
    """Events in chunks with ``_reset`` (they open a cycle) and ``is_new`` (or change the status).

    An event looks back no further than the gap that ends a cycle, so both are known in its chunk.
    The chunks are dealt over ``tasks`` tasks where those are more than a shuffle has anyway.
    """
    rows = with_context(events, "event_ms", DEDUP_GAP_MS, chunk_ms)
    if tasks > int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, KEY, CHUNK)
    window, _, _ = in_chunk(KEY, ORDER)
    rows = rows.select("*", F.lag(F.struct("event_ms", "status")).over(window).alias("_last")).filter("_own").drop("_own")
    near = F.coalesce(F.col("event_ms") - F.col("_last.event_ms") <= DEDUP_GAP_MS, F.lit(False))
    flipped = F.lower("status") != F.lower("_last.status")
    return rows.withColumns({"_reset": ~near, "is_new": ~near | flipped}).drop("_last")


def deduplicate(
    events: DataFrame, chunk_ms: int = CHUNK_MS, keep: Keep = again, tasks: int = 0,
) -> DataFrame:
    """Every enriched event with the state of its alert group after it.

    The event's own columns stay, so a row is the group record and its latest event in one;
    ``is_new`` marks the events that go on to the life cycle. Rows this wide want ``tasks`` in
    proportion to their number.
    """
    rows = _flagged(events, chunk_ms, tasks)
    of_cycle = F.when(F.col("_reset"), F.struct("event_ms", "event_timestamp"))
    window, _, _ = in_chunk(KEY, ORDER)
    label = F.concat(F.lit("GRP-"), polynomial_hash_hex(F.col(KEY)))
    # the group id is hashed only at a chunk's first event and carried from there
    group_id = F.when(F.row_number().over(window) == 1, label)
    of_key = F.struct("_group_id", "alert_name", "service", "environment")
    rows = carried(
        rows.withColumns({"_cycle_here": of_cycle, "_group_id": group_id}), KEY, ORDER,
        prev={"_cycle_before": F.col("_cycle_here")}, since={"_n": (F.lit(1), F.col("_reset"))}, first={"_first": of_key},
        seen={"impacted_resources": F.coalesce("resource_id", F.lit("default"))}, keep=keep)
    rows = rows.withColumn("_cycle", F.coalesce("_cycle_here", "_cycle_before"))
    return rows.select(
        *events.columns,
        F.col("_first._group_id").alias("group_id"),
        F.col("_first.alert_name").alias("group_alert_name"),
        F.col("_first.service").alias("group_service"),
        F.col("_first.environment").alias("group_environment"),
        F.col("_n").alias("occurrence_count"),
        F.col("_cycle.event_timestamp").alias("first_seen"),
        F.col("event_timestamp").alias("last_seen"),
        F.col("_cycle.event_ms").alias("first_seen_epoch_ms"),
        F.col("event_ms").alias("last_seen_epoch_ms"),
        "impacted_resources",
        "is_new",
    )


def alert_groups(deduplicated: DataFrame) -> DataFrame:
    """The group record after every event."""
    return deduplicated.select(
        "group_id", F.col("deduplication_key").alias("dedup_key"),
        F.col("group_alert_name").alias("alert_name"), F.col("group_service").alias("service"),
        F.col("group_environment").alias("environment"), "status", "occurrence_count",
        "first_seen", "last_seen", "first_seen_epoch_ms", "last_seen_epoch_ms",
        "impacted_resources", F.col("event_id").alias("latest_event_id"), *ORDER,
    )


def latest_groups(groups: DataFrame, fields=None) -> DataFrame:
    """The last group record of every key; only ``fields`` of it where they are named."""
    fields = [c for c in fields or groups.columns if c != "dedup_key"]
    return groups.groupBy("dedup_key").agg(
        F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("g")
    ).select("dedup_key", "g.*")


UNIQUE_COLUMNS = (
    "deduplication_key", "alert_name", "service", "environment", "status", "effective_priority",
    "event_id", "resource_id", *ORDER,
)


def unique_alerts(events: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """The events that open a cycle or change the status, with what the life cycle needs.

    One shuffle of the enriched events. ``deduplicate`` marks the same events with ``is_new``, and
    its rows serve as well.
    """
    rows = events if "is_new" in events.columns else _flagged(events, chunk_ms)
    return rows.filter("is_new").withColumn(
        "resource_id", F.coalesce("resource_id", F.lit("unknown"))
    ).select(*UNIQUE_COLUMNS)
