"""The pipelines as streaming jobs, hop by hop.

Every hop reads one stream once, writes its result topics for each micro-batch and has its own
checkpoint: texts to events and dead letters, events to groups and state changes, state changes to
incidents, payments to fraud alerts. A hop that restarts repeats its last micro-batch with equal
results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import model
from tidewatch.functions.text import iso_instant, short_id
from tidewatch.operators import enrich, normalize, payments
from tidewatch.sources import records
from tidewatch.sources.sinks import KafkaTopics, TopicFolders, start
from tidewatch.streaming import state


def each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool
) -> StreamingQuery:
    def one_read(batch: DataFrame, batch_id: int) -> None:
        batch.persist()     # several topics from one read
        try:
            write(batch, batch_id)
        finally:
            batch.unpersist()

    return start(stream.writeStream.foreachBatch(one_read), checkpoint, once)


def normalize_job(raw: DataFrame, sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Raw texts to enriched events and dead letters."""
    def write(batch: DataFrame, batch_id: int) -> None:
        events = enrich.enriched_events(normalize.events_of(batch))
        sink.write(events, model.NORMALIZED_TOPIC, batch_id)
        letters = records.dead_letter_json(normalize.letters_of(batch))
        sink.write(letters, model.DEAD_LETTER_TOPIC, batch_id)

    return each_batch(normalize.parse_webhooks(raw), write, checkpoint, once)


def alert_rows(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Group and state change per event, in one stateful step."""
    rows = events.select(
        "event_id", "deduplication_key", "alert_name", "service", "environment", "status",
        "effective_priority", "resource_id", "event_timestamp",
        records.event_record("latest_event"), *model.ORDER)
    return rows.groupBy("deduplication_key").transformWithState(
        state.AlertProcessor(ttl_ms), state.ALERT_OUT, "append",
        "processingTime" if ttl_ms else "none")


def groups_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "group_id", "dedup_key", "alert_name", "service", "environment", "status",
        "occurrence_count", "first_seen", "last_seen", "first_seen_epoch_ms", "last_seen_epoch_ms",
        "impacted_resources", F.col("event_id").alias("latest_event_id"), "latest_event", *model.ORDER)


def changes_of(rows: DataFrame) -> DataFrame:
    return rows.filter("is_new").select(
        "dedup_key", F.col("event_alert_name").alias("alert_name"),
        F.col("event_service").alias("service"), F.col("event_environment").alias("environment"),
        "current_state", "previous_state", "transition", "effective_priority", "flapping",
        F.lit(False).alias("suppressed"), F.col("change_count").alias("occurrence_count"),
        iso_instant(F.col("event_ms")).alias("timestamp"),
        F.col("event_ms").alias("timestamp_epoch_ms"),
        F.create_map(
            F.lit("environment"), F.col("event_environment"), F.lit("testing"), F.lit("true"),
            F.lit("resource_id"), F.col("resource_id")).alias("enriched_metadata"),
        "identity_ms", "identity_prev", *model.ORDER, F.col("event_id").alias("cause_event_id"),
        short_id("ALT", F.col("dedup_key"), F.col("identity_ms")).alias("alert_id"))


def alert_job(
    events: DataFrame, sink, checkpoint: str, once: bool = False, ttl_ms: int | None = None
) -> StreamingQuery:
    """Enriched events to alert groups and state changes.

    ``ttl_ms`` lets the state of a silent resolved alert expire; open ones are kept. Expiry goes by the clock, and a job that
    watches the clock has no present end to stop at.
    """
    if once and ttl_ms:
        raise ValueError("a job with expiry cannot stop at the end of its source")

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(groups_of(batch), model.GROUPS_TOPIC, batch_id)
        sink.write(changes_of(batch), model.STATE_TOPIC, batch_id)

    return each_batch(alert_rows(events, ttl_ms), write, checkpoint, once)


def incident_rows(changes: DataFrame, list_members: bool = False) -> DataFrame:
    rows = changes.select(
        "service", "environment", "alert_id", "alert_name", "dedup_key", "identity_ms",
        "current_state", "effective_priority",
        F.col("enriched_metadata")["resource_id"].alias("resource_id"), *model.ORDER)
    return rows.groupBy("service").transformWithState(
        state.IncidentProcessor(model.CORRELATION_RULE, list_members),
        state.INCIDENT_OUT + (state.MEMBER_LISTS if list_members else ""), "append", "none")


def describe_incidents(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "incident_id": short_id(
            "INC", F.col("service"), F.col("created_at_epoch_ms"), F.col("created_seq")),
        "title": F.format_string(
            "Degradation in %s: %s (%d alerts correlated)",
            "service", "root_cause_alert_name", "member_count"),
        "created_at": iso_instant(F.col("created_at_epoch_ms")),
        "updated_at": iso_instant(F.col("updated_at_epoch_ms")),
    })


def incident_job(
    changes: DataFrame, sink, checkpoint: str, once: bool = False, list_members: bool | None = None
) -> StreamingQuery:
    """State changes to incidents. Their rows list the members for a sink of wire records."""
    if list_members is None:
        list_members = isinstance(sink, KafkaTopics)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(describe_incidents(batch), model.INCIDENT_TOPIC, batch_id)

    return each_batch(incident_rows(changes, list_members), write, checkpoint, once)


def fraud_job(messages: DataFrame, sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Payment messages to fraud alerts."""
    counted = payments.payments(messages).groupBy("account_id").transformWithState(
        state.VelocityProcessor(), state.VELOCITY_OUT, "append", "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(payments.apply_rules(batch), model.FRAUD_TOPIC, batch_id)

    return each_batch(counted, write, checkpoint, once)


LEDGER_OUT = (
    "transaction_id string, account_id string, amount decimal(15,2), currency string, status string, changed_ms bigint, "
    "seq bigint, deleted boolean"
)


def ledger_rows(messages: DataFrame) -> DataFrame:
    """Change records to the row of each key that they change: its last image, or that it is deleted.

    A change older than the last one of its key is ignored, also where that was a deletion, so the
    state remembers deleted keys.
    """
    return payments.ledger_images(messages).groupBy("transaction_id").transformWithState(
        state.LedgerProcessor(), LEDGER_OUT, "append", "none")


def ledger_job(messages: DataFrame, sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A change stream to the rows by which its table changes, one per key and micro-batch."""
    return each_batch(
        ledger_rows(messages), lambda batch, batch_id: sink.write(batch, model.LEDGER_ROWS_TOPIC, batch_id), checkpoint, once)


def topic_stream(
    spark: SparkSession, folders: TopicFolders, topic: str, per_trigger: int | None = None
) -> DataFrame:
    """A topic folder as the stream of the next hop, its schema read from the written files."""
    path = folders.path(topic)
    reader = spark.readStream.schema(spark.read.parquet(path).drop("batch").schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path + "/batch=*")
