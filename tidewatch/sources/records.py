"""Records as JSON texts, in the field names of the wire format."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import model
from tidewatch.functions.plan import computed

EVENT_FIELDS = {
    "eventId": "event_id", "source": "source", "eventType": "event_type", "alertName": "alert_name",
    "fingerprint": "fingerprint", "status": "status", "sourceSeverity": "source_severity",
    "eventTimestamp": "event_timestamp", "timestampEpochMs": "timestamp_epoch_ms",
    "resource": "resource", "service": "service", "environment": "environment", "labels": "labels",
    "annotations": "annotations", "testing": "testing", "deduplicationKey": "deduplication_key",
}
GROUP_FIELDS = {
    "groupId": "group_id", "dedupKey": "deduplication_key", "alertName": "group_alert_name",
    "service": "group_service", "environment": "group_environment", "status": "status",
    "occurrenceCount": "occurrence_count", "firstSeen": "first_seen", "lastSeen": "last_seen",
    "firstSeenEpochMs": "first_seen_epoch_ms", "lastSeenEpochMs": "last_seen_epoch_ms",
    "impactedResources": "impacted_resources",
}
CHANGE_FIELDS = {
    "alertId": "alert_id", "dedupKey": "dedup_key", "alertName": "alert_name", "service": "service",
    "environment": "environment", "currentState": "current_state", "previousState": "previous_state",
    "transition": "transition", "effectivePriority": "effective_priority", "flapping": "flapping",
    "suppressed": "suppressed", "occurrenceCount": "occurrence_count", "timestamp": "timestamp",
    "timestampEpochMs": "timestamp_epoch_ms", "enrichedMetadata": "enriched_metadata",
}
INCIDENT_FIELDS = {
    "incidentId": "incident_id", "title": "title", "status": "status", "priority": "priority",
    "service": "service", "environment": "environment", "rootCauseAlertId": "root_cause_alert_id",
    "rootCauseAlertName": "root_cause_alert_name", "correlatedAlertIds": "correlated_alert_ids",
    "correlatedAlertNames": "correlated_alert_names", "correlationRule": "correlation_rule",
    "createdAt": "created_at", "updatedAt": "updated_at",
    "createdAtEpochMs": "created_at_epoch_ms", "updatedAtEpochMs": "updated_at_epoch_ms",
}
FRAUD_FIELDS = {
    "alertId": "alert_id", "transactionId": "transaction_id", "accountId": "account_id",
    "amount": "amount", "currency": "currency", "alertType": "alert_type", "severity": "severity",
    "timestamp": "timestamp", "details": "details", "sourceTopic": "source_topic",
}


def _record(fields: dict[str, str]) -> Column:
    return F.struct(*[F.col(column).alias(name) for name, column in fields.items()])


def _json(record: Column) -> Column:
    return F.to_json(record, {"ignoreNullFields": "false"}).alias("value")


def event_json(events: DataFrame) -> DataFrame:
    return events.select(_json(_record(EVENT_FIELDS)))


def group_json(deduplicated: DataFrame) -> DataFrame:
    """Alert groups with their latest event inside."""
    latest = _record(EVENT_FIELDS).alias("latestEvent")
    parts = [F.col(column).alias(name) for name, column in GROUP_FIELDS.items()]
    return deduplicated.select(_json(F.struct(*parts, latest)))


def change_json(changes: DataFrame) -> DataFrame:
    return changes.select(_json(_record(CHANGE_FIELDS)))


def incident_json(incident_records: DataFrame) -> DataFrame:
    return incident_records.select(_json(_record(INCIDENT_FIELDS)))


def fraud_alert_json(alerts: DataFrame) -> DataFrame:
    return alerts.select(_json(_record(FRAUD_FIELDS)))


def dead_letter_json(letters: DataFrame) -> DataFrame:
    """Error and raw text; the text is quoted, so the record is valid JSON."""
    return letters.select(_json(F.struct("error", "raw")))


def event_record(name: str) -> Column:
    """The event of a row as JSON text, to travel with a group until it is written."""
    return F.to_json(_record(EVENT_FIELDS), {"ignoreNullFields": "false"}).alias(name)


def _group_json(groups: DataFrame) -> DataFrame:
    """Groups of the stream, whose latest event is a JSON text."""
    named = {
        name: column.replace("group_", "") if column != "group_id" else column
        for name, column in GROUP_FIELDS.items()}
    named["dedupKey"] = "dedup_key"
    parts = [F.col(column).alias(name) for name, column in named.items()]
    latest = F.from_json("latest_event", model.EVENT_RECORD).alias("latestEvent")
    return groups.select(_json(F.struct(*parts, latest)))


WIRE = {
    model.NORMALIZED_TOPIC: event_json, model.GROUPS_TOPIC: _group_json, model.STATE_TOPIC: change_json,
    model.INCIDENT_TOPIC: incident_json, model.FRAUD_TOPIC: fraud_alert_json,
}


def wire_json(rows: DataFrame, topic: str) -> DataFrame:
    """Rows of a streaming job as the records of its topic."""
    if rows.columns == ["value"]:
        return rows
    if topic in WIRE:
        return WIRE[topic](rows)
    return rows.select(_json(F.struct("*")))


def _columns(messages: DataFrame, schema, fields: dict[str, str]) -> DataFrame:
    """Columns of the records of a topic, ordered by their position in it."""
    rows = computed(messages, r=F.from_json("value", schema)).filter("r IS NOT NULL")
    event_ms = F.col("r.timestampEpochMs")
    return rows.select(
        *[F.col(f"r.{name}").alias(column) for name, column in fields.items()],
        F.when(event_ms > 0, event_ms).otherwise(F.col("ingest_ms")).alias("event_ms"),
        "seq", F.lit(0).alias("alert_pos"))


def events_from_wire(messages: DataFrame) -> DataFrame:
    """Enriched events from the messages of the normalized topic."""
    return _columns(messages, model.EVENT_RECORD, EVENT_FIELDS).withColumns({
        "resource_id": F.col("resource")["id"],
        "effective_priority": F.col("annotations")["effective_priority"],
    })


def changes_from_wire(messages: DataFrame) -> DataFrame:
    """State changes from the messages of their topic. The identity of an alert is then its key
    with its short id, which is all a record tells of it."""
    identity = F.conv(F.substring("alert_id", 5, 8), 16, 10).cast("bigint")
    return _columns(messages, model.CHANGE_RECORD, CHANGE_FIELDS).withColumn("identity_ms", identity)
