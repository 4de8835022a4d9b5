"""Webhook text to canonical events, and the dead letters beside them."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.plan import computed
from tidewatch.functions.text import first_of, instant_ms, last_wins, name_uuid, short_id
from tidewatch.model import (
    CORRUPT, EMPTY_PAYLOAD_ERROR, EVENT_TYPE, SOURCE_NAME, STRINGS, WEBHOOK,
)

MALFORMED_ERROR = "Malformed webhook payload"
NULL_ALERT_ERROR = "Null alert in payload"


def parse_webhooks(raw: DataFrame) -> DataFrame:
    """Add the parsed payload as ``payload``; unknown fields are ignored, bad text is flagged."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return computed(raw, payload=F.from_json("value", WEBHOOK, options))


def _well_formed() -> Column:
    return F.col("payload").isNotNull() & F.col(f"payload.{CORRUPT}").isNull()


def _has_alerts() -> Column:
    return F.coalesce(F.size("payload.alerts"), F.lit(0)) > 0


def letters_of(parsed: DataFrame) -> DataFrame:
    """One row per rejected payload, and one per null alert of an accepted payload."""
    reasons = (
        F.when(~_well_formed(), F.array(F.lit(MALFORMED_ERROR)))
        .when(~_has_alerts(), F.array(F.lit(EMPTY_PAYLOAD_ERROR)))
        .otherwise(F.transform(
            F.filter("payload.alerts", lambda alert: alert.isNull()),
            lambda _: F.lit(NULL_ALERT_ERROR),
        ))
    )
    return parsed.select("source_id", "seq", "value", reasons.alias("reasons")).select(
        "source_id", "seq", F.explode("reasons").alias("error"), F.col("value").alias("raw")
    )


def dead_letters(raw: DataFrame) -> DataFrame:
    return letters_of(parse_webhooks(raw))


def alerts_of(parsed: DataFrame) -> DataFrame:
    """One row per alert of every accepted payload, with its place in the payload."""
    return (
        parsed.filter(_well_formed())
        .select(
            "source_id", "seq", "ingest_ms", F.col("payload.status").alias("payload_status"),
            F.posexplode("payload.alerts").alias("alert_pos", "alert"),
        )
        .filter(F.col("alert").isNotNull())
    )


def _resource(labels: Column) -> Column:
    host = first_of(labels, "node", "host", "server")
    return (
        F.when(labels["instance"].isNotNull(), F.create_map(
            F.lit("id"), labels["instance"], F.lit("instance"), labels["instance"],
            F.lit("type"), F.lit("instance")))
        .when(host.isNotNull(), F.create_map(F.lit("id"), host, F.lit("type"), F.lit("server")))
        .when(labels["pod"].isNotNull(), F.create_map(
            F.lit("id"), labels["pod"], F.lit("type"), F.lit("pod")))
        .otherwise(F.create_map(
            F.lit("id"), F.lit("cluster-resource-01"), F.lit("type"), F.lit("infrastructure")))
    )


def dedup_key(source: Column, alert_name: Column, service: Column, resource: Column) -> Column:
    """source:alertName:service:resource, with stand-ins for a missing service or resource."""
    return F.concat_ws(
        ":", source, alert_name,
        F.coalesce(service, F.lit("default-service")),
        F.coalesce(resource["id"], F.lit("default-res")),
    )


def normalize_alerts(alerts: DataFrame) -> DataFrame:
    """Canonical events from exploded alerts."""
    empty = F.create_map().cast(STRINGS)
    labels, alert = F.col("labels"), F.col("alert")
    status = F.coalesce(alert["status"], F.col("payload_status"))
    starts = F.coalesce(alert["startsAt"], F.date_format(
        F.timestamp_millis("ingest_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    named = (
        alerts.withColumns({
            "labels": F.coalesce(last_wins(alert["labels"]), empty),
            "annotations": F.coalesce(last_wins(alert["annotations"]), empty),
        })
        .withColumns({
            "alert_name": F.coalesce(first_of(labels, "alertname", "alert_name"), F.lit("UnknownAlert")),
            "service": F.coalesce(first_of(labels, "service", "app", "job"), F.lit("default-service")),
            "resource": _resource(labels),
            "event_timestamp": starts,
        })
        .withColumn("timestamp_epoch_ms", F.coalesce(instant_ms(F.col("event_timestamp")), F.col("ingest_ms")))
    )
    return named.select(
        short_id("EVT", F.col("source_id"), F.col("alert_pos")).alias("event_id"),
        F.lit(SOURCE_NAME).alias("source"),
        F.lit(EVENT_TYPE).alias("event_type"),
        "alert_name",
        F.coalesce(alert["fingerprint"], name_uuid(F.col("alert_name"))).alias("fingerprint"),
        F.when(F.lower(status) == "resolved", "RESOLVED").otherwise("FIRING").alias("status"),
        F.upper(F.coalesce(labels["severity"], F.lit("medium"))).alias("source_severity"),
        "event_timestamp",
        "timestamp_epoch_ms",
        "resource",
        # steps that need the id alone do not shuffle the map
        F.col("resource")["id"].alias("resource_id"),
        "service",
        F.coalesce(first_of(labels, "env", "environment"), F.lit("dev")).alias("environment"),
        "labels",
        "annotations",
        F.lit(True).alias("testing"),
        dedup_key(F.lit(SOURCE_NAME), F.col("alert_name"), F.col("service"), F.col("resource"))
        .alias("deduplication_key"),
        # a time that is not positive gives way to the time of intake
        F.when(F.col("timestamp_epoch_ms") > 0, F.col("timestamp_epoch_ms"))
        .otherwise(F.col("ingest_ms")).alias("event_ms"),
        "seq",
        "alert_pos",
    )


def events_of(parsed: DataFrame) -> DataFrame:
    return normalize_alerts(alerts_of(parsed))


def normalized_events(raw: DataFrame) -> DataFrame:
    return events_of(parse_webhooks(raw))
