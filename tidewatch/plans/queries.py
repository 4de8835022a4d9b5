"""The registered queries: every operator over whole tables, with columns that hash alike."""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch import model
from tidewatch.functions.plan import computed
from tidewatch.operators import access, contracts, extensions, incidents, payments, reports, results
from tidewatch.operators.dedup import latest_groups
from tidewatch.plans.alerts import AlertPipeline
from tidewatch.sources import records, sinks, streams, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_made: ContextVar[list[AlertPipeline]] = ContextVar("_made")


def query(build: Query) -> Query:
    """Register a query. What its pipelines keep is given back when its result is no longer held."""
    @functools.wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        token = _made.set([])
        try:
            found = build(spark, folder)
            for pipeline in _made.get():
                weakref.finalize(found, _close, pipeline).atexit = False
        finally:
            _made.reset(token)
        return found

    QUERIES[build.__name__] = run
    return run


def _close(pipeline: AlertPipeline) -> None:
    if SparkSession.getActiveSession():
        pipeline.close()


def alert_pipeline(spark: SparkSession, folder: str) -> AlertPipeline:
    pipeline = AlertPipeline(
        tables.webhooks(tables.events(spark, folder)), tables.event_tasks(spark, folder))
    made = _made.get(None)
    if made is not None:
        made.append(pipeline)
    return pipeline


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- normalize and enrich -----------------------------------------------------------------
@query
def normalized_events(spark, folder):
    return alert_pipeline(spark, folder).normalized.select(
        "event_id", "source", "event_type", "alert_name", "fingerprint", "status",
        "source_severity", "event_timestamp", "timestamp_epoch_ms", "service", "environment",
        "testing", F.col("annotations")["summary"].alias("summary"), *_long("seq", "alert_pos"))


@query
def dedup_key(spark, folder):
    return alert_pipeline(spark, folder).normalized.groupBy("deduplication_key").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_ms").alias("first_ms"),
        F.max("event_ms").alias("last_ms"))


@query
def resource_mapping(spark, folder):
    resource = F.col("resource")
    return alert_pipeline(spark, folder).normalized.select(
        *_long("seq", "alert_pos"), resource["id"].alias("resource_id"),
        resource["type"].alias("resource_type"), resource["instance"].alias("resource_instance"))


@query
def dead_letters(spark, folder):
    return alert_pipeline(spark, folder).dead_letters.select("source_id", "seq", "error")


@query
def enriched_events(spark, folder):
    notes = F.col("annotations")
    return alert_pipeline(spark, folder).enriched.select(
        *_long("seq", "alert_pos"), "effective_priority",
        notes["effective_priority"].alias("published_priority"),
        notes["enriched_environment"].alias("enriched_environment"),
        notes["enriched_testing"].alias("enriched_testing"),
        notes["pipeline_version"].alias("pipeline_version"),
        F.size("annotations").cast("bigint").alias("annotations"))


@query
def priority_matrix(spark, folder):
    return alert_pipeline(spark, folder).enriched.groupBy(
        "environment", "source_severity", "effective_priority"
    ).agg(F.count(F.lit(1)).alias("events"))


# ---- deduplicate --------------------------------------------------------------------------
@query
def alert_groups(spark, folder):
    return alert_pipeline(spark, folder).groups.select(
        "group_id", "dedup_key", "alert_name", "service", "environment", "status",
        "occurrence_count", "first_seen", "last_seen", "first_seen_epoch_ms", "last_seen_epoch_ms",
        F.array_join("impacted_resources", ",").alias("impacted_resources"),
        "latest_event_id", *_long("seq", "alert_pos"))


@query
def alert_groups_latest(spark, folder):
    return latest_groups(alert_pipeline(spark, folder).groups, (
        "group_id", "status", "occurrence_count", "first_seen_epoch_ms", "last_seen_epoch_ms",
        "latest_event_id"))


@query
def unique_alerts(spark, folder):
    return alert_pipeline(spark, folder).unique_alerts.select(
        "deduplication_key", "event_id", "status", "event_ms", *_long("seq", "alert_pos"))


@query
def group_id_hash(spark, folder):
    return alert_pipeline(spark, folder).groups.groupBy("group_id").agg(
        F.min("dedup_key").alias("dedup_key"), F.count(F.lit(1)).alias("updates"))


# ---- life cycle ---------------------------------------------------------------------------
@query
def state_changes(spark, folder):
    return alert_pipeline(spark, folder).state_changes.select(
        "alert_id", "dedup_key", "alert_name", "service", "environment", "current_state",
        "previous_state", "transition", "effective_priority", "flapping", "suppressed",
        "occurrence_count", "timestamp", "timestamp_epoch_ms",
        F.col("enriched_metadata")["resource_id"].alias("resource_id"), *_long("seq", "alert_pos"))


@query
def transition_counts(spark, folder):
    return alert_pipeline(spark, folder).state_changes.groupBy(
        "previous_state", "current_state", "transition").agg(F.count(F.lit(1)).alias("changes"))


@query
def transition_history(spark, folder):
    rows = results.transition_history(
        alert_pipeline(spark, folder).state_changes, "DatabaseConnectionTimeout")
    return rows.select(
        "alert_id", "dedup_key", "previous_state", "current_state", "transition", "event_ms",
        *_long("seq", "alert_pos"))


@query
def reopened(spark, folder):
    return results.reopened(alert_pipeline(spark, folder).state_changes)


@query
def flapping(spark, folder):
    return results.flapping(alert_pipeline(spark, folder).state_changes).select(
        "alert_id", "dedup_key", "transition", "current_state", "timestamp_epoch_ms",
        *_long("seq", "alert_pos"))


# ---- incidents ----------------------------------------------------------------------------
@query
def incident_changes(spark, folder):
    return alert_pipeline(spark, folder).incident_changes.select(
        "incident_id", "title", "status", "priority", "service", "environment",
        "root_cause_alert_id", "root_cause_alert_name", "member_count", "correlation_rule",
        "created_at", "updated_at", "created_at_epoch_ms", "updated_at_epoch_ms",
        *_long("seq", "alert_pos"))


@query
def incident_members(spark, folder):
    return alert_pipeline(spark, folder).incident_members.select(
        "incident_id", "service", "created_at_epoch_ms", "member_no", "alert_id", "alert_name",
        "joined_epoch_ms")


@query
def incidents_latest(spark, folder):
    return incidents.latest_incidents(alert_pipeline(spark, folder).incident_changes, fields=(
        "incident_id", "priority", "title", "root_cause_alert_id", "root_cause_alert_name",
        "member_count", "updated_at_epoch_ms")).drop("created_seq")


@query
def latest_incident_per_service(spark, folder):
    return results.latest_incident_per_service(alert_pipeline(spark, folder).incident_changes).select(
        "service", "incident_id", "priority", "title", "root_cause_alert_name", "member_count")


@query
def root_cause(spark, folder):
    return alert_pipeline(spark, folder).incident_changes.groupBy(
        "service", "root_cause_alert_name", "priority").agg(F.count(F.lit(1)).alias("updates"))


@query
def incident_records(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    rows = incidents.incident_records(pipeline.keep(pipeline.incident_changes))
    return rows.select(
        "incident_id", F.array_join("correlated_alert_ids", ",").alias("correlated_alert_ids"),
        F.array_join("correlated_alert_names", ",").alias("correlated_alert_names"),
        *_long("seq", "alert_pos"))


# ---- result checks ------------------------------------------------------------------------
@query
def latest_group_per_alert(spark, folder):
    return results.latest_group_per_alert(alert_pipeline(spark, folder).groups).select(
        "alert_name", "group_id", "occurrence_count", "first_seen", "last_seen")


@query
def result_bundle(spark, folder):
    """The three result streams as records under their topics, counted by what they name."""
    pipeline = alert_pipeline(spark, folder)
    pipeline.enriched = pipeline.keep(pipeline.enriched)  # read for the groups and for the states
    pipeline.state_changes = pipeline.keep(pipeline.state_changes)
    changes = pipeline.keep(incidents.incident_changes(pipeline.state_changes, keep=pipeline.keep))
    bundle = sinks.result_bundle({
        model.GROUPS_TOPIC: records.group_json(pipeline.deduplicated),
        model.STATE_TOPIC: records.change_json(pipeline.state_changes),
        model.INCIDENT_TOPIC: records.incident_json(incidents.incident_records(changes)),
    })
    named = F.from_json("value", "groupId string, alertId string, incidentId string, alertName string, title string")
    return computed(bundle, r=named).groupBy(
        "topic", F.coalesce("r.incidentId", "r.alertId", "r.groupId").alias("id"),
        F.coalesce("r.title", "r.alertName").alias("name"),
    ).agg(F.count(F.lit(1)).alias("records"))


# ---- payments -----------------------------------------------------------------------------
def _messages(spark, folder):
    return tables.payment_messages(tables.events(spark, folder))


@query
def cdc_unwrap(spark, folder):
    return payments.payments(_messages(spark, folder)).select(
        "topic", "transaction_id", "account_id", "amount", "currency", "event_ms", "seq")


@query
def rejected_payments(spark, folder):
    return payments.rejected_messages(_messages(spark, folder)).select("topic", "seq", "rejected")


@query
def velocity(spark, folder):
    return payments.with_velocity(payments.payments(_messages(spark, folder))).select(
        "transaction_id", "account_id", "event_ms", "seq", "window_count")


@query
def high_value(spark, folder):
    rows = payments.payments(_messages(spark, folder))
    return rows.filter(payments.is_high(F.col("amount"))).select(
        "transaction_id", "account_id", "amount", "currency", "topic")


@query
def fraud_alerts(spark, folder):
    return payments.fraud_alerts(payments.payments(_messages(spark, folder))).select(
        "alert_id", "transaction_id", "account_id", "amount", "currency", "alert_type", "severity",
        "timestamp", "details", "source_topic")


@query
def audit_union(spark, folder):
    messages = _messages(spark, folder)
    alerts = payments.fraud_alerts(payments.payments(messages))
    rows = payments.audit_rows(messages, records.fraud_alert_json(alerts))
    return rows.groupBy("topic", "value").agg(F.count(F.lit(1)).alias("copies"))


@query
def topic_dump(spark, folder):
    """Records among the lines of the payment topics."""
    return streams.only_json(_messages(spark, folder)).groupBy("topic").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("value")).alias("characters"))


@query
def current_ledger(spark, folder):
    changes = tables.ledger_changes(tables.events(spark, folder))
    return payments.current_ledger(changes).select(
        "transaction_id", "account_id", F.col("amount").cast("double").alias("amount"), "currency",
        "status", "changed_ms")


# ---- throughput, latency and balance ------------------------------------------------------
def _producer_stats(spark, folder):
    return reports.producer_stats(tables.producer_lines(tables.events(spark, folder)))


@query
def perf_log_parse(spark, folder):
    return _producer_stats(spark, folder).select(
        "run_id", "topic", "records_sent", *reports.PERF_FIELDS)


@query
def consumer_csv_parse(spark, folder):
    lines = tables.consumer_lines(tables.events(spark, folder))
    return reports.consumer_stats(lines).select(
        "run_id", "topic", *[name for _, name, _ in reports.CONSUMER_FIELDS])


def _duration() -> Column:
    return (F.max("ts_ms") - F.min("ts_ms")) / 1000


@query
def throughput_totals(spark, folder):
    return reports.totals(_producer_stats(spark, folder), _duration()).select(
        "records_sent", "failed_records", "duration_sec", "records_per_sec", "mb_per_sec",
        F.round("total_mb", 6).alias("total_mb"))


@query
def throughput_by_topic(spark, folder):
    return reports.totals(_producer_stats(spark, folder), _duration(), "topic").select(
        "topic", "records_sent", "failed_records", "records_per_sec", "mb_per_sec")


@query
def peak_topic(spark, folder):
    return reports.peak_topic(_producer_stats(spark, folder), "records_per_sec")


def _deltas(spark, folder):
    """Offsets now against those at the middle of the time that the events span."""
    rows = tables.events(spark, folder, texts=False)
    middle = rows.agg(F.floor((F.min("ts_ms") + F.max("ts_ms")) / 2)).scalar()
    return reports.partition_delta(tables.offsets(rows.filter(F.col("ts_ms") < middle)), tables.offsets(rows))


@query
def partition_delta(spark, folder):
    return _deltas(spark, folder)


@query
def partition_balance(spark, folder):
    return reports.partition_balance(_deltas(spark, folder))


@query
def latency_percentiles(spark, folder):
    rows = reports.percentiles(
        tables.events(spark, folder, texts=False), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return rows.select("event_type", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query
def reconcile_targets(spark, folder):
    """Every run plans a hundred records for each of its number; the logs tell what came of it."""
    rows = tables.events(spark, folder, texts=False)
    planned = rows.groupBy(F.col("event_type").alias("topic")).agg(F.sum(F.col("k") * 100).alias("target_records"))
    consumed = reports.consumer_stats(tables.consumer_lines(tables.events(spark, folder)))
    return reports.reconcile(planned, _producer_stats(spark, folder), consumed)


# ---- access audit -------------------------------------------------------------------------
def _requests(spark, folder):
    return tables.access_requests(tables.events(spark, folder))


@query
def access_decisions(spark, folder):
    return access.decide(_requests(spark, folder)).select(
        "request_id", "principal", "operation", "resource", "resource_type", "internal_rule",
        "admin_rule", "manager_rule", "cluster_rule", "writer_rule", "reader_rule", "group_rule",
        "allowed")


@query
def principal_teams(spark, folder):
    return access.teams(_requests(spark, folder))


@query
def access_rollup(spark, folder):
    return access.rollup(access.decide(_requests(spark, folder)))


@query
def acl_semi_join(spark, folder):
    bindings = spark.createDataFrame(access.BINDINGS, access.BINDING_SCHEMA)
    return access.granted_by_bindings(_requests(spark, folder), bindings).select(
        "request_id", "principal", "operation", "resource", "resource_type")


@query
def decision_report(spark, folder):
    """Rule decisions against the decisions of the access lists, as expectation."""
    requests = _requests(spark, folder)
    bindings = spark.createDataFrame(access.BINDINGS, access.BINDING_SCHEMA)
    granted = access.granted_by_bindings(requests, bindings).select(
        "request_id", F.lit(True).alias("granted"))
    decided = access.decide(requests).select("request_id", "allowed").join(
        granted, "request_id", "left").withColumn("expected", F.coalesce("granted", F.lit(False)))
    return access.compare_expected(decided)


# ---- record contracts ---------------------------------------------------------------------
def _payment_records(spark, folder):
    return tables.payment_records(tables.events(spark, folder))


V2_OPTIONAL = ("remittanceInfo", "fraudRiskScore")


@query
def contract_v1_good(spark, folder):
    return contracts.conforming(_payment_records(spark, folder), model.PAYMENT_V1).select(
        "seq", "paymentId", "sourceAccountIban", "destAccountIban", "amount", "currency", "timestamp")


@query
def contract_violations(spark, folder):
    return contracts.quarantine(_payment_records(spark, folder), model.PAYMENT_V1).select(
        "seq", "field", "problem")


@query
def contract_v2_read(spark, folder):
    return contracts.conforming(_payment_records(spark, folder), model.PAYMENT_V2, V2_OPTIONAL).select(
        "seq", "paymentId", "amount", "remittanceInfo", "fraudRiskScore")


@query
def breaking_change_impact(spark, folder):
    return contracts.change_impact(_payment_records(spark, folder), model.PAYMENT_BREAKING)


@query
def equity_order_violations(spark, folder):
    orders = tables.equity_orders(tables.order_lines(spark, folder))
    return contracts.quarantine(orders, model.EQUITY_ORDER_V1).select(
        "l_orderkey", *_long("l_linenumber"), "field", "problem")


@query
def equity_orders_good(spark, folder):
    orders = tables.equity_orders(tables.order_lines(spark, folder))
    return contracts.conforming(orders, model.EQUITY_ORDER_V1).groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("shares").alias("shares"),
        F.round(F.sum("price"), 2).alias("notional"))


@query
def contract_versions(spark, folder):
    return contracts.versions_per_subject(_payment_records(spark, folder)).select(
        "subject", "versions", F.col("latest_version").cast("bigint").alias("latest_version"), "records")


# ---- extensions ---------------------------------------------------------------------------
@query
def count_threshold(spark, folder):
    return extensions.over_threshold(alert_pipeline(spark, folder).normalized).select(
        "deduplication_key", "event_ms", "window_count", *_long("seq", "alert_pos"))


@query
def tag_clusters(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    return extensions.tag_clusters(pipeline.normalized, keep=pipeline.keep).withColumn(
        "alert_names", F.array_join("alert_names", ","))


@query
def ci_binding(spark, folder):
    bound = extensions.bind_items(
        alert_pipeline(spark, folder).normalized, tables.configuration_items(spark, folder))
    return bound.select(*_long("seq", "alert_pos"), "ci", "ci_name", "ci_parent")


@query
def maintenance_tags(spark, folder):
    windows = tables.maintenance_windows(tables.events(spark, folder, texts=False))
    pipeline = alert_pipeline(spark, folder)
    events = pipeline.normalized.select("resource_id", *model.ORDER)
    return extensions.tag_maintenance(events, windows, keep=pipeline.keep).select(
        *_long("seq", "alert_pos"), "maintenance")


@query
def topmost_items(spark, folder):
    return extensions.topmost_items(tables.configuration_items(spark, folder))


@query
def topology_groups(spark, folder):
    return extensions.by_topmost(
        alert_pipeline(spark, folder).normalized, tables.configuration_items(spark, folder))


@query
def weighted_root_cause(spark, folder):
    return extensions.weighted_root_causes(alert_pipeline(spark, folder).incident_changes).select(
        "service", "created_at_epoch_ms", "root_cause_alert_id", "root_cause_alert_name",
        *_long("weight"), "priority")


@query
def weighted_root_election(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    return extensions.weighted_root_election(pipeline.incident_changes, keep=pipeline.keep).select(
        "service", "created_at_epoch_ms", "root_cause_alert_id", "root_cause_alert_name",
        *_long("weight", "seq", "alert_pos"), "priority")


@query
def ranked_root_cause(spark, folder):
    return extensions.ranked_root_causes(alert_pipeline(spark, folder).incident_changes).select(
        "service", "created_at_epoch_ms", "root_cause_alert_id", "root_cause_alert_name",
        *_long("cause_rank"), "priority")


@query
def child_suppression(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    return extensions.secondary_flags(pipeline.keep(pipeline.incident_changes))


@query
def remediation_commands(spark, folder):
    latest = incidents.latest_incidents(alert_pipeline(spark, folder).incident_changes, fields=(
        "incident_id", "root_cause_alert_id", "root_cause_alert_name", "root"))
    return extensions.remediation_commands(latest)


@query
def expired_alerts(spark, folder):
    changes = alert_pipeline(spark, folder).state_changes
    as_of = tables.events(spark, folder, texts=False).agg(F.max("ts_ms") + extensions.CLOSE_AFTER_MS - 43_200_000).scalar()
    return extensions.expired_alerts(changes, as_of)


@query
def late_events(spark, folder):
    rows = tables.arrivals(tables.events(spark, folder, texts=False))
    return extensions.split_late(rows).filter("late").select("lane", "seq", "event_ms", "newest_ms")


@query
def tickets(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    return extensions.tickets(pipeline.keep(pipeline.incident_changes))


@query
def incident_feedback(spark, folder):
    """Feedback is taken from the incidents: the second alert starts work, the fifth solves it."""
    pipeline = alert_pipeline(spark, folder)
    changes = pipeline.keep(pipeline.incident_changes)
    at = F.col("is_first_of_alert")
    feedback = changes.filter(at & F.col("member_count").isin(2, 5)).select(
        *incidents.INCIDENT, F.when(F.col("member_count") == 2, "In Progress").otherwise("Resolved").alias("state"),
        F.lit("alice").alias("assigned_to"), "event_ms")
    return extensions.with_feedback(changes, feedback).select("incident_id", "state", "assigned_to", "status_ms")


@query
def environment_matrix(spark, folder):
    priority = extensions.environment_priority(F.col("source_severity"), F.col("environment"))
    return alert_pipeline(spark, folder).normalized.groupBy(
        "environment", "source_severity", priority.alias("priority")
    ).agg(F.count(F.lit(1)).alias("events"))


@query
def quiet_flaps(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    as_of = tables.events(spark, folder, texts=False).agg(F.max("ts_ms")).scalar()
    return extensions.quiet_flaps(pipeline.keep(pipeline.state_changes), as_of)


@query
def closed_cycles(spark, folder):
    return extensions.closed_cycles(alert_pipeline(spark, folder).groups, model.DEDUP_GAP_MS)


@query
def scattered_withdrawals(spark, folder):
    rows = tables.withdrawals(tables.events(spark, folder, texts=False))
    return extensions.scattered_withdrawals(rows).select(
        "account_id", "seq", "event_ms", "places")


@query
def noise_reduction(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    pipeline.events = pipeline.keep(pipeline.events)
    return extensions.noise_reduction(pipeline.events, pipeline.incident_changes)


@query
def detection_delay(spark, folder):
    pipeline = alert_pipeline(spark, folder)
    latest = incidents.latest_incidents(pipeline.incident_changes, fields=("updated_at_epoch_ms",))
    rows = pipeline.keep(latest.select(
        "service", (F.col("updated_at_epoch_ms") - F.col("created_at_epoch_ms")).cast("double").alias("open_ms")))
    return reports.percentiles(rows, "service", "open_ms", {"p50": 0.5, "p95": 0.95})
