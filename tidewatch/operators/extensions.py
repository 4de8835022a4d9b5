"""Extensions: capabilities the reference describes without coding them.

Nothing in the core pipeline depends on these. Their outputs are new columns or tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.text import has_word
from tidewatch.model import HIGH_VALUE_AMOUNT, ORDER
from tidewatch.operators.incidents import INCIDENT, latest_incidents, member_pages
from tidewatch.operators.keyed import (
    CHUNK_MS, Keep, again, carried, in_chunk, trailing_slices, trailing_sum, with_context,
)
from tidewatch.operators.payments import is_high, with_velocity
from tidewatch.session import materialize

# --- fixed values ----------------------------------------------------------------------------
THRESHOLD_COUNT = 5
THRESHOLD_MS = 120_000
CLUSTER_MS = 900_000
CLUSTER_ALERTS = 15
LATENESS_MS = 10_000
RESOLVED_TTL_MS = 24 * 3_600_000
CLOSE_AFTER_MS = 14 * 24 * 3_600_000
FLAP_QUIET_MS = 600_000
WITHDRAWAL_PLACES = 3
CAUSAL_WEIGHTS = (
    (100, ("database", "disk", "storage", "network")),
    (50, ("pod", "container", "memory", "oom")),
    (20, ("http", "ingress", "gateway", "latency")),
)
CAUSE_RANKS = {
    "DatabaseConnectionTimeout": 1, "DiskSpaceLow": 1, "StorageFailure": 1,
    "NetworkInterfaceDrop": 2, "DNSResolutionFailure": 2,
    "HighHTTP5xxErrorRate": 3, "GatewayTimeout": 3,
    "PodCrashLoopBackOff": 4, "MemoryLeakDetected": 4, "HighCPUUsage": 4,
}
UNRANKED = 5
REMEDIATIONS = {"PodCrashLoopBackOff": "KUBERNETES_RESTART_POD"}
TAG_NAMES = {
    "t_cluster": "cluster", "t_region": "region", "t_service": "service", "t_namespace": "namespace",
    "k8s_cluster": "cluster", "k8s_namespace": "namespace", "app": "service", "job": "service",
}
PRODUCTION = ("prod", "production")


def over_threshold(events: DataFrame, key: str = "deduplication_key") -> DataFrame:
    """Events that are more than the fifth of their key within two minutes."""
    return with_velocity(events, key, THRESHOLD_MS, ORDER).filter(
        F.col("window_count") > THRESHOLD_COUNT)


def cluster_key(labels: Column) -> Column:
    """cluster:namespace:service of the labels, under their standard names."""
    def tag(name: str) -> Column:
        known = [name, *(written for written, standard in TAG_NAMES.items() if standard == name)]
        return F.coalesce(*[labels[n] for n in known], F.lit("default"))

    return F.concat_ws(":", tag("cluster"), tag("namespace"), tag("service"))


def tag_clusters(events: DataFrame, chunk_ms: int = 12 * CHUNK_MS, keep: Keep = again) -> DataFrame:
    """Groups of alerts that share their tags: times at which 15 and more of them lie within 15
    minutes. A group begins where the count of the trailing 15 minutes reaches 15 and lasts until
    it falls below at an alert.

    Of 15 alerts within 15 minutes the one before the last is near enough to be seen in its chunk.
    """
    keyed = events.select(cluster_key(F.col("labels")).alias("cluster_key"), "alert_name", *ORDER)
    counted = trailing_sum(
        trailing_slices(keyed, "event_ms", CLUSTER_MS), "cluster_key", ORDER, CLUSTER_MS, "window_count")
    window, _, _ = in_chunk("cluster_key", ORDER)
    dense = F.col("window_count") >= CLUSTER_ALERTS
    rows = with_context(counted, "event_ms", CLUSTER_MS, chunk_ms).withColumn("_dense", dense)
    begins = F.col("_dense") & ~F.coalesce(F.lag("_dense").over(window), F.lit(False))
    rows = rows.withColumn("_begins", begins.cast("long")).filter("_own AND _dense").drop("_own")
    rows = carried(rows, "cluster_key", ORDER, total={"group_no": F.col("_begins")}, keep=keep)
    return rows.groupBy("cluster_key", "group_no").agg(
        F.min("event_ms").alias("reached_ms"), F.max("event_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("alerts"), F.max("window_count").alias("most_together"),
        F.array_sort(F.collect_set("alert_name")).alias("alert_names"))


def bind_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events with the configuration item of their resource, where there is one."""
    item = items.select(F.col("ci"), F.col("ci_name"), F.col("parent").alias("ci_parent"))
    return events.join(item, F.col("resource_id") == F.col("ci"), "left")


def tag_maintenance(
    events: DataFrame, windows: DataFrame, chunk_ms: int = CHUNK_MS, keep: Keep = again,
) -> DataFrame:
    """Events with ``maintenance``: whether a planned window of their item covers them.

    Windows and events of an item are one row of times: an event is covered where the latest end of
    the windows that began before it lies after it. So neither meets the other pair by pair.
    """
    begun = windows.select(
        F.col("ci").alias("resource_id"), F.col("from_ms").alias("_at"), F.lit(0).alias("_event"), F.col("to_ms").alias("_end"))
    there = events.filter("resource_id IS NOT NULL").select("*", F.col("event_ms").alias("_at"), F.lit(1).alias("_event"))
    rows = there.unionByName(begun, allowMissingColumns=True).filter("resource_id IS NOT NULL")
    rows = carried(
        rows, "resource_id", ("_at", "_event", "seq", "alert_pos"), peak={"_covered_to": F.col("_end")}, chunk_ms=chunk_ms,
        keep=keep)
    covered = F.coalesce(F.col("event_ms") < F.col("_covered_to"), F.lit(False))
    marked = rows.filter("_event = 1").select(*events.columns, covered.alias("maintenance"))
    nowhere = events.filter("resource_id IS NULL").withColumn("maintenance", F.lit(False))
    return marked.unionByName(nowhere)


def topmost_items(items: DataFrame, rounds: int = 32) -> DataFrame:
    """Every item with its top-most ancestor.

    Each round joins the table with itself and doubles the steps every item has taken, so a chain
    of n items takes log2(n) rounds. Each round is written to the shared folder.
    """
    known = items.select("ci")
    steps = items.join(known.select(F.col("ci").alias("parent")), "parent", "left_semi").select(
        "ci", F.col("parent").alias("top"))
    tops = materialize(items.select("ci").join(steps, "ci", "left").select(
        "ci", F.coalesce("top", "ci").alias("top")))
    for _ in range(rounds):
        further = tops.select(F.col("ci").alias("top"), F.col("top").alias("_next"))
        moved = materialize(tops.join(further, "top", "left").select(
            "ci", F.col("_next").alias("top"), (F.col("_next") != F.col("top")).alias("_moved")))
        tops = moved.select("ci", "top")
        if moved.filter("_moved").isEmpty():
            return tops
    raise ValueError(f"items form a cycle or a chain longer than 2**{rounds}")


def by_topmost(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events and alert keys counted per top-most item."""
    rows = events.select(F.col("resource_id").alias("ci"), "deduplication_key", "event_ms")
    per_item = rows.groupBy("ci", "deduplication_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"))
    return per_item.join(topmost_items(items), "ci").groupBy("top").agg(
        F.sum("n").alias("events"), F.count_distinct("deduplication_key").alias("alert_keys"),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def causal_weight(alert_name: Column) -> Column:
    out = F
    for weight, words in CAUSAL_WEIGHTS:
        out = out.when(has_word(alert_name, words), weight)
    return out.otherwise(0)


def _earliest() -> Column:
    return F.struct(*[(-F.col(c)).alias(c) for c in ORDER])


def weighted_root_election(incidents: DataFrame, chunk_ms: int = CHUNK_MS, keep: Keep = again) -> DataFrame:
    """Root cause after every incident change by causal weight: an alert takes over only where its
    weight is greater than that of all before it in the incident.

    Incidents of a service follow one another, so the greatest (begin, weight, earliest place) so
    far belongs to the incident of the row: a running maximum per service starts anew by itself.
    """
    here = F.struct(
        F.col("created_at_epoch_ms").alias("begin"), F.col("created_seq").alias("begin_seq"),
        causal_weight(F.col("alert_name")).alias("weight"), _earliest().alias("place"), "alert_id", "alert_name")
    rows = carried(
        incidents.withColumn("_here", here), "service", ORDER, peak={"_before": F.col("_here")}, chunk_ms=chunk_ms,
        keep=keep)
    root = F.greatest("_before", "_here")
    rows = rows.withColumn("_elected", root)
    top = F.col("_elected.weight") == CAUSAL_WEIGHTS[0][0]
    return rows.select(
        *INCIDENT, *ORDER, F.col("_elected.alert_id").alias("root_cause_alert_id"),
        F.col("_elected.alert_name").alias("root_cause_alert_name"), F.col("_elected.weight").alias("weight"),
        F.when(top, "P1").otherwise(F.col("priority")).alias("priority"))


def weighted_root_causes(incidents: DataFrame) -> DataFrame:
    """Root cause per incident by causal weight: the first alert of the greatest weight."""
    weight = causal_weight(F.col("alert_name"))
    out = incidents.withColumn("weight", weight).groupBy(*INCIDENT).agg(
        F.max_by(F.struct("alert_id", "alert_name", "weight"), F.struct("weight", _earliest())).alias("root"),
        F.max_by("priority", F.struct(*ORDER)).alias("priority"))
    return out.select(
        *INCIDENT, F.col("root.alert_id").alias("root_cause_alert_id"),
        F.col("root.alert_name").alias("root_cause_alert_name"), "root.weight",
        F.when(F.col("root.weight") == CAUSAL_WEIGHTS[0][0], "P1").otherwise(F.col("priority")).alias("priority"))


def ranked_root_causes(incidents: DataFrame) -> DataFrame:
    """Root cause per incident by the rank list of alert names; its priority is the highest of the
    incident's changes."""
    ranks = F
    for name, rank in CAUSE_RANKS.items():
        ranks = ranks.when(F.col("alert_name") == name, rank)
    rows = incidents.withColumn("cause_rank", ranks.otherwise(UNRANKED))
    return rows.groupBy(*INCIDENT).agg(
        F.min_by(F.struct("alert_id", "alert_name", "cause_rank"), F.struct("cause_rank", *ORDER)).alias("root"),
        F.min("alert_priority").alias("priority"),
    ).select(
        *INCIDENT, F.col("root.alert_id").alias("root_cause_alert_id"),
        F.col("root.alert_name").alias("root_cause_alert_name"), "root.cause_rank", "priority")


def secondary_flags(incidents: DataFrame) -> DataFrame:
    """Members of every incident, flagged to be silent where they are not its root cause.

    The incidents are read twice, for the members and for the last root cause; where they are
    still to be worked out, materialize them first.
    """
    latest = latest_incidents(incidents, fields=("incident_id", "root"))
    members = incidents.filter("is_first_of_alert").select(
        *INCIDENT, "alert_id", "alert_name", F.struct("dedup_key", "identity_ms").alias("_alert"))
    # whole identities are compared; two alerts may share a label
    secondary = F.col("_alert") != F.struct("root.dedup_key", "root.identity_ms")
    return members.join(latest, list(INCIDENT)).select(
        "alert_id", "alert_name", secondary.alias("is_secondary"),
        F.col("incident_id").alias("parent_incident_id"), secondary.alias("suppress_notification"))


def remediation_commands(latest: DataFrame) -> DataFrame:
    """Commands for incidents whose root cause has a known remedy, aimed at its resource."""
    action = F
    for name, command in REMEDIATIONS.items():
        action = action.when(F.col("root_cause_alert_name") == name, command)
    return latest.withColumn("action", action.otherwise(None)).filter("action IS NOT NULL").select(
        "action", F.col("root.resource_id").alias("target"), "incident_id", "root_cause_alert_id")


def expired_alerts(changes: DataFrame, as_of_ms: Column) -> DataFrame:
    """Alerts whose state can go: resolved for a day; closed after two weeks in any state."""
    last = changes.groupBy("dedup_key").agg(F.max_by(
        F.struct("alert_id", "current_state", F.col("event_ms").alias("last_ms")), F.struct(*ORDER)).alias("l"))
    age = as_of_ms - F.col("l.last_ms")
    verdict = F.when(age > CLOSE_AFTER_MS, "CLOSED").when(
        (F.col("l.current_state") == "RESOLVED") & (age > RESOLVED_TTL_MS), "EXPIRED")
    return last.withColumn("verdict", verdict).filter("verdict IS NOT NULL").select(
        "dedup_key", "l.alert_id", "l.current_state", "l.last_ms", "verdict")


def split_late(rows: DataFrame, key: str = "lane", chunk_ms: int = CHUNK_MS, keep: Keep = again) -> DataFrame:
    """Rows in arrival order with ``late``: more than 10 s behind the newest time of their lane.
    Rows without a lane are a lane of their own."""
    newest = carried(
        rows.withColumn("_lane", F.struct(key)), "_lane", ("arrival_ms", "seq"), peak={"newest_ms": F.col("event_ms")},
        chunk_ms=chunk_ms, keep=keep)
    late = F.coalesce(F.col("event_ms") < F.col("newest_ms") - LATENESS_MS, F.lit(False))
    return newest.select(*rows.columns, "newest_ms", late.alias("late"))


def tickets(incidents: DataFrame, page_size: int | None = None) -> DataFrame:
    """Latest incidents in the field names of a ticket table; the notes list the alert names.

    An incident is one ticket with all its members in the notes. These are gathered in pages, which
    bring their members in order, so that only pages are left to order for an incident. With
    ``page_size`` the pages are the result: the ticket and further pages of notes. The incidents are
    read twice.
    """
    latest = latest_incidents(incidents, fields=("incident_id", "title", "priority"))
    names = F.col("members.alert_name").alias("names")
    notes = member_pages(incidents, page_size or 1000).select(*INCIDENT, "page", names)
    if page_size is None:
        pages = F.array_sort(F.collect_list(F.struct("page", "names")))
        notes = notes.groupBy(*INCIDENT).agg(pages.alias("pages")).select(
            *INCIDENT, F.flatten("pages.names").alias("names"))
    page = ["page"] if page_size else []
    return notes.join(latest, list(INCIDENT)).select(
        F.col("incident_id").alias("correlation_id"), F.col("title").alias("short_description"),
        F.col("priority").alias("severity"), F.col("service").alias("cmdb_ci"), *page,
        F.to_json("names").alias("work_notes"))


def with_feedback(incidents: DataFrame, feedback: DataFrame) -> DataFrame:
    """Status per incident after feedback (the identity of an incident, state, assigned_to, event_ms)."""
    first = incidents.groupBy(*INCIDENT).agg(F.first("incident_id").alias("incident_id")).select(
        *INCIDENT, "incident_id", F.lit("OPEN").alias("state"), F.lit(None).cast("string").alias("assigned_to"),
        F.col("created_at_epoch_ms").alias("event_ms"), F.lit(0).alias("later"))
    rows = first.unionByName(feedback.select(
        *INCIDENT, F.lit(None).cast("string").alias("incident_id"), "state", "assigned_to", "event_ms",
        F.lit(1).alias("later")))
    return rows.groupBy(*INCIDENT).agg(
        F.max_by(F.struct("state", "assigned_to"), F.struct("later", "event_ms")).alias("s"),
        F.max("event_ms").alias("status_ms"), F.max("incident_id").alias("incident_id"),
    ).filter("incident_id IS NOT NULL").select(*INCIDENT, "incident_id", "s.state", "s.assigned_to", "status_ms")


def environment_priority(severity: Column, environment: Column) -> Column:
    """Priority by environment and severity, in place of the word rules."""
    level = F.upper(severity)
    middle = level.isin("HIGH", "ERROR", "WARN", "WARNING")
    critical = level.isin("CRITICAL", "FATAL")
    return F.when(
        F.lower(environment).isin(*PRODUCTION),
        F.when(critical, "P1").when(middle, "P2").otherwise("P3"),
    ).otherwise(F.when(critical, "P2").when(middle, "P3").otherwise("P4"))


def quiet_flaps(changes: DataFrame, as_of_ms: Column, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """When flapping alerts would clear: ten minutes after a flapping row with no row after it.

    The row after it is looked for no further away than that; only of the silent rows that are the
    last of their key does ``as_of_ms`` decide.
    """
    keyed = changes.select("dedup_key", "current_state", "alert_id", *ORDER)
    window, _, _ = in_chunk("dedup_key", ORDER)
    rows = with_context(keyed, "event_ms", chunk_ms=chunk_ms, ahead_ms=FLAP_QUIET_MS)
    gap = F.lead("event_ms").over(window) - F.col("event_ms")
    silent = rows.withColumn("_silent", F.coalesce(gap > FLAP_QUIET_MS, F.lit(True))).filter(
        (F.col("current_state") == "FLAPPING") & F.col("_silent") & F.col("_own"))
    last = keyed.groupBy("dedup_key").agg(F.max(F.struct(*ORDER)).alias("_last"))
    over = (F.struct(*ORDER) < F.col("_last")) | (as_of_ms - F.col("event_ms") > FLAP_QUIET_MS)
    return silent.join(last, "dedup_key").filter(over).select(
        "dedup_key", "alert_id", (F.col("event_ms") + FLAP_QUIET_MS).alias("cleared_ms"))


def closed_cycles(groups: DataFrame, gap_ms: int) -> DataFrame:
    """Duplicate cycles as a timer would close them, one window after their last event."""
    return groups.groupBy("dedup_key", "first_seen_epoch_ms").agg(
        F.max("occurrence_count").alias("occurrences"), F.max("last_seen_epoch_ms").alias("last_seen_epoch_ms"),
    ).withColumn("closed_ms", F.col("last_seen_epoch_ms") + gap_ms)


def scattered_withdrawals(
    rows: DataFrame, least: float = HIGH_VALUE_AMOUNT, width_ms: int = 60_000) -> DataFrame:
    """High withdrawals that make more than three places for their account within a minute.

    A place is present from its first withdrawal until a window after its last, so the number of
    places present is a running sum of places that come and go.
    """
    sliced = trailing_slices(rows.filter(is_high(F.col("amount"), least)), "event_ms", width_ms)
    there = Window.partitionBy("account_id", "_slice", "location").orderBy("event_ms", "seq")
    sliced = sliced.withColumns({
        "_comes": F.coalesce(F.col("event_ms") - F.lag("event_ms").over(there) >= width_ms, F.lit(True)),
        "_goes": F.coalesce(F.lead("event_ms").over(there) - F.col("event_ms") >= width_ms, F.lit(True)),
    })
    counted = trailing_sum(
        sliced, "account_id", ("event_ms", "seq"), width_ms, "places",
        F.col("_comes").cast("int"), F.col("_goes").cast("int"))
    return counted.filter(F.col("places") > WITHDRAWAL_PLACES).drop("_comes", "_goes")


def noise_reduction(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Events in, notifications out and the share that was held back, per service."""
    received = events.groupBy("service").agg(F.count(F.lit(1)).alias("events"))
    sent = latest_incidents(incidents, fields=("updated_at_epoch_ms",)).groupBy("service").agg(
        F.count(F.lit(1)).alias("notifications"),
        F.avg(F.col("updated_at_epoch_ms") - F.col("created_at_epoch_ms")).alias("mean_open_ms"))
    return received.join(sent, "service", "left").select(
        "service", "events", F.coalesce("notifications", F.lit(0)).alias("notifications"),
        F.round(1 - F.coalesce("notifications", F.lit(0)) / F.col("events"), 6).alias("noise_reduction"),
        F.round("mean_open_ms", 3).alias("mean_open_ms"))
