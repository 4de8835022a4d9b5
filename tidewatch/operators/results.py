"""Questions asked of the results: latest group, history, reopened, flapping, latest incident."""

from pyspark.sql import DataFrame, functions as F

from tidewatch.model import ORDER
from tidewatch.operators.incidents import latest_incidents


def latest_group_per_alert(groups: DataFrame) -> DataFrame:
    """The last group record of every alert name."""
    fields = ("group_id", "dedup_key", "occurrence_count", "first_seen", "last_seen")
    return groups.groupBy("alert_name").agg(
        F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("g")).select("alert_name", "g.*")


def transition_history(changes: DataFrame, alert_name: str) -> DataFrame:
    """The transitions of one alert name, in order."""
    return changes.filter(F.col("alert_name") == alert_name).select(
        "alert_id", "dedup_key", "previous_state", "current_state", "transition", *ORDER,
    ).orderBy(*ORDER)


def reopened(changes: DataFrame) -> DataFrame:
    """Reopened alerts; an identity is reopened any number of times under one alert id."""
    return changes.filter(F.col("transition") == "REOPENED").groupBy("dedup_key", "identity_ms").agg(
        F.min("alert_id").alias("alert_id"), F.count(F.lit(1)).alias("times_reopened"),
        (F.min("alert_id") == F.max("alert_id")).alias("same_alert_id"))


def flapping(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("flapping") | (F.col("current_state") == "FLAPPING"))


def latest_incident_per_service(incidents: DataFrame) -> DataFrame:
    return latest_incidents(incidents, ("service",), (
        "incident_id", "status", "priority", "title", "root_cause_alert_id", "root_cause_alert_name",
        "member_count", "created_at_epoch_ms", "updated_at_epoch_ms"))
