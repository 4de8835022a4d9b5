"""Correlation of the state changes of a service into incidents with a root cause.

Rows are in time order, so incidents are the sessions of a service by silence, without the
RESOLVED rows a session begins with.
"""

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.text import has_word, iso_instant, short_id
from tidewatch.model import CORRELATION_RULE, INCIDENT_GAP_MS, ORDER, ROOT_CAUSE_WORDS
from tidewatch.operators.keyed import (
    CHUNK, CHUNK_MS, Keep, again, chunks_before, in_chunk, of_chunk, with_context,
)

KEY = "service"


def _in_their_chunk(changes: DataFrame, chunk_ms: int) -> DataFrame:
    """Changes with what is known inside a chunk, up to and with each row.

    ``_begin`` is where the session began, null in the head of a chunk that goes on with an earlier
    session. ``_opens`` marks the first active row of a session; in the head it is one only if
    the session that goes on has no incident yet.
    """
    needed = changes.select(
        KEY, *ORDER, "current_state", "alert_id", "alert_name", "dedup_key", "identity_ms", "identity_prev",
        "environment", "effective_priority", F.col("enriched_metadata")["resource_id"].alias("resource_id"))
    rows = with_context(needed, "event_ms", INCIDENT_GAP_MS, chunk_ms)
    window, before, upto = in_chunk(KEY, ORDER)
    here = F.struct(*ORDER)
    active = F.upper("current_state") != "RESOLVED"
    gap = F.col("event_ms") - F.lag("event_ms").over(window)
    rows = rows.withColumn("_begins", F.coalesce(gap > INCIDENT_GAP_MS, F.lit(True))).filter("_own").drop("_own")
    rows = rows.withColumns({
        "_begin": F.last(F.when(F.col("_begins"), here), ignorenulls=True).over(upto),
        "_active_before": F.last(F.when(active, here), ignorenulls=True).over(before)})
    opens = active & F.coalesce(F.col("_active_before") < F.col("_begin"), F.col("_active_before").isNull())
    rows = rows.withColumn("_opens", opens)
    rooted = has_word(F.col("alert_name"), ROOT_CAUSE_WORDS)
    incident = F.struct(
        here.alias("at"), F.col("event_ms").alias("created_ms"), F.col("seq").alias("created_seq"),
        "effective_priority", "environment")
    cause = F.struct(
        "alert_id", "alert_name", "dedup_key", "identity_ms", "resource_id")
    last = {
        "_incident": F.when(F.col("_opens"), incident),
        "_root": F.when(F.col("_opens") | rooted, cause),
        "_rooted": F.when(rooted, cause),
        "_urgent": F.when(rooted | (F.col("effective_priority") == "P1"), here),
    }
    rows = rows.withColumns({n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()})
    # members of the last incident opened here; a row whose alert came up after its opening is none
    joins = F.col("_opens") | F.coalesce(F.col("identity_prev") < F.col("_incident.at"), F.lit(True))
    rows = rows.withColumn("_joined", F.sum(joins.cast("long")).over(upto))
    opened = F.last(F.when(F.col("_opens"), F.col("_joined") - 1), ignorenulls=True).over(upto)
    return rows.withColumn("_members", F.col("_joined") - opened).drop("_joined")


def _entering(rows: DataFrame) -> DataFrame:
    """The incident that enters every chunk, null where none is open, its root cause, the last urgent
    place and its members so far.

    A chunk in which a session begins leaves what its last session has. Any other one goes on with
    the session before it, and opens an incident only if that has none.
    """
    names = ("_begin", "_incident", "_root", "_rooted", "_urgent", "_members")
    # last places of the alerts that come up in the chunk for the first time
    before = F.when(F.coalesce(F.col("identity_prev.event_ms") < F.col("_from_ms"), F.lit(True)), F.struct("identity_prev"))
    ends = rows.groupBy(KEY, CHUNK).agg(
        F.max_by(F.struct(*names), F.struct(*ORDER)).alias("_end"), F.collect_list(before).alias("_seen")).select(
        KEY, CHUNK, "_end.*", "_seen")
    chunk, begun = F.col(CHUNK), F.col("_begin").isNotNull()
    own = F.when(~begun | (F.col("_incident.at") >= F.col("_begin")), F.col("_incident"))
    earlier = chunks_before(KEY)
    ends = ends.withColumn("_own", own).withColumns({
        "_reset": F.last(F.when(begun, chunk), ignorenulls=True).over(earlier),
        "_had": F.last(F.when(F.col("_own").isNotNull(), chunk), ignorenulls=True).over(earlier)})
    idle = F.col("_had").isNull() | F.coalesce(F.col("_had") < F.col("_reset"), F.lit(False))
    opens = F.col("_own").isNotNull() & (begun | idle)
    ends = ends.withColumn("_opens", opens).withColumns({
        "_opened": F.last(F.when(F.col("_opens"), F.struct(chunk.alias("of"), F.col("_own").alias("incident"))), ignorenulls=True).over(earlier),
        "_in_root": F.last(F.when(begun | F.col("_opens"), F.col("_root")).otherwise(F.col("_rooted")), ignorenulls=True).over(earlier),
        "_in_urgent": F.last("_urgent", ignorenulls=True).over(earlier)})
    lasts = F.coalesce(F.col("_opened.of") >= F.col("_reset"), F.lit(True))
    ends = ends.withColumn("_in_incident", F.when(lasts, F.col("_opened.incident")))
    at = F.col("_in_incident.at")
    come = F.size(F.filter("_seen", lambda s: s["identity_prev"].isNull() | (s["identity_prev"] < at)))
    adds = F.when(begun | F.col("_opens"), F.coalesce("_members", F.lit(0))).otherwise(F.when(at.isNotNull(), come).otherwise(0))
    ends = ends.withColumn("_adds", adds.cast("long"))
    ends = ends.withColumn("_so_far", F.coalesce(F.sum("_adds").over(earlier), F.lit(0)))
    base = F.last(F.when(begun | F.col("_opens"), F.col("_so_far")), ignorenulls=True).over(earlier)
    return ends.select(
        F.col(KEY).alias("_key"), chunk.alias("_of"), "_in_incident", "_in_root", "_in_urgent",
        (F.col("_so_far") - base).alias("_in_members"))


def _incidents(changes: DataFrame, chunk_ms: int, keep: Keep) -> DataFrame:
    rows = keep(_in_their_chunk(changes, chunk_ms).withColumn("_from_ms", F.col(CHUNK) * chunk_ms))
    rows = of_chunk(rows, _entering(rows), KEY)
    goes_on = F.col("_begin").isNull() & F.col("_in_incident").isNotNull()
    own = F.when(F.col("_begin").isNull() | (F.col("_incident.at") >= F.col("_begin")), F.col("_incident"))
    rows = rows.withColumns({
        "_opens": F.col("_opens") & ~goes_on,
        "_root": F.when(goes_on, F.coalesce("_rooted", "_in_root")).otherwise(F.col("_root")),
        "_incident": F.when(goes_on, F.col("_in_incident")).otherwise(own),
        "_urgent": F.coalesce("_urgent", "_in_urgent"),
    }).filter("_incident IS NOT NULL")
    joins = F.col("_opens") | F.coalesce(F.col("identity_prev") < F.col("_incident.at"), F.lit(True))
    rows = rows.withColumn("is_first_of_alert", joins)
    _, _, upto = in_chunk(KEY, ORDER)
    joined = F.sum(F.col("is_first_of_alert").cast("long")).over(upto)
    rows = rows.withColumn("member_count", F.when(goes_on, F.col("_in_members") + joined).otherwise(F.col("_members")))
    priority = F.when(F.coalesce(F.col("_urgent") > F.col("_incident.at"), F.lit(False)), "P1").otherwise(
        F.col("_incident.effective_priority"))
    return rows.select(
        "service",
        F.lit("OPEN").alias("status"),
        priority.alias("priority"),
        F.col("_incident.environment").alias("environment"),
        F.col("_root.alert_id").alias("root_cause_alert_id"),
        F.col("_root.alert_name").alias("root_cause_alert_name"),
        "member_count",
        F.lit(CORRELATION_RULE).alias("correlation_rule"),
        F.col("_incident.created_ms").alias("created_at_epoch_ms"),
        F.col("_incident.created_seq").alias("created_seq"),
        F.col("event_ms").alias("updated_at_epoch_ms"),
        "alert_id", "alert_name", "dedup_key", "identity_ms", "is_first_of_alert", *ORDER,
        F.col("effective_priority").alias("alert_priority"), F.col("_root").alias("root"),
    )


def incident_changes(changes: DataFrame, chunk_ms: int = CHUNK_MS, keep: Keep = again) -> DataFrame:
    """The incident after every accepted state change.

    Members are counted here and listed by ``incident_members``, one row each, so that a row does
    not grow with its incident. (service, created_at_epoch_ms, created_seq) is the full identity.
    """
    rows = _incidents(changes, chunk_ms, keep)
    return rows.withColumns({
        "incident_id": short_id(
            "INC", F.col("service"), F.col("created_at_epoch_ms"), F.col("created_seq")),
        "title": F.format_string(
            "Degradation in %s: %s (%d alerts correlated)",
            "service", "root_cause_alert_name", "member_count"),
        "created_at": iso_instant(F.col("created_at_epoch_ms")),
        "updated_at": iso_instant(F.col("updated_at_epoch_ms")),
    })


INCIDENT = ("service", "created_at_epoch_ms", "created_seq")


def incident_members(incidents: DataFrame) -> DataFrame:
    """One row per alert of an incident, numbered in the order they joined."""
    return incidents.filter("is_first_of_alert").select(
        *INCIDENT, "incident_id", F.col("member_count").alias("member_no"), "alert_id", "alert_name",
        F.col("updated_at_epoch_ms").alias("joined_epoch_ms"),
    )


def member_pages(incidents: DataFrame, size: int = 1000) -> DataFrame:
    """The members of every incident in lists of at most ``size``, in the order they joined: (incident,
    page from 0, members), so that no row grows with its incident."""
    member = F.struct(F.col("member_count").alias("member_no"), "alert_id", "alert_name")
    page = F.floor((F.col("member_count") - 1) / size).alias("page")
    return incidents.filter("is_first_of_alert").groupBy(*INCIDENT, page).agg(
        F.array_sort(F.collect_list(member)).alias("members"))


def latest_incidents(incidents: DataFrame, per=INCIDENT, fields=None) -> DataFrame:
    """The last row of every incident, or of every service with ``per=("service",)``.

    Only ``fields`` are carried through the aggregation where they are named.
    """
    fields = [c for c in fields or incidents.columns if c not in per]
    return incidents.groupBy(*per).agg(
        F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("i")
    ).select(*per, "i.*")


def incident_records(incidents: DataFrame) -> DataFrame:
    """Incident rows in the record form, with the members so far as two parallel lists.

    Members only ever join, so the list of a row is the first ``member_count`` entries of its
    incident's final list, and rows of one incident need not meet in one task. The incidents are
    read twice; materialize them first where they are still to be worked out. The output repeats
    the list on every change; tables are better served by ``incident_members``.
    """
    entry = F.when(F.col("is_first_of_alert"), F.struct("member_count", "alert_id", "alert_name"))
    final = incidents.groupBy(*INCIDENT).agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    so_far = F.slice("_m", F.lit(1), F.col("member_count").cast("int"))
    return incidents.join(final, list(INCIDENT)).withColumn("_m", so_far).withColumns({
        "correlated_alert_ids": F.col("_m.alert_id"), "correlated_alert_names": F.col("_m.alert_name"),
    }).drop("_m")
