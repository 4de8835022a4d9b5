"""Environment default, priority and published annotations."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.text import has_word
from tidewatch.model import (
    ELEVATING_ALERT_WORDS, ELEVATING_SERVICE_WORDS, PIPELINE_VERSION, PRIORITY_BY_SEVERITY,
)


def severity_priority(severity: Column) -> Column:
    level = F.upper(F.coalesce(severity, F.lit("MEDIUM")))
    out = F
    for priority in sorted(set(PRIORITY_BY_SEVERITY.values())):
        names = [name for name, p in PRIORITY_BY_SEVERITY.items() if p == priority]
        out = out.when(level.isin(names), priority)
    return out.otherwise("P4")


def effective_priority(severity: Column, alert_name: Column, service: Column) -> Column:
    """Priority by severity; P2 becomes P1 for database, deadlock and payment alerts."""
    base = severity_priority(severity)
    core = has_word(alert_name, ELEVATING_ALERT_WORDS) | has_word(service, ELEVATING_SERVICE_WORDS)
    return F.when((base == "P2") & core, "P1").otherwise(base)


def put_all(target: Column, entries: dict[str, Column]) -> Column:
    """Map with the entries put in; they replace entries of the same key."""
    added = F.create_map(*[part for k, v in entries.items() for part in (F.lit(k), v)])
    return F.map_concat(F.map_filter(target, lambda k, _: ~k.isin(list(entries))), added)


def enriched_events(events: DataFrame) -> DataFrame:
    """Canonical events with ``effective_priority`` as a column and in the annotations."""
    return (
        events.withColumns({
            "environment": F.coalesce(F.nullif("environment", F.lit("")), F.lit("dev")),
            "testing": F.lit(True),
            "effective_priority": effective_priority(
                F.col("source_severity"), F.col("alert_name"), F.col("service")),
        })
        .withColumn("annotations", put_all(F.col("annotations"), {
            "enriched_environment": F.col("environment"),
            "enriched_testing": F.lit("true"),
            "pipeline_version": F.lit(PIPELINE_VERSION),
            "effective_priority": F.col("effective_priority"),
        }))
    )
