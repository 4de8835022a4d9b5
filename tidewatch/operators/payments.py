"""Payment records from flat messages and change envelopes, and the two fraud rules on them."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.plan import computed
from tidewatch.functions.text import first_of, iso_instant, last_wins, short_id
from tidewatch.model import (
    FRAUD_TOPIC, HIGH_VALUE_AMOUNT, STRINGS, VELOCITY_COUNT, VELOCITY_WINDOW_MS,
)
from tidewatch.operators.keyed import trailing_slices, trailing_sum


def _created_ms(text: Column) -> Column:
    """Epoch ms of a ledger time, given as microseconds since the epoch or as text."""
    return F.coalesce(
        F.floor(text.try_cast("bigint") / 1000), F.unix_millis(text.try_cast("timestamp")))


def unwrap(messages: DataFrame) -> DataFrame:
    """Messages (value, topic, source_id, seq, ingest_ms) with their payment record.

    The record is the ``after`` image of a change envelope, or the message itself. ``rejected``
    names why a message yields no payment: empty, not an object, a delete, or a bad amount. Of
    repeated fields the last counts. An amount may be NaN, which no rule takes for a high one.
    """
    rows = computed(messages, message=last_wins(F.from_json("value", STRINGS)))
    envelope = F.map_contains_key("message", F.lit("after"))
    rows = computed(rows, record=F.when(
        envelope, last_wins(F.from_json(F.col("message")["after"], STRINGS))).otherwise(F.col("message")))
    record = F.col("record")
    amount = F.when(~F.map_contains_key("record", F.lit("amount")), F.lit(0.0)).otherwise(
        record["amount"].try_cast("double"))
    rejected = (
        F.when(F.col("value").isNull() | (F.trim("value") == ""), "empty message")
        .when(F.col("message").isNull(), "not an object")
        .when(F.size("message") == 0, "empty message")
        .when(record.isNull(), "deleted row")
        .when(amount.isNull(), "bad amount")
    )
    return rows.select(
        "topic", "source_id", "seq", "value",
        F.coalesce(first_of(record, "transaction_id", "paymentId"), F.md5("source_id")).alias("transaction_id"),
        F.coalesce(first_of(record, "account_id", "sourceAccountIban"), F.lit("UNKNOWN")).alias("account_id"),
        amount.alias("amount"),
        F.coalesce(record["currency"], F.lit("USD")).alias("currency"),
        F.coalesce(
            record["timestamp"].try_cast("bigint"), _created_ms(record["created_at"]),
            F.col("ingest_ms")).alias("event_ms"),
        rejected.alias("rejected"),
    )


def payments(messages: DataFrame) -> DataFrame:
    return unwrap(messages).filter("rejected IS NULL").drop("rejected", "value")


def rejected_messages(messages: DataFrame) -> DataFrame:
    return unwrap(messages).filter("rejected IS NOT NULL").select(
        "topic", "source_id", "seq", "rejected", "value")


def with_velocity(
    rows: DataFrame, key: str = "account_id", width_ms: int = VELOCITY_WINDOW_MS,
    order: tuple[str, ...] = ("event_ms", "seq"),
) -> DataFrame:
    """Add ``window_count``: rows of the key less than ``width_ms`` old, up to and with the row.

    Rows with the same time count only up to their own place, as in a record-by-record run.
    """
    return trailing_sum(
        trailing_slices(rows, "event_ms", width_ms), key, order, width_ms, "window_count")


def fraud_alerts(rows: DataFrame) -> DataFrame:
    """No, one or two alerts per payment, high value first."""
    return apply_rules(with_velocity(rows))


def is_high(amount: Column, least: float = HIGH_VALUE_AMOUNT) -> Column:
    """Whether an amount reaches the limit; Spark would order NaN above it."""
    return (amount >= least) & ~F.isnan(amount)


def apply_rules(counted: DataFrame) -> DataFrame:
    """Alerts of payments that carry their ``window_count``."""
    # fixed texts of the two rules
    high = F.struct(
        F.lit(0).alias("rule_no"), F.lit("HIGH_VALUE_ANOMALY").alias("alert_type"),
        F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("Amount $"), F.format_number("amount", 2),
                 F.lit(" exceeds $10,000 compliance threshold")).alias("details"),
    )
    burst = F.struct(
        F.lit(1).alias("rule_no"), F.lit("VELOCITY_BURST_ATTACK").alias("alert_type"),
        F.lit("HIGH").alias("severity"),
        F.concat(F.col("window_count"), F.lit(" transactions in 60s window — rapid velocity attack"))
        .alias("details"),
    )
    hits = F.array_compact(F.array(
        F.when(is_high(F.col("amount")), high),
        F.when(F.col("window_count") >= VELOCITY_COUNT, burst),
    ))
    alerts = counted.select("*", F.explode(hits).alias("hit"))
    return alerts.select(
        short_id("ALT", F.col("topic"), F.col("source_id"), F.col("hit.alert_type")).alias("alert_id"),
        "transaction_id", "account_id", "amount", "currency",
        "hit.alert_type", "hit.severity", iso_instant(F.col("event_ms")).alias("timestamp"),
        "hit.details", F.col("topic").alias("source_topic"), "event_ms", "seq", "hit.rule_no",
    )


def audit_rows(messages: DataFrame, alerts_json: DataFrame) -> DataFrame:
    """Payment messages and fraud alerts in one (topic, value) stream."""
    return messages.select("topic", "value").unionByName(
        alerts_json.select(F.lit(FRAUD_TOPIC).alias("topic"), "value"))


def ledger_images(messages: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Change records as the row after them: its columns, when it changed and whether it is deleted."""
    images = F.from_json("value", "op string, ts_ms bigint, before map<string,string>, after map<string,string>")
    rows = computed(messages.select("value", "seq"), c=images).filter("c.op IS NOT NULL").select(
        last_wins(F.coalesce(F.col("c.after"), F.col("c.before")))[key].alias(key),
        last_wins(F.col("c.after")).alias("after"), F.col("c.ts_ms").alias("changed_ms"), "seq")
    return rows.select(
        key,
        F.col("after")["account_id"].alias("account_id"),
        F.col("after")["amount"].cast("decimal(15,2)").alias("amount"),
        F.col("after")["currency"].alias("currency"),
        F.col("after")["status"].alias("status"),
        "changed_ms", "seq", F.col("after").isNull().alias("deleted"))


def last_images(rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """The table that images describe: the last one per key, without deleted rows."""
    fields = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("changed_ms", "seq")).alias("r"))
    return last.filter("NOT r.deleted").select(key, *(f"r.{c}" for c in fields if c not in ("seq", "deleted")))


def current_ledger(messages: DataFrame, key: str = "transaction_id") -> DataFrame:
    """The table a change stream describes: the last image per key, without deleted rows."""
    return last_images(ledger_images(messages, key), key)
