import json

import pytest

from tidewatch.model import FRAUD_TOPIC, LEDGER_TOPIC, PAYMENT_TOPIC
from tidewatch.operators import payments

SCHEMA = "topic string, value string, source_id string, seq bigint, ingest_ms bigint"


def messages(spark, *values, topic=PAYMENT_TOPIC):
    rows = [(topic, v if v is None or isinstance(v, str) else json.dumps(v), f"m-{i}", i, 1000)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def flat(tx, account, amount, ms=0, **more):
    return {"paymentId": tx, "sourceAccountIban": account, "amount": amount, "currency": "EUR", "timestamp": ms, **more}


def ledger(tx, account, amount, at):
    row = dict(transaction_id=tx, account_id=account, amount=amount, currency="USD", status="OK", created_at=at)
    return {"op": "c", "ts_ms": 1, "before": None, "after": row}


def test_published_cases(spark):
    at = "2024-01-01T00:00:00Z"
    rows = messages(
        spark, ledger("TX-REG", "ACC-1001", "450.00", at), ledger("TX-HIGH", "ACC-8888", "25000.00", at),
        ledger("TX-VEL1", "ACC-9999", 1200, at), ledger("TX-VEL2", "ACC-9999", 1400, at),
        ledger("TX-VEL3", "ACC-9999", 1800, at), flat("PAY-FRAUD-101", "GB29NWBK60161331926819", 18500.0))
    alerts = payments.fraud_alerts(payments.payments(rows)).orderBy("seq", "rule_no").collect()
    assert [(a["transaction_id"], a["alert_type"], a["severity"]) for a in alerts] == [
        ("TX-HIGH", "HIGH_VALUE_ANOMALY", "CRITICAL"), ("TX-VEL3", "VELOCITY_BURST_ATTACK", "HIGH"),
        ("PAY-FRAUD-101", "HIGH_VALUE_ANOMALY", "CRITICAL")]
    assert alerts[0]["details"] == "Amount $25,000.00 exceeds $10,000 compliance threshold"
    assert alerts[1]["details"] == "3 transactions in 60s window — rapid velocity attack"


def test_edges(spark):
    rows = messages(
        spark, flat("a", "A", 10000.0), {"paymentId": "b", "timestamp": 5}, flat("c", "A", "oops"),
        {"op": "d", "before": {"amount": 1}, "after": None}, None, "", "{}", "[1]", "not json",
        flat("d", "A", None), flat("e", "A", "12.5"))
    good = {p["transaction_id"]: p for p in payments.payments(rows).collect()}
    assert set(good) == {"a", "b", "e"}
    assert (good["b"]["amount"], good["b"]["account_id"], good["b"]["currency"]) == (0.0, "UNKNOWN", "USD")
    assert good["e"]["amount"] == 12.5
    bad = {r["seq"]: r["rejected"] for r in payments.rejected_messages(rows).collect()}
    assert bad == {
        2: "bad amount", 3: "deleted row", 4: "empty message", 5: "empty message", 6: "empty message",
        7: "not an object", 8: "not an object", 9: "bad amount"}
    assert payments.fraud_alerts(payments.payments(rows)).select("transaction_id").collect() == [("a",)]


@pytest.mark.parametrize("third, count", [(59_999, 3), (60_000, 2)])
def test_entry_of_sixty_seconds_is_out(spark, third, count):
    rows = messages(spark, flat("a", "A", 1, 0), flat("b", "A", 1, 1), flat("c", "A", 1, third))
    found = {r["transaction_id"]: r["window_count"] for r in payments.with_velocity(payments.payments(rows)).collect()}
    assert found["c"] == count


def test_both_rules_give_two_alerts(spark):
    rows = messages(spark, flat("a", "A", 1), flat("b", "A", 1), flat("c", "A", 20000))
    alerts = payments.fraud_alerts(payments.payments(rows)).orderBy("rule_no").collect()
    assert [(a["transaction_id"], a["alert_type"]) for a in alerts] == [
        ("c", "HIGH_VALUE_ANOMALY"), ("c", "VELOCITY_BURST_ATTACK")]
    assert len({a["alert_id"] for a in alerts}) == 2


def test_ledger_times(spark):
    rows = messages(
        spark, ledger("a", "A", 1, "1704067200123000"), ledger("b", "A", 1, "2024-01-01T00:00:00.123Z"),
        ledger("c", "A", 1, None))
    assert {r["transaction_id"]: r["event_ms"] for r in payments.payments(rows).collect()} == {
        "a": 1704067200123, "b": 1704067200123, "c": 1000}


def test_current_ledger(spark):
    def change(op, tx, amount, ts):
        image = dict(transaction_id=tx, account_id="A", amount=amount, currency="EUR", status="OK")
        return {"op": op, "ts_ms": ts, "before": None if op == "c" else image, "after": None if op == "d" else image}

    rows = messages(
        spark, change("c", "t1", "1.00", 1), change("u", "t1", "2.50", 2), change("c", "t2", "9.00", 3),
        change("d", "t2", "9.00", 4), change("u", "t3", "7", 5), "not json", topic=LEDGER_TOPIC)
    table = {r["transaction_id"]: str(r["amount"]) for r in payments.current_ledger(rows).collect()}
    assert table == {"t1": "2.50", "t3": "7.00"}


def test_audit_rows_keep_topics(spark):
    from tidewatch.sources import records
    rows = messages(spark, flat("a", "A", 20000))
    alerts = records.fraud_alert_json(payments.fraud_alerts(payments.payments(rows)))
    found = payments.audit_rows(rows, alerts).collect()
    assert sorted(r["topic"] for r in found) == [PAYMENT_TOPIC, FRAUD_TOPIC]
    alert = json.loads(next(r["value"] for r in found if r["topic"] == FRAUD_TOPIC))
    assert (alert["transactionId"], alert["sourceTopic"]) == ("a", PAYMENT_TOPIC)
