import json

from tidewatch import model
from tidewatch.operators import contracts

GOOD = {"paymentId": "p", "sourceAccountIban": "s", "destAccountIban": "d", "amount": 1.5, "currency": "EUR", "timestamp": 7}


def records(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq bigint, value string")


def broken(spark, contract, *values, **options):
    found = contracts.quarantine(records(spark, *values), contract, **options).collect()
    return sorted((r["seq"], r["field"], r["problem"]) for r in found)


def test_payment_contract(spark):
    without = {k: v for k, v in GOOD.items() if k != "currency"}
    assert broken(
        spark, model.PAYMENT_V1, GOOD, without, {**GOOD, "amount": "1.5"}, {**GOOD, "amount": 3},
        {**GOOD, "timestamp": 1.5}, {**GOOD, "paymentId": None}, "nope", "[1]", {**GOOD, "more": 1}, "",
    ) == [
        (1, "currency", "missing"), (2, "amount", "type"), (4, "timestamp", "type"),
        (5, "paymentId", "missing"), (6, "*", "malformed"), (7, "*", "malformed"), (9, "*", "malformed")]


def test_equity_contract(spark):
    order = {"orderId": "o", "symbol": "S", "shares": 5, "price": 1.25, "side": "BUY"}
    assert broken(
        spark, model.EQUITY_ORDER_V1, order, {**order, "shares": 3_000_000_000}, {**order, "side": 1}
    ) == [(1, "shares", "type"), (2, "side", "type")]


def test_old_records_read_with_the_new_contract(spark):
    v2 = {**GOOD, "remittanceInfo": "r", "fraudRiskScore": 0.5}
    optional = ("remittanceInfo", "fraudRiskScore")
    rows = contracts.conforming(records(spark, GOOD, v2), model.PAYMENT_V2, optional).orderBy("seq").collect()
    assert [(r["amount"], r["remittanceInfo"], r["fraudRiskScore"]) for r in rows] == [(1.5, None, None), (1.5, "r", 0.5)]
    assert broken(spark, model.PAYMENT_V2, {**v2, "fraudRiskScore": "high"}, optional=optional) == [
        (0, "fraudRiskScore", "type")]


def test_breaking_change_hits_every_record(spark):
    impact = contracts.change_impact(records(spark, GOOD, GOOD, GOOD), model.PAYMENT_BREAKING).collect()
    assert sorted(map(tuple, impact)) == [("amount", "type", 3), ("mandatoryAuditCode", "missing", 3)]


def test_versions_per_subject(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "subject string, version int")
    assert sorted(map(tuple, contracts.versions_per_subject(rows).collect())) == [("a", 2, 2, 3), ("b", 1, 1, 1)]
