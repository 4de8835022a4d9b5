import pytest
from pyspark.sql import functions as F

from tidewatch.operators import reports

LINE = (
    "10000 records sent, 13210.039630 records/sec (6.45 MB/sec), 68.57 ms avg latency, "
    "593.00 ms max latency, 68 ms 50th, 80 ms 95th, 92 ms 99th, 100 ms 99.9th.")


def test_producer_line(spark):
    lines = spark.createDataFrame([("t", LINE), ("t", "warming up"), ("t", "5 records sent, failed")], "topic string, line string")
    (row,) = reports.producer_stats(lines).collect()
    assert (row["records_sent"], row["records_per_sec"], row["mb_per_sec"]) == (10000, 13210.03963, 6.45)
    assert (row["p50_latency_ms"], row["p95_latency_ms"], row["p99_latency_ms"]) == (68, 80, 92)
    assert (row["avg_latency_ms"], row["max_latency_ms"]) == (68.57, 593)


def test_consumer_lines(spark):
    data = "2024-01-01 00:00:00:000, 2024-01-01 00:00:04:000, 4.88, 1.2, 10000, 2500.5, 3000, 1000, 4.9, 9999.5"
    rows = [(1, 0, "noise"), (1, 1, "start.time, end.time"), (1, 2, data), (1, 3, data), (2, 0, "start.time"), (2, 1, "a,b")]
    (row,) = reports.consumer_stats(spark.createDataFrame(rows, "run_id int, line_no int, line string")).collect()
    assert (row["run_id"], row["records_consumed"], row["fetch_records_per_sec"]) == (1, 10000, 9999.5)


PUBLISHED = [
    ("equities-orders", 10000, 6684.5), ("equities-trades", 20000, 12113.9), ("fi-trades", 20000, 12187.7),
    ("fi-bonds", 10000, 5730.7), ("equities-quotes", 10000, 5662.5), ("fi-settlements", 10000, 5470.5),
    ("fi-yields", 10000, 14947.7)]


def test_totals_and_peak(spark):
    rows = [(t, n, r, 0) for t, n, r in PUBLISHED]
    stats = spark.createDataFrame(rows, "topic string, records_sent bigint, records_per_sec double, failed_records bigint")
    (total,) = reports.totals(stats, F.lit(10.69)).collect()
    assert (total["records_sent"], total["failed_records"]) == (90000, 0)
    assert (total["records_per_sec"], total["mb_per_sec"]) == (8419.1, 4.11)
    (idle,) = reports.totals(stats, F.lit(0.0)).collect()
    assert (idle["records_per_sec"], idle["mb_per_sec"]) == (0, 0)
    assert reports.peak_topic(stats, "records_per_sec").first()["peak_topic"] == "fi-yields"


def test_peak_falls_back(spark):
    rows = [("a", None, 5.0), ("b", 4.0, 9.0)]
    stats = spark.createDataFrame(rows, "topic string, fetch double, rate double")
    assert tuple(reports.peak_topic(stats, "fetch", "rate").first()) == ("a", 5.0)


def test_partition_balance(spark):
    schema = "topic string, partition int, offset bigint"
    before = spark.createDataFrame([("q", 0, 100), ("q", 1, 50)], schema)
    after = spark.createDataFrame([("q", 0, 3433), ("q", 1, 3384), ("q", 2, 3333)], schema)
    rows = reports.partition_balance(reports.partition_delta(before, after)).orderBy("partition").collect()
    assert [r["records"] for r in rows] == [3333, 3334, 3333]
    assert {r["topic_records"] for r in rows} == {10000}
    assert [r["share"] for r in rows] == [0.3333, 0.3334, 0.3333]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 3.0, 1.0, 9.0, 4.5], list(map(float, range(101))),
    [float((i * 7919) % 50_021) for i in range(50_021)], [float(i % 3) for i in range(20_000)]])
def test_percentiles(spark, values):
    import numpy as np
    df = spark.createDataFrame([("t", v) for v in values], "topic string, v double")
    row = reports.percentiles(df, "topic", "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert row["n"] == len(values)
    assert [row[p] for p in ("p50", "p95", "p99")] == pytest.approx(list(np.percentile(values, [50, 95, 99])))


def test_reconcile(spark):
    planned = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "topic string, target_records bigint")
    sent = spark.createDataFrame([("a", 4), ("a", 6), ("b", 7), ("d", 3)], "topic string, records_sent bigint")
    got = spark.createDataFrame([("a", 9), ("b", 7)], "topic string, records_consumed bigint")
    rows = {r["topic"]: (r["unsent"], r["surplus"], r["unconsumed"], r["planned_bytes"])
            for r in reports.reconcile(planned, sent, got).collect()}
    assert rows == {"a": (0, 0, 1, 5120), "b": (3, 0, 0, 5120), "c": (10, 0, 0, 5120), "d": (0, 3, 3, 0)}
