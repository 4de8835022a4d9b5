"""Events that carry their texts are dealt over tasks by their number."""

from pyspark.sql import functions as F

from tidewatch.plans import queries
from tidewatch.sources import tables


def test_whole_events_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 40_000).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.5).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 3, F.lit("}")).alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    few = queries.alert_groups(spark, str(tmp_path))
    expected = sorted(map(str, few.collect()))
    monkeypatch.setattr(tables, "ROWS_OF_TASK", 20)
    assert tables.events(spark, str(tmp_path)).rdd.getNumPartitions() == 20
    pipeline = queries.alert_pipeline(spark, str(tmp_path))
    kept = []
    pipeline.keep = lambda df: kept.append(df) or df
    assert pipeline.deduplicated.count() == 400
    assert [df.rdd.getNumPartitions() for df in kept] == [20]
    assert sorted(map(str, queries.alert_groups(spark, str(tmp_path)).collect())) == expected
