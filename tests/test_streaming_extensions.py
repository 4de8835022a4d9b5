import random
import time

from helpers import T0
from pyspark.sql import functions as F

from tidewatch.operators import extensions as batch
from tidewatch.sources import sinks, tables
from tidewatch.streaming import extensions as streaming
from tidewatch.streaming.jobs import each_batch

FOLDER = "/root/testdata/sf0.001"


def parts(frames, folder):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)


def stream(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(spark, out, tmp_path):
    sink = sinks.TopicFolders(str(tmp_path / "out"))
    each_batch(out, lambda df, i: sink.write(df, "t", i), str(tmp_path / "c"), True).awaitTermination()
    return spark.read.parquet(sink.path("t")).drop("batch")


def test_late_rows_are_kept_apart(spark, tmp_path):
    rows = tables.arrivals(tables.events(spark, FOLDER))
    middle = rows.selectExpr("median(arrival_ms)").first()[0]
    parts([rows.filter(F.col("arrival_ms") <= middle), rows.filter(F.col("arrival_ms") > middle)], str(tmp_path / "in"))
    sink = sinks.TopicFolders(str(tmp_path / "out"))
    streaming.late_job(stream(spark, rows, str(tmp_path / "in")), sink, str(tmp_path / "c"), True).awaitTermination()
    expected = batch.split_late(rows)
    for topic, condition in ((streaming.LATE_TOPIC, "late"), (streaming.IN_TIME_TOPIC, "NOT late")):
        found = spark.read.parquet(sink.path(topic)).select("lane", "seq")
        wanted = expected.filter(condition).select("lane", "seq")
        assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


def test_cycles_close_when_time_has_passed(spark, tmp_path):
    def at(*pairs):
        return spark.createDataFrame([(k, T0 + ms) for k, ms in pairs], "deduplication_key string, event_ms bigint")

    frames = [at(("a", 0), ("a", 300_000), ("b", 10)), at(("a", 600_001), ("b", 200_000)), at(("z", 10**8))]
    parts(frames, str(tmp_path / "in"))
    out = streaming.closed_cycles(stream(spark, frames[0], str(tmp_path / "in")))
    found = {(r["dedup_key"], r["first_seen_epoch_ms"] - T0, r["occurrences"], r["closed_ms"] - T0)
             for r in collected(spark, out, tmp_path).collect()}
    assert found == {("a", 0, 2, 600_000), ("a", 600_001, 1, 900_001), ("b", 10, 2, 500_000)}


def test_quiet_flaps_clear(spark, tmp_path):
    def change(key, state, ms, seq):
        return (key, "ALT-" + key, state, T0 + ms, seq)

    schema = "dedup_key string, alert_id string, current_state string, event_ms bigint, seq bigint"
    frames = [
        spark.createDataFrame([change("a", "FLAPPING", 0, 0), change("b", "FLAPPING", 0, 1)], schema),
        spark.createDataFrame([change("b", "RESOLVED", 500_000, 2)], schema),
        spark.createDataFrame([change("z", "OPEN", 10**7, 3)], schema)]
    parts(frames, str(tmp_path / "in"))
    out = streaming.quiet_flaps(stream(spark, frames[0], str(tmp_path / "in")))
    found = [(r["dedup_key"], r["cleared_ms"] - T0) for r in collected(spark, out, tmp_path).collect()]
    assert found == [("a", 600_000)]


def test_quiet_flaps_clear_inside_a_batch(spark, tmp_path):
    schema = "dedup_key string, alert_id string, current_state string, event_ms bigint, seq bigint, alert_pos int"
    rows = [("a", "A1", "FLAPPING", T0, 0, 0), ("a", "A2", "RESOLVED", T0 + 700_000, 1, 0),
            ("b", "B1", "FLAPPING", T0, 2, 0), ("b", "B2", "FLAPPING", T0 + 600_000, 3, 0),
            ("b", "B3", "FLAPPING", T0 + 1_300_000, 4, 0)]
    frames = [spark.createDataFrame(rows, schema), spark.createDataFrame([("b", "B4", "OPEN", T0 + 5_000_000, 5, 0)], schema)]
    parts(frames, str(tmp_path / "in"))
    out = streaming.quiet_flaps(stream(spark, frames[0], str(tmp_path / "in")))
    found = sorted((r["dedup_key"], r["cleared_ms"] - T0) for r in collected(spark, out, tmp_path).collect())
    every = frames[0].unionByName(frames[1])
    wanted = batch.quiet_flaps(every, F.lit(T0)).collect()
    assert found == sorted((r["dedup_key"], r["cleared_ms"] - T0) for r in wanted)
    assert found == [("a", 600_000), ("b", 1_200_000), ("b", 1_900_000)]


def test_feedback_changes_the_status(spark, tmp_path):
    # the second and third incident share a label
    incidents = spark.createDataFrame(
        [("a", T0, 1, "INC-1"), ("b", T0, 2, "INC-2"), ("b", T0, 3, "INC-2")],
        "service string, created_at_epoch_ms bigint, created_seq bigint, incident_id string").withColumn(
        "event_ms", F.col("created_at_epoch_ms"))
    schema = "service string, created_at_epoch_ms bigint, created_seq bigint, state string, assigned_to string, event_ms bigint"
    news = spark.createDataFrame([
        ("a", T0, 1, "In Progress", "alice", T0 + 5), ("b", T0, 3, "Resolved", "eve", T0 + 5),
        ("z", T0, 9, "Resolved", "bob", T0 + 6)], schema)
    parts([incidents], str(tmp_path / "inc"))
    parts([news], str(tmp_path / "news"))
    out = streaming.incident_status(
        stream(spark, incidents, str(tmp_path / "inc")), stream(spark, news, str(tmp_path / "news")))
    found = {tuple(r) for r in collected(spark, out, tmp_path).collect()}
    assert found == {
        ("a", T0, 1, "In Progress", "alice"), ("b", T0, 2, "OPEN", None), ("b", T0, 3, "Resolved", "eve")}
    expected = batch.with_feedback(incidents, news)
    assert {tuple(r) for r in expected.drop("incident_id", "status_ms").collect()} == found


def test_maintenance_over_micro_batches_and_a_restart(spark, tmp_path):
    pick = random.Random(2)
    events, windows, sink = [], [], sinks.TopicFolders(str(tmp_path / "out"))
    known = lambda rows, name: rows.write.mode("append").parquet(str(tmp_path / name))     # noqa: E731
    event_ddl, window_ddl = "resource_id string, event_ms bigint, seq bigint, alert_pos int", "ci string, from_ms bigint, to_ms bigint"
    for part in range(3):
        begin = T0 + part * 100_000
        plans = [(f"h{pick.randrange(4)}", begin + pick.randrange(100) * 1000, 0) for _ in range(8)]
        plans = [(ci, at, at + pick.choice([1_000, 20_000, 250_000])) for ci, at, _ in plans]
        rows = [(pick.choice([f"h{pick.randrange(5)}", None]), begin + pick.randrange(100) * 1000, part * 200 + k, 0) for k in range(200)]
        events, windows = events + rows, windows + plans
        known(spark.createDataFrame(rows, event_ddl).coalesce(1), "ev")
        known(spark.createDataFrame(plans, window_ddl).coalesce(1), "win")
        read = lambda name, ddl: spark.readStream.schema(ddl).parquet(str(tmp_path / name))     # noqa: E731
        out = streaming.maintenance(read("ev", event_ddl), read("win", window_ddl))
        each_batch(out, lambda df, i: sink.write(df, "t", i), str(tmp_path / "c"), True).awaitTermination()
    found = spark.read.parquet(sink.path("t")).select("resource_id", "event_ms", "seq", "alert_pos", "maintenance")
    wanted = batch.tag_maintenance(
        spark.createDataFrame(events, event_ddl), spark.createDataFrame(windows, window_ddl)).filter("resource_id IS NOT NULL")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.select(*found.columns).collect()))
    assert 0 < found.filter("maintenance").count() < found.count()
