"""Every hop as a stream in several micro-batches, with restarts, against its batch form."""

import json
import time

import pytest
from helpers import T0, alert, on, raw, webhook
from pyspark.sql import functions as F

from tidewatch import model
from tidewatch.operators import extensions, incidents, payments
from tidewatch.plans.alerts import AlertPipeline
from tidewatch.sources import records, sinks, streams, tables
from tidewatch.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def write_parts(df, folder, parts=3):
    """Files in order of their rows, with distinct times."""
    bounds = df.selectExpr(f"percentile(seq, array({','.join(str(i / parts) for i in range(parts + 1))}))").first()[0]
    for i in range(parts):
        upper = bounds[i + 1] if i < parts - 1 else float("inf")
        lower = bounds[i] if i else -1
        df.filter((F.col("seq") > lower) & (F.col("seq") <= upper)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)


def messages(df, topic):
    return df.select(F.lit(topic).alias("topic"), "value", "source_id", "seq", "ingest_ms")


def equal(left, right, *drop):
    columns = [c for c in right.columns if c not in drop]
    left, right = left.select(*columns), right.select(*columns)
    assert left.count() == right.count()
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_alert_hops_equal_batch(spark, tmp_path):
    texts = tables.webhooks(tables.events(spark, FOLDER))
    write_parts(messages(texts, model.RAW_TOPIC), str(tmp_path / "raw"))
    sink = sinks.TopicFolders(str(tmp_path / "out"))

    source = streams.message_files(spark, str(tmp_path / "raw"), 1)
    query = jobs.normalize_job(source, sink, str(tmp_path / "c1"), once=True)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3

    batch = AlertPipeline(texts)
    read = lambda topic: spark.read.parquet(sink.path(topic)).drop("batch")     # noqa: E731
    equal(read(model.NORMALIZED_TOPIC), batch.enriched, "labels", "annotations", "resource")
    assert read(model.DEAD_LETTER_TOPIC).count() == batch.dead_letters.count()

    # the second hop is cut off and started again from its checkpoint between micro-batches
    write_parts(read(model.NORMALIZED_TOPIC), str(tmp_path / "ordered"), 2)
    schema = read(model.NORMALIZED_TOPIC).schema
    half = sorted((tmp_path / "ordered").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    step = tmp_path / "step"
    step.mkdir()
    for file in half:
        (step / file.name).write_bytes(file.read_bytes())
        time.sleep(1.1)
        events = spark.readStream.schema(schema).parquet(str(step))
        jobs.alert_job(events, sink, str(tmp_path / "c2"), once=True).awaitTermination()
    equal(read(model.GROUPS_TOPIC), batch.groups)
    equal(read(model.STATE_TOPIC), batch.state_changes, "enriched_metadata")

    changes = jobs.topic_stream(spark, sink, model.STATE_TOPIC)
    jobs.incident_job(changes, sink, str(tmp_path / "c3"), once=True, list_members=True).awaitTermination()
    expected = incidents.incident_records(batch.incident_changes)
    found = read(model.INCIDENT_TOPIC)
    equal(found, expected)
    # ranks and remedies work on incidents of a stream as on those of a batch
    for rank in (extensions.ranked_root_causes, lambda rows: extensions.remediation_commands(incidents.latest_incidents(rows))):
        equal(rank(found), rank(batch.incident_changes))

    # what a topic of wire records would get
    wire = records.wire_json(read(model.INCIDENT_TOPIC), model.INCIDENT_TOPIC)
    equal(wire, records.incident_json(expected))
    group = json.loads(records.wire_json(read(model.GROUPS_TOPIC), model.GROUPS_TOPIC).first()[0])
    assert set(group) == {*records.GROUP_FIELDS, "latestEvent"}
    assert set(group["latestEvent"]) == set(records.EVENT_FIELDS)
    assert group["latestEvent"]["deduplicationKey"] == group["dedupKey"]
    change = json.loads(records.wire_json(read(model.STATE_TOPIC), model.STATE_TOPIC).first()[0])
    assert set(change) == set(records.CHANGE_FIELDS)


def test_fraud_hop_equals_batch(spark, tmp_path):
    rows = tables.payment_messages(tables.events(spark, FOLDER))
    write_parts(rows, str(tmp_path / "pay"), 2)
    sink = sinks.TopicFolders(str(tmp_path / "out"))
    source = streams.message_files(spark, str(tmp_path / "pay"), 1)
    jobs.fraud_job(source, sink, str(tmp_path / "c"), once=True).awaitTermination()
    found = spark.read.parquet(sink.path(model.FRAUD_TOPIC)).drop("batch")
    equal(found, payments.fraud_alerts(payments.payments(rows)))


def test_time_may_run_backwards_between_batches(spark, tmp_path):
    cpu = on("h", "svc", "low")
    sink = sinks.TopicFolders(str(tmp_path / "out"))
    for i, ms in enumerate([400_000, 0, 400_000]):
        raw(spark, [webhook(alert("Cpu", ms, **cpu))]).select(F.lit("t").alias("topic"), "*").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "raw"))
        time.sleep(1.1)
    source = streams.message_files(spark, str(tmp_path / "raw"), 1)
    jobs.normalize_job(source, sink, str(tmp_path / "c1"), once=True).awaitTermination()
    for batch in range(3):      # one micro-batch each, in order
        events = spark.read.parquet(f"{sink.path(model.NORMALIZED_TOPIC)}/batch={batch}")
        events.write.mode("append").parquet(str(tmp_path / "ev"))
        time.sleep(1.1)
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
        jobs.alert_job(stream, sink, str(tmp_path / "c2"), once=True).awaitTermination()
    groups = spark.read.parquet(sink.path(model.GROUPS_TOPIC)).orderBy("batch").collect()
    # the second is earlier and counts on; it moves the last time back, so the third is a new cycle
    assert [(g["occurrence_count"], g["last_seen_epoch_ms"] - T0) for g in groups] == [
        (1, 400_000), (2, 0), (1, 400_000)]


@pytest.mark.parametrize("status,counts", [("resolved", [1, 1]), ("firing", [1, 2])])
def test_state_of_resolved_alerts_can_expire(spark, tmp_path, status, counts):
    """With an expiry the job goes on processing time, so it is polled and stopped here."""
    sink = sinks.TopicFolders(str(tmp_path / "out"))
    batch = AlertPipeline(raw(spark, [webhook(alert("Cpu", 0, status, **on("h", "svc", "low")))]))
    schema = batch.enriched.schema
    (tmp_path / "ev").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    with pytest.raises(ValueError, match="expiry"):
        jobs.alert_job(stream, sink, str(tmp_path / "c"), once=True, ttl_ms=1)
    query = jobs.alert_job(stream, sink, str(tmp_path / "c"), ttl_ms=1)
    try:
        for seen in (1, 2):
            batch.enriched.coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
            until = time.time() + 60
            while time.time() < until and query.exception() is None:
                done = list((tmp_path / "out" / model.GROUPS_TOPIC).glob("batch=*/*.parquet"))
                if done and spark.read.parquet(*map(str, done)).count() >= seen:
                    break
                time.sleep(1)
    finally:
        query.stop()
    groups = spark.read.parquet(sink.path(model.GROUPS_TOPIC)).collect()
    assert sorted(g["occurrence_count"] for g in groups) == counts


def test_line_sink_and_source(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text('{"paymentId":"a","amount":20000}\nconsole noise\n')
    lines = streams.line_stream(spark, str(source))
    sinks.line_file_sink(lines, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert [r["value"] for r in streams.file_dump(spark, str(tmp_path / "out")).collect()] == [
        '{"paymentId":"a","amount":20000}']
    assert streams.lines(spark, str(source)).select("source_id").distinct().count() == 2


def test_equal_lines_are_different_records(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    texts = [f"line {k % 3}" for k in range(500)]
    for name in ("a.txt", "b.txt"):
        (source / name).write_text("\n".join(texts) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")      # several blocks to a file
    try:
        rows = streams.lines(spark, str(source))
        assert rows.select("source_id").distinct().count() == 1000 and rows.rdd.getNumPartitions() > 4
        found = rows.filter(F.col("source_id").contains("a.txt")).orderBy("seq").collect()
        assert [r["value"] for r in found] == texts
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, streams.lines(spark, str(source)).collect()))
        jobs.each_batch(
            streams.line_stream(spark, str(source)), lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out")),
            str(tmp_path / "c"), True).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.read.parquet(str(tmp_path / "out")).select("source_id").distinct().count() == 1000


def test_a_second_plain_write_fails(spark, tmp_path):
    sink = sinks.TopicFolders(str(tmp_path))
    sink.write(spark.range(3), "t", 0)
    with pytest.raises(FileExistsError, match="anew"):
        sink.write(spark.range(5), "t", 0)
    sink.anew().write(spark.range(5), "t", 0)
    assert sink.read(spark, "t", 0).count() == 5


def test_a_reader_sees_no_part_of_a_micro_batch(spark, tmp_path):
    """While the rows of a batch are being worked out and written, its folder does not exist."""
    sink = sinks.TopicFolders(str(tmp_path))
    sink.write(spark.range(3), "t", 0)
    seen = spark.sparkContext.accumulator(0)
    folder = str(tmp_path / "t")

    def look(batches):
        import glob
        for batch in batches:
            yield batch
            seen.add(len(glob.glob(folder + "/batch=1/*")))

    sink.write(spark.range(1000, numPartitions=6).mapInArrow(look, "id long"), "t", 1)
    assert seen.value == 0 and spark.read.parquet(sink.path("t")).count() == 1003
    assert not list((tmp_path / "t" / "_staging").iterdir())


def test_change_stream_as_a_ledger(spark, tmp_path):
    """Deletions and changes out of order, over micro-batches and a restart."""
    def change(key, op, ms, seq, amount=None):
        image = json.dumps({"transaction_id": key, "account_id": "A", "amount": str(amount), "currency": "EUR", "status": "S"})
        after, before = ("null", image) if op == "d" else (image, "null")
        return (f'{{"op":"{op}","ts_ms":{ms},"before":{before},"after":{after}}}', seq)

    batches = [
        [change("a", "c", 10, 0, 1), change("b", "c", 10, 1, 2), change("a", "u", 30, 2, 3)],
        [change("a", "u", 20, 3, 4), change("b", "d", 40, 4), change("c", "c", 5, 5, 5), change("c", "d", 6, 6), change("c", "u", 6, 7, 6)],
        [change("b", "u", 35, 8, 7), change("d", "d", 1, 9), change("e", "c", 9, 10, 8), ("not a change", 11)]]
    sink, rows = sinks.TopicFolders(str(tmp_path / "out")), None
    for part in batches:
        df = spark.createDataFrame(part, "value string, seq bigint")
        rows = df if rows is None else rows.unionByName(df)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        jobs.ledger_job(source, sink, str(tmp_path / "c"), once=True).awaitTermination()
    images = spark.read.parquet(sink.path(model.LEDGER_ROWS_TOPIC)).drop("batch")
    found, wanted = payments.last_images(images), payments.current_ledger(rows)
    equal(found, wanted)
    assert sorted(r["transaction_id"] for r in found.collect()) == ["a", "c", "e"]
    assert images.filter("transaction_id = 'a'").count() == 1 and images.filter("deleted").count() == 2


def test_audit_sink_merges_two_streams(spark, tmp_path):
    for name, text in (("pay", "payment"), ("fraud", "alert")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text(text + "\n")
    two = [streams.line_stream(spark, str(tmp_path / name)) for name in ("pay", "fraud")]
    sinks.audit_file_sink(*two, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["alert", "payment"]


def test_result_bundle(spark, tmp_path):
    results = {t: spark.createDataFrame([(f'{{"t":"{t}"}}',)], "value string") for t in ("a", "b", "c")}
    sinks.write_bundle(results, str(tmp_path / "bundle"))
    back = spark.read.text(str(tmp_path / "bundle"))
    assert sorted(map(tuple, back.select("topic", "value").collect())) == [
        (t, f'{{"t":"{t}"}}') for t in ("a", "b", "c")]


@pytest.mark.parametrize("reader", [streams.webhook_stream, streams.payment_stream])
def test_kafka_readers_need_the_kafka_source(spark, reader):
    with pytest.raises(Exception, match="(?i)kafka"):
        reader(spark, "localhost:1")
