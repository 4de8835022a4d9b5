"""The five scenarios and the branches they miss, with exact results."""

import json
import uuid

import pytest
from helpers import T0, alert, on, raw, rows, scenarios, webhook

from tidewatch.operators import results
from tidewatch.plans.alerts import AlertPipeline
from tidewatch.sources import records


@pytest.fixture(scope="module")
def five(spark):
    return AlertPipeline(raw(spark, scenarios()))


def run(spark, *alerts):
    return AlertPipeline(raw(spark, [webhook(a) for a in alerts]))


CPU = on("h1", "svc", "low")
MIN = 60_000


def test_counts(five):
    assert five.normalized.count() == 23
    assert five.dead_letters.count() == 0
    assert five.groups.count() == 23
    assert five.unique_alerts.count() == 14
    assert five.state_changes.count() == 14
    assert five.incident_changes.count() == 14


def test_latest_group_of_a_burst(five):
    latest = {r["alert_name"]: r for r in results.latest_group_per_alert(five.groups).collect()}
    cpu = latest["HighCPUUsage"]
    assert cpu["occurrence_count"] == 10
    assert cpu["group_id"] == "GRP-6F9DBC5A"
    assert (cpu["first_seen"], cpu["last_seen"]) == ("2024-01-01T00:00:00.000Z", "2024-01-01T00:00:09.000Z")


def test_normal_life_cycle(five):
    history = results.transition_history(five.state_changes, "DiskSpaceLow")
    assert rows(history, "transition", "previous_state", "current_state") == [
        ("CREATED", "NONE", "OPEN"), ("RESOLVED", "OPEN", "RESOLVED")]


def test_reopen_keeps_the_alert_id(five):
    history = results.transition_history(five.state_changes, "MemoryLeakDetected")
    assert [r[0] for r in rows(history, "transition")] == ["CREATED", "RESOLVED", "REOPENED"]
    assert history.select("alert_id").distinct().count() == 1
    reopened = results.reopened(five.state_changes).collect()
    assert {(r["times_reopened"], r["same_alert_id"]) for r in reopened} == {(1, True)}


def test_flapping(five):
    history = five.state_changes.filter("alert_name = 'NetworkInterfaceDrop'")
    assert rows(history, "transition", "current_state", "flapping") == [
        ("CREATED", "OPEN", False), ("RESOLVED", "RESOLVED", False), ("REOPENED", "REOPENED", False),
        ("RESOLVED", "RESOLVED", False), ("FLAPPING_DETECTED", "FLAPPING", True)]
    assert results.flapping(five.state_changes).count() == 1


def test_latest_incident_per_service(five):
    found = {r["service"]: r for r in results.latest_incident_per_service(five.incident_changes).collect()}
    assert {s: (r["priority"], r["member_count"], r["status"]) for s, r in found.items()} == {
        "order-service": ("P1", 1, "OPEN"), "storage-service": ("P2", 1, "OPEN"),
        "auth-service": ("P1", 1, "OPEN"), "network-service": ("P3", 1, "OPEN"),
        "payment-service": ("P1", 3, "OPEN")}
    pay = found["payment-service"]
    assert pay["root_cause_alert_name"] == "DatabaseConnectionTimeout"
    assert pay["title"] == "Degradation in payment-service: DatabaseConnectionTimeout (3 alerts correlated)"


def test_payment_alerts_are_elevated(five):
    found = dict(five.enriched.select("alert_name", "effective_priority").distinct().collect())
    assert found["HighHTTP5xxErrorRate"] == found["PodCrashLoopBackOff"] == "P1"
    assert found["DiskSpaceLow"] == "P2"


def test_root_moves_to_the_database_alert(spark):
    p = run(
        spark, alert("HighHTTP5xxErrorRate", 0, **on("a", "shop", "low")),
        alert("PodCrashLoopBackOff", 1000, **on("b", "shop", "low")),
        alert("DatabaseConnectionTimeout", 2000, **on("c", "shop", "low")),
        alert("GatewayTimeout", 3000, **on("d", "shop", "low")))
    assert rows(p.incident_changes, "root_cause_alert_name", "priority", "member_count") == [
        ("HighHTTP5xxErrorRate", "P4", 1), ("HighHTTP5xxErrorRate", "P4", 2),
        ("DatabaseConnectionTimeout", "P1", 3), ("GatewayTimeout", "P1", 4)]


@pytest.mark.parametrize("gap, count, is_new", [(300_000, 2, False), (300_001, 1, True)])
def test_gap_of_duplicates(spark, gap, count, is_new):
    p = run(spark, alert("Cpu", 0, **CPU), alert("Cpu", gap, **CPU))
    assert rows(p.deduplicated, "occurrence_count", "is_new")[1] == (count, is_new)


def test_status_flip_is_forwarded_and_counted_on(spark):
    p = run(spark, alert("Cpu", 0, **CPU), alert("Cpu", 10, "resolved", **CPU), alert("Cpu", 20, "resolved", **CPU))
    assert rows(p.deduplicated, "occurrence_count", "is_new") == [(1, True), (2, True), (3, False)]


@pytest.mark.parametrize("gap, transition, ids", [(600_000, "REOPENED", 1), (600_001, "CREATED", 2)])
def test_reopen_window(spark, gap, transition, ids):
    p = run(spark, alert("Cpu", 0, **CPU), alert("Cpu", 5, "resolved", **CPU), alert("Cpu", 5 + gap, **CPU))
    assert rows(p.state_changes, "transition")[2] == (transition,)
    assert p.state_changes.select("alert_id").distinct().count() == ids


def test_updates_holds_and_repeats(spark):
    p = run(
        spark, alert("Cpu", 0, **CPU), alert("Cpu", 6 * MIN, **CPU), alert("Cpu", 7 * MIN, "resolved", **CPU),
        alert("Cpu", 13 * MIN, "resolved", **CPU))
    assert [r[0] for r in rows(p.state_changes, "transition")] == [
        "CREATED", "UPDATED", "RESOLVED", "ALREADY_RESOLVED"]
    flips = [alert("Net", i * 1000, "firing" if i % 2 == 0 else "resolved", **CPU) for i in range(5)]
    p = run(spark, *flips, alert("Net", 6 * MIN, **CPU))
    assert [r[0] for r in rows(p.state_changes, "transition")][-2:] == ["FLAPPING_DETECTED", "FLAPPING_HELD"]


def test_first_event_resolved_opens_no_incident(spark):
    p = run(spark, alert("Cpu", 0, "resolved", **CPU))
    assert rows(p.state_changes, "transition", "previous_state", "current_state") == [("RESOLVED", "NONE", "RESOLVED")]
    assert p.incident_changes.count() == 0


def test_late_resolution_is_dropped_and_next_firing_opens(spark):
    p = run(
        spark, alert("Cpu", 0, **CPU), alert("Cpu", 6 * MIN, "resolved", **CPU),
        alert("Mem", 7 * MIN, **on("h2", "svc", "low")))
    found = rows(p.incident_changes, "created_at_epoch_ms", "member_count", "root_cause_alert_name")
    assert found == [(T0, 1, "Cpu"), (T0 + 7 * MIN, 1, "Mem")]


def test_resolution_extends_the_incident(spark):
    p = run(
        spark, alert("Cpu", 0, **CPU), alert("Cpu", 4 * MIN, "resolved", **CPU),
        alert("Mem", 8 * MIN, **on("h2", "svc", "high")))
    assert rows(p.incident_changes, "created_at_epoch_ms", "updated_at_epoch_ms", "member_count", "priority") == [
        (T0, T0, 1, "P4"), (T0, T0 + 4 * MIN, 1, "P4"), (T0, T0 + 8 * MIN, 2, "P4")]


def test_dead_letters(spark):
    good = webhook(alert("Cpu", 0, **CPU))
    with_null = good.replace('"alerts": [', '"alerts": [null, ')
    texts = ['{"alerts":[]}', "{}", "null", "not json", '{"alerts":"x"}', "", with_null, good, "[1]"]
    p = AlertPipeline(raw(spark, texts))
    found = {r["seq"]: r["error"] for r in p.dead_letters.collect()}
    assert found == {
        0: "Empty or null alerts array in payload", 1: "Empty or null alerts array in payload",
        2: found[2], 3: "Malformed webhook payload", 4: "Malformed webhook payload",
        5: "Malformed webhook payload", 6: "Null alert in payload", 8: "Malformed webhook payload"}
    assert sorted(r["seq"] for r in p.normalized.collect()) == [6, 7]
    letters = records.dead_letter_json(p.dead_letters).selectExpr("from_json(value, 'error string, raw string') r")
    assert {r[0]["raw"] for r in letters.collect()} >= {"not json", '{"alerts":[]}'}


def test_fallbacks(spark):
    texts = [
        webhook({"labels": {"alert_name": "A", "node": "n1", "app": "ap", "environment": "qa", "severity": 5}}),
        webhook({"labels": {"host": "h1", "job": "jb"}, "startsAt": "yesterday"}, status="RESOLVED"),
        webhook({"labels": {"server": "s1"}, "fingerprint": "f"}),
        webhook({"labels": {"pod": "p1", "service": "sv"}}),
        webhook({}),
    ]
    events = AlertPipeline(raw(spark, texts, ingest_ms=T0 + 7)).normalized.orderBy("seq").collect()
    assert [e["alert_name"] for e in events] == ["A"] + ["UnknownAlert"] * 4
    assert [e["service"] for e in events] == ["ap", "jb", "default-service", "sv", "default-service"]
    assert [e["resource"]["id"] for e in events] == ["n1", "h1", "s1", "p1", "cluster-resource-01"]
    assert [e["resource"]["type"] for e in events] == ["server"] * 3 + ["pod", "infrastructure"]
    assert [e["environment"] for e in events] == ["qa"] + ["dev"] * 4
    assert [e["status"] for e in events] == ["FIRING", "RESOLVED", "FIRING", "FIRING", "FIRING"]
    assert [e["source_severity"] for e in events] == ["5"] + ["MEDIUM"] * 4
    assert (events[1]["event_timestamp"], events[1]["timestamp_epoch_ms"]) == ("yesterday", T0 + 7)
    assert events[2]["fingerprint"] == "f"
    # version 3 of a name without a name space, as the standard library shows it
    import hashlib
    expected = uuid.UUID(bytes=hashlib.md5(b"UnknownAlert").digest(), version=3)
    assert events[4]["fingerprint"] == str(expected)


def test_members_in_pages(five):
    from tidewatch.operators.extensions import tickets
    from tidewatch.operators.incidents import incident_members, member_pages
    key = ("service", "created_at_epoch_ms", "created_seq")
    members = {}
    for r in incident_members(five.incident_changes).orderBy("member_no").collect():
        members.setdefault(tuple(r[c] for c in key), []).append((r["member_no"], r["alert_id"], r["alert_name"]))
    pages = member_pages(five.incident_changes, 2).collect()
    assert max(len(m) for m in members.values()) > 2 >= max(len(r["members"]) for r in pages)
    found = {}
    for r in sorted(pages, key=lambda r: r["page"]):
        found.setdefault(tuple(r[c] for c in key), []).extend(map(tuple, r["members"]))
    assert found == members
    notes = tickets(five.incident_changes, 2).collect()
    assert len(notes) == len(pages) and sum(len(json.loads(r["work_notes"])) for r in notes) == sum(map(len, members.values()))


def test_ticket_holds_all_members(spark):
    from tidewatch.operators.extensions import tickets
    row = "'svc' AS service, 0L AS created_at_epoch_ms, 0L AS created_seq, id AS event_ms, id AS seq, 0 AS alert_pos"
    changes = spark.range(2500).selectExpr(
        "'INC1' AS incident_id", *row.split(", "), "concat(id + 1, ' alerts') AS title", "'P1' AS priority", "true AS is_first_of_alert",
        "id + 1 AS member_count", "concat('A', id) AS alert_id", "concat('n', id) AS alert_name")
    (ticket,) = tickets(changes.repartition(5)).collect()
    assert (ticket["correlation_id"], ticket["short_description"]) == ("INC1", "2500 alerts")
    assert json.loads(ticket["work_notes"]) == [f"n{i}" for i in range(2500)]


def test_incident_record_lists_members(five):
    from tidewatch.operators.incidents import incident_members, incident_records
    last = incident_records(five.incident_changes).filter("service = 'payment-service'").orderBy("seq").collect()[-1]
    assert last["correlated_alert_names"] == ["DatabaseConnectionTimeout", "HighHTTP5xxErrorRate", "PodCrashLoopBackOff"]
    assert len(set(last["correlated_alert_ids"])) == 3
    numbers = incident_members(five.incident_changes).filter("service = 'payment-service'").select("member_no").collect()
    assert sorted(n[0] for n in numbers) == [1, 2, 3]


def test_record_json_uses_wire_names(five):
    import json
    change = json.loads(records.change_json(five.state_changes).first()[0])
    assert set(change) == set(records.CHANGE_FIELDS)
    group = json.loads(records.group_json(five.deduplicated).first()[0])
    assert set(group) == {*records.GROUP_FIELDS, "latestEvent"}
    assert set(group["latestEvent"]) == set(records.EVENT_FIELDS)


def test_written_topics_equal_the_lazy_tables(spark, five, tmp_path):
    from tidewatch import model
    from tidewatch.sources.sinks import TopicFolders
    sink = TopicFolders(str(tmp_path))
    AlertPipeline(raw(spark, scenarios())).write(sink)
    for topic, expected in (
        (model.GROUPS_TOPIC, five.groups), (model.STATE_TOPIC, five.state_changes.drop("enriched_metadata")),
        (model.INCIDENT_TOPIC, five.incident_changes), (model.DEAD_LETTER_TOPIC, five.dead_letters.limit(0).selectExpr("raw value")),
    ):
        found = sink.read(spark, topic, 0).select(*expected.columns)
        assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_a_sink_that_only_writes_gets_wire_records(spark):
    import json

    from tidewatch import model
    sent = {}

    class Wire:
        def write(self, rows, topic, batch_id):
            sent[topic] = [json.loads(r[0]) for r in records.wire_json(rows, topic).collect()]

    pipeline = AlertPipeline(raw(spark, scenarios()))
    before = pipeline.enriched
    pipeline.write(Wire())
    assert pipeline.enriched is before
    assert set(sent[model.GROUPS_TOPIC][0]) == {*records.GROUP_FIELDS, "latestEvent"}
    assert set(sent[model.STATE_TOPIC][0]) == set(records.CHANGE_FIELDS)
    assert set(sent[model.INCIDENT_TOPIC][0]) == set(records.INCIDENT_FIELDS)
    assert len(sent[model.NORMALIZED_TOPIC]) == before.count()


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from tidewatch.sources.sinks import TopicFolders
    sink = TopicFolders(str(tmp_path))
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "one stream")
    try:
        files = []
        for rows in (5, 5, 7):
            sink.write(spark.range(rows), "numbers", 3)
            files.append(sorted(p.name for p in (tmp_path / "numbers" / "batch=3").glob("part-*")))
        assert sink.read(spark, "numbers", 3).count() == 5 and files[0] == files[1] == files[2]
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)


def test_records_can_be_read_back(spark, five):
    """The hops can be joined by topics of wire records alone."""
    from tidewatch.operators import dedup, lifecycle

    def sent(df, order, to_json):
        values = df.orderBy(*order).coalesce(1).transform(to_json).collect()
        rows = [(v[0], i, T0) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "value string, seq bigint, ingest_ms bigint")

    events = records.events_from_wire(sent(five.enriched, ("event_ms", "seq"), records.event_json))
    changes = lifecycle.state_changes(dedup.unique_alerts(dedup.deduplicate(events)))
    assert rows(changes, "alert_id", "transition") == rows(five.state_changes, "alert_id", "transition")
    back = records.changes_from_wire(sent(changes, ("event_ms", "seq"), records.change_json))
    assert rows(back, "alert_id", "current_state", "effective_priority", "service") == rows(
        five.state_changes, "alert_id", "current_state", "effective_priority", "service")
    assert back.select("dedup_key", "identity_ms").distinct().count() == back.select("alert_id").distinct().count()


def test_a_second_batch_run_replaces_the_first(spark, tmp_path):
    from tidewatch import model
    from tidewatch.sources.sinks import TopicFolders
    sink = TopicFolders(str(tmp_path))
    pipeline = AlertPipeline(raw(spark, scenarios()))
    sink.write(pipeline.enriched.limit(0), model.NORMALIZED_TOPIC, 0)
    sink.write(pipeline.groups.limit(0), model.GROUPS_TOPIC, 0)
    pipeline.write(sink)
    assert sink.read(spark, model.NORMALIZED_TOPIC, 0).count() == pipeline.enriched.count() > 0
    assert sink.read(spark, model.GROUPS_TOPIC, 0).count() == pipeline.groups.count()


def test_a_stream_with_a_new_checkpoint_is_refused_over_an_old_root(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tidewatch.sources.sinks import TopicFolders
    from tidewatch.streaming.jobs import each_batch
    sink, folder = TopicFolders(str(tmp_path / "out")), str(tmp_path / "in")
    spark.range(5).write.parquet(folder)

    def run(checkpoint):
        rows = spark.readStream.schema("id long").parquet(folder)
        each_batch(rows, lambda df, i: sink.write(df, "t", i), str(tmp_path / checkpoint), True).awaitTermination()

    run("a")
    run("a")
    with pytest.raises(StreamingQueryException, match="another run"):
        run("b")
    spark.range(7).write.mode("append").parquet(folder)
    run("a")
    assert spark.read.parquet(sink.path("t")).count() == 12
