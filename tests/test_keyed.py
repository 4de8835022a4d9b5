"""Chunks of hot keys give the same running values as one window, and both equal SQL."""

import random

import duckdb
import pandas as pd
import pytest
from helpers import T0

from tidewatch.operators import dedup, incidents, lifecycle
from tidewatch.operators.extensions import (
    quiet_flaps, scattered_withdrawals, split_late, weighted_root_election,
)
from tidewatch.operators.keyed import CHUNK_MS, carried, trailing_slices, with_context
from tidewatch.operators.payments import with_velocity
from tidewatch.plans import oracles
from pyspark.sql import functions as F

# steps between events: ties, seconds, and both sides of every limit
STEPS = [0, 1, 1000, 20_000, 60_000, 100_000, 299_999, 300_000, 300_001, 600_000, 600_001]


def random_events(seed, count=900):
    """Enriched events of a few keys; the first key has about half of them."""
    pick = random.Random(seed)
    ms, out = T0, []
    for seq in range(count):
        ms += pick.choice(STEPS) if pick.random() < 0.5 else pick.choice([0, 500, 30_000])
        key = pick.choice([0, 0, 0, 1, 2, 3])
        name = ["HighCPUUsage", "DatabaseConnectionTimeout", "DiskSpaceLow", "GatewayTimeout"][key]
        out.append((
            f"grafana:{name}:svc-{key % 2}:h{key}", name, f"svc-{key % 2}", "prod",
            pick.choice(["FIRING", "RESOLVED"]), pick.choice(["P1", "P2", "P3"]), f"EVT-{seq}",
            f"h{key}", ms, seq, pick.choice([0, 1])))
    return out


COLUMNS = (
    "deduplication_key string, alert_name string, service string, environment string, status string, "
    "effective_priority string, event_id string, rid string, event_ms bigint, seq bigint, alert_pos int")


def frame(spark, seed):
    df = spark.createDataFrame(random_events(seed), COLUMNS)
    return df.select(
        "*", F.col("rid").alias("resource_id"),
        F.col("event_ms").cast("string").alias("event_timestamp"))


def results(events, chunk_ms=CHUNK_MS):
    grouped = dedup.deduplicate(events, chunk_ms)
    changes = lifecycle.state_changes(dedup.unique_alerts(events, chunk_ms), chunk_ms).persist()
    found = incidents.incident_changes(changes, chunk_ms).persist()
    return {
        "groups": dedup.alert_groups(grouped), "unique": dedup.unique_alerts(grouped),
        "changes": changes.drop("enriched_metadata"), "incidents": found,
        "quiet": quiet_flaps(changes, F.lit(T0 + 10**12), chunk_ms), "elected": weighted_root_election(found, chunk_ms),
    }


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed", [2])
def test_any_cut_gives_the_same(spark, seed):
    events = frame(spark, seed).persist()
    whole = {name: plain(df) for name, df in results(events, 10**13).items()}
    for chunk_ms in (400_000, 7_000):
        for name, df in results(events, chunk_ms).items():
            assert plain(df) == whole[name], (name, chunk_ms)


@pytest.mark.parametrize("seed", [1, 3, 4])
def test_chunks_equal_row_by_row_sql(spark, seed):
    found = results(frame(spark, seed))
    con = duckdb.connect()
    con.register("given", pd.DataFrame(
        random_events(seed), columns=[c.split()[0] for c in COLUMNS.split(", ")]))
    canon = """canon AS (
      SELECT seq, CAST(alert_pos AS BIGINT) AS alert_pos, event_ms AS ms, alert_name, status, service, rid, environment AS env,
        CAST(event_ms AS VARCHAR) AS stamp, event_id, deduplication_key AS key, effective_priority AS priority FROM given)"""
    after = oracles.INCIDENTS.split(oracles.CANON)[1]
    con.execute("CREATE TABLE x AS WITH RECURSIVE " + canon + after + " SELECT * FROM changes")
    changes = con.execute("SELECT seq, transition, state, prev_state, alert_id, n FROM x ORDER BY seq").fetchall()
    mine = found["changes"].orderBy("seq").select(
        "seq", "transition", "current_state", "previous_state", "alert_id", "occurrence_count").collect()
    assert [tuple(r) for r in mine] == changes
    rows = con.execute(
        "WITH RECURSIVE " + canon + after
        + " SELECT seq, incident_id, title, inc_priority, root_id, member_count, updated FROM incidents ORDER BY seq"
    ).fetchall()
    mine = found["incidents"].orderBy("seq").select(
        "seq", "incident_id", "title", "priority", "root_cause_alert_id", "member_count", "updated_at_epoch_ms").collect()
    assert [tuple(r) for r in mine] == rows


def test_long_dense_toggle_chain_over_a_thousand_chunks(spark):
    """One key that never falls silent: anchors depend on each other through all chunks."""
    pick = random.Random(9)
    rows, ms = [], T0
    for seq in range(1500):
        ms += pick.choice([7_000, 40_000, 90_000])
        rows.append(("k", "Net", "svc", "prod", "FIRING" if seq % 2 else "RESOLVED", "P3", f"E{seq}", "h", ms, seq, 0))
    alerts = spark.createDataFrame(rows, COLUMNS).withColumnRenamed("rid", "resource_id")
    whole = plain(lifecycle.state_changes(alerts, 10**13).drop("enriched_metadata"))
    for chunk_ms in (CHUNK_MS, 30_000):
        assert plain(lifecycle.state_changes(alerts, chunk_ms).drop("enriched_metadata")) == whole
    assert len({r[8] // 30_000 for r in rows}) > 1000
    anchor, flips, expected = None, 0, []
    state, resolved = None, None
    for _, _, _, _, status, _, _, _, at, seq, _ in rows:     # the fold, told once more
        if anchor is None or at - anchor > 300_000:
            anchor, flips = at, 0
        flips += seq > 0
        if status == "RESOLVED":
            state, resolved = "RESOLVED", at
        else:
            state = "FLAPPING" if flips > 3 else "REOPENED" if at - resolved <= 600_000 else "OPEN"
        expected.append(state)
    got = lifecycle.state_changes(alerts).orderBy("seq").select("current_state").collect()
    assert [r[0] for r in got] == expected


@pytest.mark.parametrize("chunk_ms", [CHUNK_MS, 3_000])
def test_late_rows(spark, chunk_ms):
    pick = random.Random(3)
    data = [("a", i * 1000, i, i * 1000 - pick.choice([0, 0, 5_000, 9_000, 15_000])) for i in range(200)]
    data += [(None, i * 1000, i, i * 1000) for i in range(200)]
    df = spark.createDataFrame(data, "lane string, arrival_ms bigint, seq bigint, event_ms bigint")
    newest, expected = None, []
    for lane, _, seq, ms in data:
        if lane and newest is not None and ms < newest - 10_000:
            expected.append(seq)
        newest = ms if newest is None else max(newest, ms)
    out = split_late(df, chunk_ms=chunk_ms)
    assert out.count() == 400 and sorted(r["seq"] for r in out.filter("late").collect()) == expected


@pytest.mark.parametrize("chunk_ms", [10**9, 40, 1])
def test_running_values_against_a_loop(spark, chunk_ms):
    pick = random.Random(6)
    data = [(pick.choice("aab"), t * pick.choice([1, 1, 3]), t, pick.choice([None, t, -t]), pick.random() < 0.2) for t in range(300)]
    df = spark.createDataFrame(data, "k string, ms bigint, seq bigint, v bigint, m boolean").repartition(5)
    v = F.col("v")
    out = carried(
        df, "k", ("ms", "seq"), prev={"prev": v}, total={"total": v}, since={"since": (F.coalesce(v, F.lit(0)), F.col("m"))},
        peak={"peak": v}, first={"first": F.col("seq")}, chunk_ms=chunk_ms)
    found = {r["seq"]: tuple(r[c] for c in ("prev", "total", "since", "peak", "first")) for r in out.collect()}
    expected = {}
    for key in "ab":
        before, marked, total, since, first = [], False, None, 0, None
        for _, _, seq, value, mark in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])):
            first = seq if first is None else first
            marked, since = marked or mark, 0 if mark else since
            since += value or 0
            total = total if value is None else (total or 0) + value
            expected[seq] = (before[-1] if before else None, total, since if marked else None, max(before, default=None), first)
            before += [value] if value is not None else []
    wrong = {k: (found[k], expected[k]) for k in expected if (found[k][0], *found[k][2:]) != (expected[k][0], *expected[k][2:])}
    assert not wrong and {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in expected.items()}


def test_resources_of_a_key_in_order_of_their_coming(spark):
    rows = [("k", "N", "svc", "prod", "FIRING", "P3", f"E{n}", f"h{n * 7 % 11}", T0 + n * 90_000, n, 0) for n in range(40)]
    events = spark.createDataFrame(rows, COLUMNS).select(
        "*", F.col("rid").alias("resource_id"), F.col("event_ms").cast("string").alias("event_timestamp"))
    for chunk_ms in (10**13, 100_000):
        got = {r["seq"]: r["impacted_resources"] for r in dedup.alert_groups(dedup.deduplicate(events, chunk_ms)).collect()}
        assert got == {n: sorted({r[7] for r in rows[:n + 1]}) for n in range(40)}


def test_many_resources_of_one_key(spark):
    """The last group of a key with 100,000 resources, without working out the lists on the way."""
    events = spark.range(100_000, numPartitions=8).select(
        F.lit("k").alias("deduplication_key"), F.lit("N").alias("alert_name"), F.lit("svc").alias("service"),
        F.lit("prod").alias("environment"), F.lit("FIRING").alias("status"), F.concat(F.lit("E"), "id").alias("event_id"),
        F.concat(F.lit("h"), "id").alias("resource_id"), (F.col("id") * 10 + T0).alias("event_ms"), F.col("id").alias("seq"),
        F.lit(0).alias("alert_pos"), F.col("id").cast("string").alias("event_timestamp"))
    last = dedup.latest_groups(dedup.alert_groups(dedup.deduplicate(events)), ("occurrence_count", "status")).collect()
    assert [tuple(r) for r in last] == [("k", 100_000, "FIRING")]


def test_building_a_pipeline_starts_no_job(spark):
    events = frame(spark, 5)
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for df in results(events).values():
        df._jdf.queryExecution().executedPlan()
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_trailing_count_against_brute_force(spark):
    pick = random.Random(4)
    data, ms = [], 10**9
    for seq in range(1500):
        ms += pick.choice([0, 0, 1, 500, 20_000, 59_999, 60_000])
        data.append((f"A{pick.choice([0, 0, 0, 1, 2])}", ms, seq))
    df = spark.createDataFrame(data, "account_id string, event_ms bigint, seq bigint")
    found = {r["seq"]: r["window_count"] for r in with_velocity(df).collect()}
    expected = {
        seq: sum(1 for a, t, s in data if a == acct and s <= seq and at - t < 60_000)
        for acct, at, seq in data}
    assert found == expected


def test_places_against_brute_force(spark):
    pick = random.Random(8)
    data, ms = [], 10**9
    for seq in range(800):
        ms += pick.choice([0, 500, 8_000, 20_000, 59_999, 60_000])
        data.append((pick.choice("AAB"), pick.choice("uvwxyz"), 100.0, seq, ms))
    df = spark.createDataFrame(data, "account_id string, location string, amount double, seq bigint, event_ms bigint")
    found = {r["seq"]: r["places"] for r in scattered_withdrawals(df, 1.0).collect()}
    expected = {}
    for acct, _, _, at, now in data:
        places = {p for a, p, _, s, t in data if a == acct and s <= at and now - t < 60_000}
        if len(places) > 3:
            expected[at] = len(places)
    assert found == expected and expected


def test_slices_keep_every_row_once(spark):
    df = spark.range(1000).select((F.col("id") * 777).alias("event_ms"))
    cut = trailing_slices(df, "event_ms", 60_000)
    assert cut.filter("_own").count() == 1000
    assert cut.count() < 1300


def test_context_keeps_every_row_once(spark):
    df = spark.range(1000).select((F.col("id") * 777).alias("ms"))
    out = with_context(df, "ms", 60_000, 600_000, ahead_ms=30_000)
    assert out.filter("_own").count() == 1000 and 1000 < out.count() < 1300
