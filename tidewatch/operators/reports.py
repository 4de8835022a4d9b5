"""Throughput, latency and balance reports over logs and counters, and result checks."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.plan import computed

RECORD_BYTES = 512

# --- fixed values: unit words of a producer summary line, and the form of a consumer summary ---
SENT = "records sent"
RATES = ("records/sec", "MB/sec")
LATENCIES = {
    "avg_latency_ms": "ms avg latency", "max_latency_ms": "ms max latency", "p50_latency_ms": "ms 50th",
    "p95_latency_ms": "ms 95th", "p99_latency_ms": "ms 99th",
}
PERF_FIELDS = ("records_per_sec", "mb_per_sec", *LATENCIES)
CONSUMER_HEADER = "start.time"
CONSUMER_FIELDS = (
    # place in the line, name, type
    (2, "data_consumed_mb", "double"), (3, "mb_per_sec", "double"), (4, "records_consumed", "bigint"),
    (5, "records_per_sec", "double"), (6, "rebalance_time_ms", "double"), (7, "fetch_time_ms", "double"),
    (8, "fetch_mb_per_sec", "double"), (9, "fetch_records_per_sec", "double"),
)


def producer_stats(lines: DataFrame) -> DataFrame:
    """Numbers of the producer summary lines (column ``line``); other lines are left out.

    A summary is a list of parts, each a number and its unit; the rate has a second number in
    brackets. A line that lacks one of them is no summary.
    """
    def number(unit: str) -> Column:
        part = F.get(F.filter("_parts", lambda p: p.endswith(" " + unit)), F.lit(0))
        return F.substring_index(part, " ", 1)

    rate = F.get(F.filter("_parts", lambda p: p.contains(f" {RATES[0]} (") & p.endswith(f" {RATES[1]})")), F.lit(0))
    found = {
        "records_per_sec": F.substring_index(rate, " ", 1),
        "mb_per_sec": F.substring_index(F.substring_index(rate, "(", -1), " ", 1),
        **{name: number(unit) for name, unit in LATENCIES.items()},
    }
    parts = F.when(F.col("line").contains(SENT), F.transform(F.split("line", ","), lambda p: F.trim(p)))
    rows = computed(lines.withColumn("_parts", parts), _n=F.struct(
        *[text.try_cast("double").alias(name) for name, text in found.items()],
        number(SENT).try_cast("bigint").alias("records_sent")))
    complete = F.lit(True)
    for name in PERF_FIELDS:
        complete = complete & F.col(f"_n.{name}").isNotNull()
    return rows.filter(complete).select("*", "_n.*").drop("line", "_parts", "_n")


def consumer_stats(lines: DataFrame, run: str = "run_id", line_no: str = "line_no") -> DataFrame:
    """Fields of the line that follows the header line in every run's output."""
    in_run = Window.partitionBy(run).orderBy(line_no)
    parts = F.transform(F.split("line", ","), lambda p: F.trim(p))
    rows = lines.withColumns({
        "_after_header": F.lag(F.col("line").contains(CONSUMER_HEADER)).over(in_run),
        "_parts": parts,
    }).filter(F.col("_after_header") & (F.size("_parts") >= 10))
    numbers = {n: F.get("_parts", F.lit(i)).try_cast(t) for i, n, t in CONSUMER_FIELDS}
    return rows.withColumns(numbers).drop("_after_header", "_parts", "line", line_no)


def _rate(total: Column, seconds: Column, digits: int) -> Column:
    return F.when(seconds > 0, F.round(total / seconds, digits)).otherwise(F.lit(0.0))


def totals(stats: DataFrame, seconds: Column, *by: str) -> DataFrame:
    """Sent, failed and megabytes, and their rates over the duration (0 for no duration)."""
    out = stats.groupBy(*by).agg(
        F.sum("records_sent").alias("records_sent"), F.sum("failed_records").alias("failed_records"),
        seconds.alias("duration_sec"))
    mb = F.col("records_sent") * RECORD_BYTES / (1024 * 1024)
    return out.withColumns({
        "total_mb": mb,
        "records_per_sec": _rate(F.col("records_sent"), F.col("duration_sec"), 1),
        "mb_per_sec": _rate(mb, F.col("duration_sec"), 2),
    })


def peak_topic(stats: DataFrame, *rates: str) -> DataFrame:
    """The topic with the highest rate; later rates stand in where earlier ones are null."""
    rate = F.coalesce(*rates)
    return stats.agg(
        F.max_by("topic", F.struct(rate, "topic")).alias("peak_topic"), F.max(rate).alias("peak_rate"))


def partition_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records per (topic, partition) between two offset snapshots; a new partition began at 0."""
    b = before.select("topic", "partition", F.col("offset").alias("_before"))
    return after.join(b, ["topic", "partition"], "left").select(
        "topic", "partition", (F.col("offset") - F.coalesce("_before", F.lit(0))).alias("records"))


def partition_balance(deltas: DataFrame) -> DataFrame:
    """Share of each partition in its topic and its distance from an even share."""
    of_topic = Window.partitionBy("topic")
    total = F.sum("records").over(of_topic)
    even = F.lit(1.0) / F.count(F.lit(1)).over(of_topic)
    share = F.when(total > 0, F.col("records") / total).otherwise(F.lit(0.0))
    return deltas.select(
        "topic", "partition", "records", total.alias("topic_records"),
        F.round(share, 6).alias("share"), F.round(share - even, 6).alias("deviation"),
        F.round(F.var_pop("records").over(of_topic), 4).alias("variance"))


def percentiles(rows: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles, interpolated, of ``value`` per group.

    A sketch per group first brackets every point; then the values below a bracket are only
    counted, in the tasks that read them, and just the distinct values within it are shuffled and
    put in order. A hot group is thereby never sorted as a whole: its brackets hold some thousandths
    of its rows. In a group of fewer than ``few`` rows the margin is less than two rows wide, so its
    brackets are open.
    """
    accuracy, margin, few = 10_000, 0.002, 1_000
    names = list(points)
    ends = [min(max(p + d, 0.0), 1.0) for p in points.values() for d in (-margin, margin)]
    sketch = rows.groupBy(by).agg(
        F.count(value).alias("n"), F.percentile_approx(value, ends, accuracy).alias("ends"))
    wide = F.col("n") >= few
    brackets = sketch.select(by, "n", F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("point"), ((F.col("n") - 1) * p).alias("place"),
            F.when(wide, F.col("ends")[2 * i]).alias("low"), F.when(wide, F.col("ends")[2 * i + 1]).alias("high"))
        for i, (name, p) in enumerate(points.items())])).alias("b"))
    placed = rows.select(by, value).filter(F.col(value).isNotNull()).join(brackets, by).filter(
        F.col("b.high").isNull() | (F.col(value) <= F.col("b.high")))
    below = F.coalesce(F.col(value) < F.col("b.low"), F.lit(False))
    kept = placed.groupBy(by, "n", "b.point", "b.place", F.when(~below, F.col(value)).alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    ordered = Window.partitionBy(by, "point").orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = kept.withColumn("upto", F.sum("c").over(ordered))

    def at(target: Column) -> Column:    # the value at a place counted from 0
        return F.max(F.when((F.col("upto") - F.col("c") <= target) & (target < F.col("upto")), F.col("v")))

    found = ranked.groupBy(by, "n", "point").agg(
        at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"),
        F.max(F.col("place") - F.floor("place")).alias("w"))
    exact = F.col("low") + (F.col("high") - F.col("low")) * F.col("w")
    return found.groupBy(by, "n").agg(*[
        F.max(F.when(F.col("point") == n, exact)).alias(n) for n in names])


def reconcile(planned: DataFrame, sent: DataFrame, consumed: DataFrame) -> DataFrame:
    """Planned (topic, target_records) against the records that the producers' and the consumers'
    logs tell of, per topic; a topic may lack any of them."""
    def per_topic(rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy("topic").agg(F.sum(column).alias(column))

    def missing(of: Column, have: Column) -> Column:
        return F.greatest(of - have, F.lit(0))

    rows = planned.join(per_topic(sent, "records_sent"), "topic", "full_outer").join(
        per_topic(consumed, "records_consumed"), "topic", "full_outer").na.fill(0)
    target, out, back = F.col("target_records"), F.col("records_sent"), F.col("records_consumed")
    return rows.select(
        "topic", "target_records", "records_sent", "records_consumed", missing(target, out).alias("unsent"),
        missing(out, target).alias("surplus"), missing(out, back).alias("unconsumed"),
        (target * RECORD_BYTES).alias("planned_bytes"))
