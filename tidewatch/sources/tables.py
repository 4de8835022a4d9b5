"""Views of the supplied tables as the streams the operators work on.

The tables hold no alerts, payments or access logs, so these are derived, row by row and from
whole tables, from ``events(event_id, ts, user_id, event_type, value, props)``. Time runs
``COMPRESSION`` times faster than in the table, so that events of one alert meet in one window.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.plan import computed
from tidewatch.functions.text import iso_instant

COMPRESSION = 20
ALERT_BY_TYPE = {
    "error": "DatabaseConnectionTimeout", "click": "HighCPUUsage", "view": "HighHTTP5xxErrorRate",
    "purchase": "PodCrashLoopBackOff",
}
OTHER_ALERT = "DiskSpaceLow"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ROWS_OF_TASK = 50_000   # events that one task makes into texts


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """The supplied tables are single splits; deal such rows out over all cores."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 >= wanted:
        return df
    return df.repartition(wanted, *keys)


def event_tasks(spark: SparkSession, folder: str) -> int:
    """Tasks for events that carry their texts. An event of a few bytes in its file is the better part
    of a kilobyte then, so a split of the file is too much for one task; their number is that of the rows."""
    return -(-table(spark, folder, "events").count() // ROWS_OF_TASK)


def events(spark: SparkSession, folder: str, texts: bool = True) -> DataFrame:
    """The events with ``ts_ms`` (compressed) and ``k``, the number in their properties.

    Where ``texts`` are made of them and parsed, a table of few splits is spread over the cores, and
    a table of many rows over as many tasks as ``event_tasks`` says.
    """
    rows = table(spark, folder, "events")
    if texts:
        tasks = event_tasks(spark, folder)
        many = tasks > spark.sparkContext.defaultParallelism
        rows = rows.repartition(tasks, "event_id") if many else _spread(rows, "event_id")
    return rows.select(
        "event_id", "user_id", "event_type", "value",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1000 * COMPRESSION)).alias("ts_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _choose(column: Column, values: dict[str, str], default: str) -> Column:
    out = F
    for key, value in values.items():
        out = out.when(column == key, value)
    return out.otherwise(default)


def webhooks(rows: DataFrame) -> DataFrame:
    """Every event as a webhook text. The user decides service and host and under which labels
    they are given; some values of ``k`` give empty, cut-off, null-bearing and two-alert texts, and texts
    that repeat a key."""
    b, k = F.col("user_id") % 5, F.col("k")
    name = _choose(F.col("event_type"), ALERT_BY_TYPE, OTHER_ALERT)
    status = F.when(k % 2 == 0, "resolved").otherwise("firing")
    starts = iso_instant(F.col("ts_ms"))
    host, service = F.concat(F.lit("host-"), b), F.concat(F.lit("svc-"), b)
    severity = (
        F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "high")
        .when(F.col("value") >= 10, "warning").when(F.col("value") >= 5, "info")
    )

    def alert(named: Column) -> Column:
        return F.struct(
            F.when(k % 10 != 4, status).alias("status"),
            F.struct(
                F.when((b != 3) & (k != 99), named).alias("alertname"),
                F.when((b == 3) & (k != 99), named).alias("alert_name"),
                F.when(b == 0, host).alias("instance"), F.when(b == 1, host).alias("node"),
                F.when(b == 2, host).alias("host"), F.when(b == 3, host).alias("pod"),
                F.when(b == 0, "payment-service").when(b == 3, service).alias("service"),
                F.when(b == 1, service).alias("app"), F.when(b == 2, service).alias("job"),
                F.when(b == 0, "prod").alias("env"), F.when(b == 1, "staging").alias("environment"),
                F.when(b < 2, "prod-us-east-1").alias("t_cluster"),
                F.when(b == 2, "payments").alias("k8s_namespace"),
                severity.alias("severity"),
            ).alias("labels"),
            F.struct(
                F.concat(F.lit("event "), F.col("event_id")).alias("summary")
            ).alias("annotations"),
            F.when(k == 97, "not a time").otherwise(iso_instant(F.col("ts_ms"))).alias("startsAt"),
            F.when(F.col("event_type") != "view", F.concat(F.lit("fp-"), F.col("user_id")))
            .alias("fingerprint"),
        )

    # the text is written once per row and then varied, so the plan holds one copy of it
    alerts = F.when(k == 16, F.array(alert(name), alert(F.lit(OTHER_ALERT)))).otherwise(F.array(alert(name)))
    text = F.to_json(F.struct(
        F.lit("webhook").alias("receiver"), status.alias("status"), alerts.alias("alerts")))
    varied = (
        F.when(k.isin(13, 63), F.lit('{"receiver":"webhook","alerts":[]}'))
        .when(k == 14, F.substring("text", 1, 40))
        .when(k == 15, F.regexp_replace("text", r'"alerts":\[', '"alerts":[null,'))
        .when(k == 17, F.regexp_replace("text", r'"annotations":[{]', '"annotations":{"summary":"older",'))
        .when((k == 18) & severity.isNotNull(), F.regexp_replace("text", r'"labels":[{]', '"labels":{"severity":"older",'))
        .otherwise(F.col("text"))
    )
    return computed(rows, text=text).select(
        varied.alias("value"),
        F.concat(F.lit("events-0-"), F.col("event_id")).alias("source_id"),
        F.col("event_id").alias("seq"),
        F.col("ts_ms").alias("ingest_ms"),
    )


def _messages(rows: DataFrame, topic: Column, value: Column) -> DataFrame:
    return rows.select(
        topic.alias("topic"), value.alias("value"),
        F.concat(F.lit("events-0-"), F.col("event_id")).alias("source_id"),
        F.col("event_id").alias("seq"), F.col("ts_ms").alias("ingest_ms"),
    )


def payment_messages(rows: DataFrame) -> DataFrame:
    """Every event as a payment text: a quarter as change envelopes, the others flat. Some values
    of ``k`` give deletes, missing and repeated fields, text amounts and texts that are no payment."""
    k = F.col("k")
    account = F.concat(F.lit("ACC-"), F.col("user_id") % 25)
    tx = F.concat(F.lit("TX-"), F.col("event_id"))
    amount = F.round(F.col("value") * 100)
    created = F.when(k % 8 == 0, (F.col("ts_ms") * 1000).cast("string")).otherwise(
        iso_instant(F.col("ts_ms")))
    envelope = F.to_json(F.struct(
        F.when(k == 96, "d").otherwise("c").alias("op"), F.col("ts_ms"),
        F.when(k != 96, F.struct(
            tx.alias("transaction_id"), account.alias("account_id"), amount.alias("amount"),
            F.lit("EUR").alias("currency"), F.lit("BOOKED").alias("status"),
            created.alias("created_at"),
        )).alias("after"),
    ), {"ignoreNullFields": "false"})
    flat = F.to_json(F.struct(
        tx.alias("paymentId"),
        F.when(k != 39, account).alias("sourceAccountIban"),
        F.lit("ACC-DEST").alias("destAccountIban"),
        F.when(~k.isin(33, 35), amount).alias("amount"),
        F.when(k != 37, "GBP").alias("currency"),
        F.col("ts_ms").alias("timestamp"),
    ))
    text = (
        F.when(k % 4 == 0, envelope)
        .when(k == 35, F.regexp_replace(flat, "^[{]", '{"amount":"oops",'))
        .when(k == 45, F.regexp_replace(flat, r'"amount":[^,]+', '"amount":"NaN"'))
        .when(k == 47, F.regexp_replace(flat, "^[{]", '{"amount":99999,'))
        .when(k == 41, "{}").when(k == 43, "[1,2]").otherwise(flat)
    )
    topic = F.when(k % 4 == 0, "banking.public.bank_transactions").otherwise("banking-payments")
    return _messages(rows, topic, text)


LEDGER_OPS = {"error": "d", "signup": "c"}


def ledger_changes(rows: DataFrame) -> DataFrame:
    """Every event as a change of its user's ledger row; an error deletes the row."""
    op = _choose(F.col("event_type"), LEDGER_OPS, "u")
    image = F.struct(
        F.concat(F.lit("U-"), F.col("user_id")).alias("transaction_id"),
        F.concat(F.lit("ACC-"), F.col("user_id") % 25).alias("account_id"),
        F.col("value").alias("amount"), F.lit("EUR").alias("currency"),
        F.col("event_type").alias("status"),
    )
    value = F.to_json(F.struct(
        op.alias("op"), F.col("ts_ms"),
        F.when(op != "c", image).alias("before"), F.when(op != "d", image).alias("after"),
    ), {"ignoreNullFields": "false"})
    return _messages(rows, F.lit("banking.public.bank_transactions"), value)


IDENTITIES = [
    # principal, group
    ("User:admin", "Kafka_Admins"), ("team-a-reader", "TeamA_Readers"),
    ("User:team-a-writer", "TeamA_Writers"), ("team-a-manager", "TeamA_ResourceManagers"),
    ("equities-reader", "Equities_Readers"), ("User:equities-writer", "Equities_Writers"),
    ("equities-manager", "Equities_ResourceManagers"), ("User:fi-reader", "FI_Readers"),
    ("fi-writer", "FI_Writers"), ("u-11", "TeamB_Readers"), ("u-12", None),
]
OPERATIONS = ["READ", "WRITE", "CREATE", "DELETE", "ALTER", "DESCRIBE", "ALTER_CONFIGS", "DESCRIBE_CONFIGS"]
RESOURCES = [
    "team-a-orders", "team-b-inventory", "equities-trades", "equities-quotes", "fi-bonds",
    "fi-yields", "Team-A-returns",
]


def _pick(values: list, place: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def access_requests(rows: DataFrame) -> DataFrame:
    """Every event as an access request; user, type and ``k`` decide who asks for what."""
    k, who = F.col("k"), F.col("user_id") % len(IDENTITIES)
    group = _pick([g for _, g in IDENTITIES], who)
    return rows.select(
        F.col("event_id").alias("request_id"),
        _pick([p for p, _ in IDENTITIES], who).alias("principal"),
        F.when(k == 98, "REPLICATION").otherwise("CLIENT").alias("listener"),
        F.when(group.isNotNull(), F.array(group)).alias("groups"),
        F.when(k == 95, F.array(F.lit("SystemAdmin"))).alias("roles"),
        _pick(OPERATIONS, k % len(OPERATIONS)).alias("operation"),
        _pick(RESOURCES, (k + F.col("user_id")) % len(RESOURCES)).alias("resource"),
        _choose(F.col("event_type"), {"signup": "CLUSTER", "error": "GROUP"}, "TOPIC").alias("resource_type"),
    )


def payment_records(rows: DataFrame) -> DataFrame:
    """Every event as a payment contract record; some values of ``k`` break one field."""
    k = F.col("k")
    text = F.to_json(F.struct(
        F.concat(F.lit("PAY-"), F.col("event_id")).alias("paymentId"),
        F.concat(F.lit("IBAN-"), F.col("user_id")).alias("sourceAccountIban"),
        F.when(k != 21, "IBAN-DEST").alias("destAccountIban"),
        F.col("value").alias("amount"),
        F.when(k % 30 != 2, "EUR").alias("currency"),
        F.col("ts_ms").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("invoice "), k)).alias("remittanceInfo"),
        F.when(F.col("event_type") == "purchase", k / 100).alias("fraudRiskScore"),
    ))
    value = (
        F.when(k == 22, F.regexp_replace(text, r'"amount":([\d.]+)', '"amount":"$1"'))
        .when(k == 23, F.regexp_replace(text, r'"timestamp":\d+', '"timestamp":"soon"'))
        .when(k == 24, F.regexp_replace(text, r'"paymentId":"PAY-', '"paymentId":7,"was":"'))
        .when(k == 25, F.substring(text, 1, 30))
        .when(k == 26, F.regexp_replace(text, r'"sourceAccountIban":"[^"]*"', '"sourceAccountIban":null'))
        .otherwise(text)
    )
    return rows.select(
        F.col("event_id").alias("seq"), F.lit("banking-payments-value").alias("subject"),
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("version"), value.alias("value"))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _spread(table(spark, folder, "lineitem"), "l_orderkey")


def equity_orders(lineitem: DataFrame) -> DataFrame:
    """Every order line as an equity order record; some quantities break one field."""
    text = F.to_json(F.struct(
        F.concat_ws("-", F.lit("ORD"), "l_orderkey", "l_linenumber").alias("orderId"),
        F.concat(F.lit("SYM-"), F.col("l_suppkey")).alias("symbol"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity").cast("int")).alias("shares"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
    ))
    value = F.when(
        F.col("l_quantity") == 17, F.regexp_replace(text, r'"shares":(\d+)', '"shares":$1.5')
    ).when(
        F.col("l_quantity") == 19, F.regexp_replace(text, r'"side":"[A-Z]+"', '"side":1')
    ).otherwise(text)
    return lineitem.select("l_orderkey", "l_linenumber", value.alias("value"))


def producer_lines(rows: DataFrame) -> DataFrame:
    """Every event as a producer summary line; ``k`` = 7 gives a line of another form."""
    k, value = F.col("k"), F.col("value").cast("string")
    line = F.concat(
        k * 100, F.lit(" records sent, "), value, F.lit(" records/sec ("), k, F.lit(".25 MB/sec), "),
        value, F.lit(" ms avg latency, "), k * 10, F.lit(".00 ms max latency, "), k,
        F.lit(" ms 50th, "), k + 5, F.lit(" ms 95th, "), k + 9, F.lit(" ms 99th, "), k + 20,
        F.lit(" ms 99.9th."),
    )
    return rows.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("topic"), "ts_ms",
        F.when(k == 11, 5).otherwise(0).cast("bigint").alias("failed_records"),
        F.when(k == 7, "org.apache.kafka.common.errors.TimeoutException: records sent late")
        .otherwise(line).alias("line"),
    )


CONSUMER_HEADER_LINE = (
    "start.time, end.time, data.consumed.in.MB, MB.sec, data.consumed.in.nMsg, nMsg.sec, "
    "rebalance.time.ms, fetch.time.ms, fetch.MB.sec, fetch.nMsg.sec"
)


def consumer_lines(rows: DataFrame) -> DataFrame:
    """Every event as the lines of a consumer run; ``k`` = 8 has a warning after the header."""
    k, value = F.col("k"), F.col("value").cast("string")
    data = F.concat_ws(
        ", ", F.lit("2024-01-01 00:00:00:000"), F.lit("2024-01-01 00:00:10:000"), value, value,
        k * 100, value, k, k + 10, value, value)
    lines = F.when(
        k == 8, F.array(F.lit(CONSUMER_HEADER_LINE), F.lit("WARN rebalance in progress"), data)
    ).otherwise(F.array(F.lit("starting"), F.lit(CONSUMER_HEADER_LINE), data))
    return rows.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("topic"),
        F.posexplode(lines).alias("line_no", "line"))


def offsets(rows: DataFrame) -> DataFrame:
    """End offsets per topic and partition of a topic that holds the rows."""
    return rows.groupBy(
        F.col("event_type").alias("topic"), (F.col("event_id") % 3).alias("partition")
    ).agg(F.count(F.lit(1)).alias("offset"))


def configuration_items(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers, nations and regions as configuration items with their parents: a supplier
    depends on its nation's host, a host on its region's zone."""
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("app-"), F.col("s_suppkey")).alias("ci"),
        F.concat(F.lit("host-"), F.col("s_nationkey")).alias("parent"), F.col("s_name").alias("ci_name"))
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("host-"), F.col("n_nationkey")).alias("ci"),
        F.concat(F.lit("zone-"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("ci_name"))
    regions = table(spark, folder, "region").select(
        F.concat(F.lit("zone-"), F.col("r_regionkey")).alias("ci"),
        F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("ci_name"))
    return suppliers.unionByName(nations).unionByName(regions)


def maintenance_windows(rows: DataFrame) -> DataFrame:
    """Signups as maintenance of the user's host, from then on for as many minutes as ``k`` says."""
    return rows.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("host-"), F.col("user_id") % 5).alias("ci"),
        F.col("ts_ms").alias("from_ms"), (F.col("ts_ms") + F.col("k") * 60_000).alias("to_ms"))


def arrivals(rows: DataFrame) -> DataFrame:
    """Events in the order they arrive at their lane: some are a minute late."""
    delay = F.when(F.col("k") == 50, 60_000).otherwise(0)
    return rows.select(
        F.concat(F.lit("lane-"), F.col("user_id") % 5).alias("lane"),
        (F.col("ts_ms") + delay).alias("arrival_ms"), F.col("event_id").alias("seq"),
        F.col("ts_ms").alias("event_ms"))


def withdrawals(rows: DataFrame) -> DataFrame:
    """Every event as a withdrawal of its user's account, at a place given by ``k``. Time runs ten
    times faster again, and amounts are twenty times the payments', so that places meet."""
    return rows.select(
        F.concat(F.lit("ACC-"), F.col("user_id") % 25).alias("account_id"),
        F.concat(F.lit("place-"), F.col("k") % 10).alias("location"),
        F.round(F.col("value") * 2000).alias("amount"), F.col("event_id").alias("seq"),
        F.floor(F.col("ts_ms") / 10).alias("event_ms"))
