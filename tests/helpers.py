"""Small fixtures: webhook texts at given times, and rows as plain tuples."""

import json
from datetime import datetime, timezone

from tidewatch.model import RAW

T0 = 1_704_067_200_000      # 2024-01-01T00:00:00Z


def iso(ms):
    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def alert(name, ms, status="firing", **labels):
    return {
        "status": status, "labels": {"alertname": name, **labels},
        "annotations": {"summary": f"{name} {status}"}, "startsAt": iso(T0 + ms), "endsAt": "0001-01-01T00:00:00Z",
    }


def webhook(*alerts, status="firing"):
    return json.dumps({"receiver": "webhook", "status": status, "alerts": list(alerts)})


def raw(spark, texts, ingest_ms=T0):
    rows = [(text, f"raw-0-{i}", i, ingest_ms) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, RAW)


def on(instance, service, severity, env="prod"):
    return dict(instance=instance, service=service, severity=severity, env=env)


def scenarios():
    """The five scenarios, one event a second."""
    cases = []
    cases += [("HighCPUUsage", "firing", on("server-prod-01", "order-service", "critical"))] * 10
    cases += [("DiskSpaceLow", s, on("storage-node-03", "storage-service", "high")) for s in ("firing", "resolved")]
    cases += [("MemoryLeakDetected", s, on("worker-node-07", "auth-service", "critical"))
              for s in ("firing", "resolved", "firing")]
    cases += [("NetworkInterfaceDrop", s, on("switch-edge-01", "network-service", "medium"))
              for s in ("firing", "resolved", "firing", "resolved", "firing")]
    cases += [
        ("DatabaseConnectionTimeout", "firing", on("db-primary-01", "payment-service", "critical")),
        ("HighHTTP5xxErrorRate", "firing", on("ingress-gateway-01", "payment-service", "high")),
        ("PodCrashLoopBackOff", "firing", on("pod-pay-core-xyz", "payment-service", "high")),
    ]
    return [webhook(alert(name, i * 1000, status, **labels), status=status)
            for i, (name, status, labels) in enumerate(cases)]


def rows(df, *columns, order=("event_ms", "seq", "alert_pos")):
    return [tuple(r) for r in df.orderBy(*order).select(*columns).collect()]
