"""Record schemas and fixed values of the data model."""

from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# --- fixed values: windows and thresholds -------------------------------------------------
DEDUP_GAP_MS = 300_000          # a longer silence starts a new duplicate cycle
FLAP_WINDOW_MS = 300_000        # toggles are counted from an anchor event for this long
FLAP_TOGGLES = 3                # more toggles than this is flapping
REOPEN_MS = 600_000             # a later firing gets a new alert identity
INCIDENT_GAP_MS = 300_000       # a longer silence of a service closes its incident
VELOCITY_WINDOW_MS = 60_000     # trailing window of the burst rule
VELOCITY_COUNT = 3
HIGH_VALUE_AMOUNT = 10_000.0

# --- fixed values: labels, names and words --------------------------------------------------
SOURCE_NAME = "grafana"
EVENT_TYPE = "ALERT"
PIPELINE_VERSION = "1.0-prod"
CORRELATION_RULE = "service-temporal-fault-tree"
EMPTY_PAYLOAD_ERROR = "Empty or null alerts array in payload"
PRIORITY_BY_SEVERITY = {
    "CRITICAL": "P1", "FATAL": "P1",
    "HIGH": "P2", "ERROR": "P2",
    "MEDIUM": "P3", "WARN": "P3", "WARNING": "P3",
}
ELEVATING_ALERT_WORDS = ("database", "deadlock")
ELEVATING_SERVICE_WORDS = ("payment",)
ROOT_CAUSE_WORDS = ("database", "timeout", "connection")

# --- topics ---------------------------------------------------------------------------------
RAW_TOPIC = "events.raw"
DEAD_LETTER_TOPIC = "events.dead-letter"
NORMALIZED_TOPIC = "events.normalized"
GROUPS_TOPIC = "alert-groups"
STATE_TOPIC = "alerts.state-changes"
INCIDENT_TOPIC = "incidents.state-changes"
PAYMENT_TOPIC = "banking-payments"
LEDGER_TOPIC = "banking.public.bank_transactions"
LEDGER_ROWS_TOPIC = "banking.ledger-rows"
FRAUD_TOPIC = "fraud-alerts"

# --- record schemas -------------------------------------------------------------------------
WEBHOOK_ALERT = _struct(
    status=T.StringType(), labels=STRINGS, annotations=STRINGS,
    startsAt=T.StringType(), endsAt=T.StringType(), generatorURL=T.StringType(),
    fingerprint=T.StringType(), silenceURL=T.StringType(), dashboardURL=T.StringType(),
    panelURL=T.StringType(), valueString=T.StringType(),
)
CORRUPT = "_corrupt"
WEBHOOK = _struct(
    receiver=T.StringType(), status=T.StringType(), alerts=T.ArrayType(WEBHOOK_ALERT),
    commonLabels=STRINGS, commonAnnotations=STRINGS, **{CORRUPT: T.StringType()},
)

# A raw record: its text, a stable position and the time it was taken in.
RAW = _struct(value=T.StringType(), source_id=T.StringType(), seq=T.LongType(), ingest_ms=T.LongType())

PAYMENT_FIELDS = dict(
    paymentId=T.StringType(), sourceAccountIban=T.StringType(), destAccountIban=T.StringType(),
    amount=T.DoubleType(), currency=T.StringType(), timestamp=T.LongType(),
)
PAYMENT_V1 = _struct(**PAYMENT_FIELDS)
PAYMENT_V2 = _struct(**PAYMENT_FIELDS, remittanceInfo=T.StringType(), fraudRiskScore=T.DoubleType())
PAYMENT_BREAKING = _struct(**{**PAYMENT_FIELDS, "amount": T.StringType()}, mandatoryAuditCode=T.StringType())
EQUITY_ORDER_V1 = _struct(
    orderId=T.StringType(), symbol=T.StringType(), shares=T.IntegerType(),
    price=T.DoubleType(), side=T.StringType(),
)

# Columns that give rows of one key their order.
ORDER = ("event_ms", "seq", "alert_pos")

EVENT_RECORD = _struct(
    eventId=T.StringType(), source=T.StringType(), eventType=T.StringType(), alertName=T.StringType(),
    fingerprint=T.StringType(), status=T.StringType(), sourceSeverity=T.StringType(),
    eventTimestamp=T.StringType(), timestampEpochMs=T.LongType(), resource=STRINGS,
    service=T.StringType(), environment=T.StringType(), labels=STRINGS, annotations=STRINGS,
    testing=T.BooleanType(), deduplicationKey=T.StringType(),
)
CHANGE_RECORD = _struct(
    alertId=T.StringType(), dedupKey=T.StringType(), alertName=T.StringType(), service=T.StringType(),
    environment=T.StringType(), currentState=T.StringType(), previousState=T.StringType(),
    transition=T.StringType(), effectivePriority=T.StringType(), flapping=T.BooleanType(),
    suppressed=T.BooleanType(), occurrenceCount=T.LongType(), timestamp=T.StringType(),
    timestampEpochMs=T.LongType(), enrichedMetadata=STRINGS,
)
