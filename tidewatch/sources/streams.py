"""Readers of webhook, payment and change streams, line files and topic dumps.

The Kafka options are kept here in one place. They need the Kafka source on the class path, which
a plain PySpark installation does not bring, so the tests run on the file forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.model import LEDGER_TOPIC, PAYMENT_TOPIC, RAW, RAW_TOPIC

PER_TRIGGER = 1_000_000


def _from_kafka(df: DataFrame) -> DataFrame:
    """Message columns from a Kafka frame; a position is unique over partitions."""
    position = F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")
    return df.select(
        "topic", F.col("value").cast("string").alias("value"),
        F.concat_ws("-", "topic", "partition", "offset").alias("source_id"),
        position.alias("seq"), F.unix_millis("timestamp").alias("ingest_ms"),
    )


def kafka_stream(
    spark: SparkSession, servers: str, topics: str, starting: str, per_trigger: int | None = PER_TRIGGER, **options
) -> DataFrame:
    """A stream of messages, at most ``per_trigger`` in a micro-batch (None: no bound), so that the
    first read of a long topic does not put all of a key's past in one."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics).option("startingOffsets", starting).options(**options)
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return _from_kafka(reader.load())


def webhook_stream(spark: SparkSession, servers: str, topic: str = RAW_TOPIC, **options) -> DataFrame:
    """The raw webhook topic from its beginning."""
    return kafka_stream(spark, servers, topic, "earliest", **options)


def payment_stream(
    spark: SparkSession, servers: str, topics: str = f"{PAYMENT_TOPIC},{LEDGER_TOPIC}", **options
) -> DataFrame:
    """Payments and ledger changes, from now on."""
    return kafka_stream(spark, servers, topics, "latest", **options)


def message_files(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of messages kept as Parquet with their positions."""
    schema = "topic string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW.fields)
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of every file block from the block's start: a line has a byte at least, so
    numbers of different blocks do not meet, and they ascend along the file."""
    block, lines = None, 0
    for batch in batches:
        numbers = []
        for at in zip(batch["path"].to_pylist(), batch["block_start"].to_pylist()):
            block, lines = (block, lines + 1) if at == block else (at, 0)
            numbers.append(at[1] + lines)
        yield pa.RecordBatch.from_arrays(
            [batch["value"], batch["path"], pa.array(numbers, pa.int64()), batch["ingest_ms"]],
            names=["value", "path", "seq", "ingest_ms"])


def _lines(rows: DataFrame) -> DataFrame:
    at = rows.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.unix_millis("_metadata.file_modification_time").alias("ingest_ms"))
    numbered = at.mapInArrow(_numbered, "value string, path string, seq bigint, ingest_ms bigint")
    return numbered.select("value", F.concat_ws("#", "path", "seq").alias("source_id"), "seq", "ingest_ms")


def line_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of text files, one record per line.

    A line is known by its file and ``seq``, its number counted from the start of its block of the
    file, so that equal lines are different records. Blocks are those of ``spark.sql.files.maxPartitionBytes``.
    """
    reader = spark.readStream
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return _lines(reader.text(folder))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of text files, known as in ``line_stream``."""
    return _lines(spark.read.text(folder))


def ledger_snapshot(
    spark: SparkSession, url: str, table: str = "public.bank_transactions", *,
    split_by: str, lower: str, upper: str, splits: int, **options,
) -> DataFrame:
    """The ledger table itself, read in ``splits`` ranges of the column ``split_by``."""
    return (
        spark.read.format("jdbc").options(
            url=url, dbtable=table, partitionColumn=split_by, lowerBound=lower, upperBound=upper,
            numPartitions=str(splits), **options)
        .load()
    )


def only_json(rows: DataFrame) -> DataFrame:
    """Lines that hold a record; a console dump mixes them with messages."""
    return rows.filter(F.trim("value").startswith("{"))


def topic_dump(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """A topic from its beginning to its present end, records only."""
    df = (
        spark.read.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest")
        .option("endingOffsets", "latest").options(**options).load()
    )
    return only_json(_from_kafka(df))


def file_dump(spark: SparkSession, folder: str) -> DataFrame:
    return only_json(spark.read.text(folder))
