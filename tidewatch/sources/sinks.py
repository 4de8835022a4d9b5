"""Writers: topics as folders or Kafka topics, line files, the audit file and the result bundle."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources import records


def _place(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(*parts)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _finished(spark: SparkSession, folder: str) -> bool:
    files, mark = _place(spark, folder, "_SUCCESS")
    return files.exists(mark)


def _run_of(spark: SparkSession, note: str) -> str:
    """The run noted for a folder; "" for none, or for a write outside of streams."""
    files, path = _place(spark, note)
    if not files.exists(path):
        return ""
    stream = files.open(path)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _note_run(spark: SparkSession, note: str, run: str) -> None:
    files, path = _place(spark, note)
    stream = files.create(path, True)
    try:
        stream.writeUTF(run)
    finally:
        stream.close()


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, path = _place(spark, target)
    _, staged = _place(spark, source)
    files.delete(path, True)
    if not files.rename(staged, path):
        raise OSError(f"{source} could not be moved to {target}")


@dataclass(frozen=True)
class TopicFolders:
    """Topics as Parquet folders. A micro-batch owns one folder. A folder that its own stream has
    written whole stays as it is when its batch comes again after a restart: a hop that has read its
    files would take new ones for new rows. A folder that was left unfinished is written anew.

    Rows are written beside the topic and moved to its folder as a whole, so a reader of ``batch=*``
    sees all of a micro-batch or none of it.

    The run of a folder, the id that a stream has from its checkpoint, is noted beside it, under
    ``_runs``. A finished folder of another run is refused: batch ids begin at 0 again with a new
    checkpoint, which needs a root of its own. A write outside of streams is refused over a finished
    folder as well, unless ``anew`` lets it replace what an earlier batch run wrote."""

    root: str
    replaces: bool = False

    def anew(self) -> TopicFolders:
        return replace(self, replaces=True)

    def write(self, rows: DataFrame, topic: str, batch_id: int) -> None:
        spark = rows.sparkSession
        folder, note = f"{self.root}/{topic}/batch={batch_id}", f"{self.root}/{topic}/_runs/{batch_id}"
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        if _finished(spark, folder):
            if _run_of(spark, note) != run:
                raise FileExistsError(f"{folder} holds the rows of another run; take another root")
            if run:
                return
            if not self.replaces:
                raise FileExistsError(f"{folder} is written already; anew() replaces it")
        _note_run(spark, note, run)
        staged = f"{self.root}/{topic}/_staging/{batch_id}"
        rows.write.mode("overwrite").parquet(staged)
        _move(spark, staged, folder)

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def read(self, spark: SparkSession, topic: str, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{topic}/batch={batch_id}")


@dataclass(frozen=True)
class KafkaTopics:
    """Kafka topics, with records as JSON texts in the field names of the wire format. Delivery is
    at least once; the ids in the records are functions of the input, so a repeated record is an
    equal record."""

    servers: str

    def write(self, rows: DataFrame, topic: str, batch_id: int) -> None:
        records.wire_json(rows, topic).write.format("kafka").option("kafka.bootstrap.servers", self.servers).option(
            "topic", topic).save()


def start(writer, checkpoint: str, once: bool, every: str = "1 second") -> StreamingQuery:
    """Start a stream writer: until the present end of its source, or on and on."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def line_file_sink(values: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the ``value`` column as lines."""
    return start(
        values.select("value").writeStream.format("text").option("path", folder), checkpoint, once)


def audit_file_sink(
    messages: DataFrame, alerts_json: DataFrame, folder: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Payments and fraud alerts merged into one append-only line sink."""
    merged = messages.select("value").unionByName(alerts_json.select("value"))
    return line_file_sink(merged, folder, checkpoint, once)


def result_bundle(results: dict[str, DataFrame]) -> DataFrame:
    """Several result streams (value) as one (topic, value) table."""
    parts = [df.select(F.lit(topic).alias("topic"), "value") for topic, df in results.items()]
    bundle = parts[0]
    for part in parts[1:]:
        bundle = bundle.unionByName(part)
    return bundle


def write_bundle(results: dict[str, DataFrame], folder: str) -> None:
    """Keep the result streams under their topic names."""
    result_bundle(results).write.mode("overwrite").partitionBy("topic").text(folder)
