"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of an id's text modulo n: the fold of a document. A null id has fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(0))


def _place(spark: SparkSession) -> tuple[str, str]:
    name = f"llm_{uuid.uuid4().hex}"
    return name, f"{shared_folder(spark).rstrip('/')}/{name}"


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the folder that all executors share and go on from the files.

    Later steps read the files, so a lost executor costs its own tasks alone.
    """
    _, path = _place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """As ``stored``, in buckets of ``key``: rows that are joined on it later are not moved again."""
    spark = df.sparkSession
    name, path = _place(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def keep_rows(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, sha_col: str | None = None) -> DataFrame:
    """The documents whose id, null included, is among ``ids``, or with ``sha_col`` whose id and
    SHA-256 of the text are. Of rows that repeat an id and a text one stays."""
    def keys(df: DataFrame, sha) -> DataFrame:
        value = F.col(id_col)
        return df.withColumns({"__id": F.coalesce(value.cast("string"), F.lit("")), "__null": value.isNull(), "__sha": sha})

    wanted = keys(ids, F.col(sha_col) if sha_col else F.lit("")).select("__id", "__null", "__sha").distinct()
    rows = keys(docs, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    on = ["__id", "__null", "__sha"] if sha_col else ["__id", "__null"]
    kept = rows.join(wanted.select(*on), on, "left_semi").dropDuplicates(["__id", "__null", "__sha"])
    return kept.select(*docs.columns)


def _roots(up: DataFrame) -> DataFrame:
    """The root over every node of a forest (node, up), by pointer doubling."""
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = stored(up.join(above, "up").select(
            "node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        up = step.select("node", "up")
        if step.where("moved").isEmpty():
            return up


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), the component's smallest node.

    In a round every node points to its smallest neighbour or to itself, which makes a forest; the
    trees are contracted to their roots and the edges between roots are the next round's. Smallest
    neighbours are combined before they are shuffled and each round is a written table, so that a
    large component is never gathered in one task. Null ends and loops are ignored.
    """
    current = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    rounds = []
    while not rounds or not current.isEmpty():
        ends = current.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(
            current.select(F.col("a").alias("node"), F.col("b").alias("other")))
        up = ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("low", "node").alias("up"))
        root = _roots(stored(up))
        rounds.append(root)
        current = stored(
            current.join(root.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
            .join(root.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct())
    labels = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("up"), F.col("up").alias("top"))
        labels = earlier.join(later, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return labels.select("node", F.col("up").alias("component"))
