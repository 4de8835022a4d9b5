"""Shards by a Feistel permutation of global row numbers."""

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored

ROUNDS = 6


def _round(value: Column, key: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), value), F.lit(size))


def _domain(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square rectangle of at least n cells."""
    a = max(1, isqrt(n))
    return a, max(1, -(-n // a))


def _div(value: Column, by: int) -> Column:
    """Whole quotient; exact below 2**53, as the dividend is a multiple."""
    return ((value - F.pmod(value, F.lit(by))) / by).cast("long")


def feistel(cell: Column, n: int, seed: int) -> Column:
    """A permutation of [0, a*b), a*b the domain of n: halves of sizes a and b in turn shifted by
    a hash of the other half, which can be taken back in the opposite order."""
    a, b = _domain(n)
    halves = F.struct(F.pmod(cell, F.lit(a)).alias("l"), _div(cell, a).alias("r"))
    for k in range(ROUNDS):
        key = seed * ROUNDS + k
        halves = _stage(halves, key, a, b, left=k % 2 == 0)
    return halves["r"] * F.lit(a) + halves["l"]


def _stage(halves: Column, key: int, a: int, b: int, left: bool) -> Column:
    """One round, through a one-element array so that the halves are worked out once."""
    def shifted(x: Column) -> Column:
        if left:
            return F.struct(F.pmod(x["l"] + _round(x["r"], key, a), F.lit(a)).alias("l"), x["r"].alias("r"))
        return F.struct(x["l"].alias("l"), F.pmod(x["r"] + _round(x["l"], key, b), F.lit(b)).alias("r"))
    return F.transform(F.array(halves), shifted)[0]


def _walks(spark: SparkSession, n: int, seed: int) -> int:
    """The longest walk through cells that are no row number. They are fewer than isqrt(n) + 1,
    and those that lead to another of them are followed until none is left."""
    a, b = _domain(n)
    outside, steps = spark.range(n, a * b), 0
    while not outside.isEmpty():
        outside = outside.select(feistel(F.col("id"), n, seed).alias("id")).where(F.col("id") >= n)
        steps += 1
    return steps


def permuted(number: Column, n: int, seed: int, walks: int) -> Column:
    """The place of a row number in the shuffle of n rows: cells past n are walked through."""
    place = feistel(number, n, seed)
    for _ in range(walks):
        place = F.transform(F.array(place), lambda p: F.when(p < n, p).otherwise(feistel(p, n, seed)))[0]
    return place


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with a global ``number`` from 0 in the given order, which does not depend on the
    layout of the input. Ranges are sorted apart and offset by the counts of the ranges before;
    only these counts, one per partition, meet in one place. Rows equal in ``order`` are parted
    by their place in the input, so that many of them do not land in one range."""
    place = F.monotonically_increasing_id()
    ranged = rows.withColumn("_place", place)
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(wanted, *order, "_place").sortWithinPartitions(*order, "_place").drop("_place")
    ranged = ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_in"))
    ranged = stored(ranged.withColumn("_in", F.col("_in").bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count().select(  # one row per partition
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    ranged = ranged.join(F.broadcast(starts), "_range")
    return ranged.withColumn("number", F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def shards(
    docs: DataFrame, n_shards: int = 24, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: (id, size, text_crc32, law, shard, slot, grown_shard).

    Rows are numbered by id (then size, then checksum) and shuffled by a Feistel network with cycle
    walking. Place p goes to shard ``p mod n_shards``, slot ``p div n_shards``: the law is ``rows``,
    row counts differ by one at most, slots are gapless, and shard and slot can be computed from the
    row number alone. Equal texts are not kept together. ``grown_shard`` is null under this law.

    Size is the UTF-8 length plus 8; a null text has length 0 and the checksum of no bytes. Null ids
    come first. Repeated rows are rows of their own. An empty table gives no rows.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"))
    rows = numbered(rows, "id", "size", "text_crc32")
    n = rows.count()
    place = permuted(F.col("number"), n, seed, _walks(rows.sparkSession, n, seed)) if n else F.lit(0).cast("long")
    return rows.withColumn("place", place).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(n_shards)).cast("int").alias("shard"),
        _div(F.col("place"), n_shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
