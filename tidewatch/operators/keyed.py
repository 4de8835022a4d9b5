"""Running values over the ordered rows of a key, however many rows one key has.

The rows of every key are cut by time into chunks of ``CHUNK_MS`` and each chunk is a window partition
of its own. What a chunk needs from those before it is one summary row per chunk: summaries are
combined along the key, which has as many of them as the data spans chunks of time, and are joined
back. All keys go this one way; nothing is counted beforehand and building a plan starts no job.

The rows with their running values inside a chunk are read twice, for the summaries and for the
join. ``keep`` may store them in between, so that what comes before is worked out once (``kept``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_MS = 3_600_000
CHUNK = "_chunk"


Keep = Callable[[DataFrame], DataFrame]


def again(df: DataFrame) -> DataFrame:
    """Rows that are worked out again for each reader."""
    return df


def kept(df: DataFrame) -> DataFrame:
    """Rows that are stored at their first use, for several readers.

    They are cached blocks of the session, spilled to disk, and worked out again where an executor
    is lost or after ``unpersist``, so dropping them costs time and never changes a result.
    """
    return df.persist()


def in_chunks(df: DataFrame, ms: str, chunk_ms: int = CHUNK_MS) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(ms) / chunk_ms))


def with_context(
    df: DataFrame, ms: str, back_ms: int = 0, chunk_ms: int = CHUNK_MS, ahead_ms: int = 0,
) -> DataFrame:
    """Rows in their chunk and, as context, in those that look back ``back_ms`` or ahead ``ahead_ms`` to them.

    Rows to report on have ``_own`` set. Whatever depends on rows no further away is known inside a
    chunk this way, without a summary.
    """
    own = F.floor(F.col(ms) / chunk_ms)
    seen_from, seen_to = F.floor((F.col(ms) - ahead_ms) / chunk_ms), F.floor((F.col(ms) + back_ms) / chunk_ms)
    return (
        df.withColumn("_home", own).withColumn(CHUNK, F.explode(F.sequence(seen_from, seen_to)))
        .withColumn("_own", F.col(CHUNK) == F.col("_home")).drop("_home"))


def in_chunk(key: str, order: Sequence[str]):
    """The window of a chunk, and its frames before the row and up to and with it."""
    window = Window.partitionBy(key, CHUNK).orderBy(*order)
    return (window, window.rowsBetween(Window.unboundedPreceding, -1),
            window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def chunks_before(key: str):
    """The chunks of a key before a chunk."""
    return Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def of_chunk(rows: DataFrame, entering: DataFrame, key: str) -> DataFrame:
    """Rows with what enters their chunk, a table of (_key, _of, ...) with one row per chunk."""
    return rows.join(entering, (F.col(key) == F.col("_key")) & (F.col(CHUNK) == F.col("_of"))).drop("_key", "_of")


def carried(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    prev: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    since: dict[str, tuple[Column, Column]] | None = None,
    peak: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None,
    seen: dict[str, Column] | None = None,
    chunk_ms: int = CHUNK_MS,
    keep: Keep = again,
) -> DataFrame:
    """Add running values over the rows of each key, and the chunk where rows are not cut yet.

    ``prev``: last non-null value strictly before the row; ``peak``: greatest value strictly before
    it; ``total``: sum up to and with the row; ``since``: of (value, mark), the sum from the last
    marked row up to and with the row, null before any mark; ``first``: a non-null value of the key's
    first row. Times ``order[0]`` are milliseconds; rows without a key are a key of their own.
    """
    prev, total, since, peak, first, seen = prev or {}, total or {}, since or {}, peak or {}, first or {}, seen or {}
    rows = df if CHUNK in df.columns else in_chunks(df, order[0], chunk_ms)
    _, before, upto = in_chunk(key, order)
    position = F.struct(*order)
    rows = rows.select(
        "*",
        *[F.last(c, ignorenulls=True).over(before).alias(n) for n, c in prev.items()],
        *[F.max(c).over(before).alias(n) for n, c in peak.items()],
        *[F.sum(c).over(upto).alias(n) for n, c in total.items()],
        *[F.first(c).over(upto).alias(n) for n, c in first.items()],
        *[F.collect_set(c).over(upto).alias(n) for n, c in seen.items()],
        *[F.sum(c).over(upto).alias("_t_" + n) for n, (c, _) in since.items()])
    rows = rows.select("*", *[
        F.last(F.when(mark, F.col("_t_" + n) - c), ignorenulls=True).over(upto).alias("_b_" + n)
        for n, (c, mark) in since.items()])
    rows = keep(rows)

    summary = rows.groupBy(key, CHUNK).agg(
        *[F.max_by(c, F.when(c.isNotNull(), position)).alias(n) for n, c in prev.items()],
        *[F.max(c).alias(n) for n, c in peak.items()],
        *[F.sum(c).alias(n) for n, c in total.items()],
        *[F.min_by(c, position).alias(n) for n, c in first.items()],
        *[F.array_sort(F.collect_set(c)).alias(n) for n, c in seen.items()],
        *[F.sum(c).alias("_t_" + n) for n, (c, _) in since.items()],
        *[F.max_by("_b_" + n, position).alias("_b_" + n) for n in since])
    earlier = chunks_before(key)
    summary = summary.select(
        F.col(key).alias("_key"), F.col(CHUNK).alias("_of"), key, CHUNK,
        *[F.last(n, ignorenulls=True).over(earlier).alias("_in_" + n) for n in prev],
        *[F.max(n).over(earlier).alias("_in_" + n) for n in peak],
        *[F.sum(n).over(earlier).alias("_in_" + n) for n in total],
        *[F.first(n).over(earlier).alias("_in_" + n) for n in first],
        *[F.array_distinct(F.flatten(F.collect_set(n).over(earlier))).alias("_in_" + n) for n in seen],
        *[F.coalesce(F.sum("_t_" + n).over(earlier), F.lit(0)).alias("_c_" + n) for n in since],
        *["_b_" + n for n in since])
    summary = summary.select("*", *[
        (F.col("_c_" + n) - F.last(F.col("_c_" + n) + F.col("_b_" + n), ignorenulls=True).over(earlier)).alias("_in_" + n)
        for n in since]).drop(key, CHUNK, *["_b_" + n for n in since])
    joined = of_chunk(rows, summary, key)
    combined = {
        **{n: F.coalesce(F.col(n), F.col("_in_" + n)) for n in prev},
        **{n: F.greatest(F.col(n), F.col("_in_" + n)) for n in peak},
        **{n: F.coalesce(F.col(n) + F.col("_in_" + n), n, "_in_" + n) for n in total},
        **{n: F.coalesce(F.col("_in_" + n), F.col(n)) for n in first},
        **{n: F.array_sort(F.array_union(F.col("_in_" + n), F.col(n))) for n in seen},
        **{n: F.when(F.col("_b_" + n).isNotNull(), F.col("_t_" + n) - F.col("_b_" + n)).otherwise(
            F.col("_in_" + n) + F.col("_t_" + n)) for n in since},
    }
    names = df.columns if CHUNK in df.columns else [*df.columns, CHUNK]
    return joined.select(*names, *[c.alias(n) for n, c in combined.items()])


SLICE_OF_WINDOWS = 5


def trailing_slices(df: DataFrame, ms: str, width_ms: int) -> DataFrame:
    """Put each row in its time slice and, as context, in the next one where that can see it.

    A slice is five trailing windows long, so about a fifth of the rows is doubled and a hot key
    is spread over as many tasks as it has slices. Rows to report on have ``_own`` set; the
    others only fill the window.
    """
    size = width_ms * SLICE_OF_WINDOWS
    own = F.floor(F.col(ms) / size)
    last_seen_by = F.floor((F.col(ms) + (width_ms - 1)) / size)
    return (
        df.withColumn("_home", own)
        .withColumn("_slice", F.explode(F.sequence(own, last_seen_by)))
        .withColumn("_own", F.col("_slice") == F.col("_home"))
        .drop("_home")
    )


def trailing_sum(
    sliced: DataFrame, key: str, order: Sequence[str], width_ms: int, name: str,
    enters: Column | int = 1, leaves: Column | int = 1,
) -> DataFrame:
    """Running sum over the rows of a key that are less than ``width_ms`` old, in linear time.

    ``sliced`` comes from ``trailing_slices``. A row adds ``enters`` at its own place and takes
    ``leaves`` away ``width_ms`` later, so that a running sum within the slice is the answer up to
    and with each row. A sliding frame would go through the whole window again for every row,
    which a hot key with millions of rows in a window cannot afford. Context rows and leavings are
    shuffled without their other columns.
    """
    enters = F.lit(enters) if isinstance(enters, int) else enters
    leaves = F.lit(leaves) if isinstance(leaves, int) else leaves
    size = width_ms * SLICE_OF_WINDOWS
    kept = [c for c in sliced.columns if c not in (key, "_slice", "_own")]
    rest = F.col("_rest")
    rows = sliced.select(
        key, "_slice", enters.cast("bigint").alias("_in"), leaves.cast("bigint").alias("_out"),
        F.struct(*order).alias("_place"), F.col(order[0]).alias("_at"),
        F.when(F.col("_own"), F.struct(*kept)).alias("_rest"))
    entry = F.struct(
        F.col("_at").alias("at"), F.lit(1).alias("enters"), F.col("_place").alias("place"),
        F.col("_in").alias("change"), rest.alias("row"))
    leaving = F.struct(
        (F.col("_at") + width_ms).alias("at"), F.lit(0).alias("enters"), F.col("_place").alias("place"),
        (-F.col("_out")).alias("change"), F.when(F.lit(False), rest).alias("row"))
    leaves_here = F.col("_at") + width_ms < (F.col("_slice") + 1) * size
    moves = rows.select(key, "_slice", F.explode(
        F.when(leaves_here, F.array(entry, leaving)).otherwise(F.array(entry))).alias("m"))
    running = Window.partitionBy(key, "_slice").orderBy("m.at", "m.enters", "m.place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = moves.withColumn(name, F.sum("m.change").over(running)).filter("m.row IS NOT NULL")
    wanted = [c for c in sliced.columns if c not in ("_slice", "_own")]
    return summed.select(key, "m.row.*", name).select(*wanted, name)
