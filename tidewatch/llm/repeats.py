"""Counting 64-bit keys that stand in more than one place, many to a shuffled row."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKET = 2_000_000  # keys counted together, about
FLUSH = 1_000_000   # keys that a task holds before it sends them
FREQUENT = 1 << 40
NOBODY = -(1 << 63)


def key_bits(total: int) -> int:
    """Bits of the bucket: the leading 32 and these bits of a key are compared."""
    return min(24, max(6, int(np.ceil(np.log2(max(1, total) / BUCKET)))))


def repeated(
    rows: DataFrame, finder: Callable[[], Callable[[str | None], np.ndarray]], total: int,
    frequent: np.ndarray | None = None, meet: bool = False,
) -> DataFrame:
    """(row, key, times): keys of (row, text) that stand in more than one place, how often they do.

    ``finder()`` makes, in each task, a function from a text to its keys. Keys are cut to their
    leading bits (``key_bits`` of ``total``, their number), so unequal ones may fall together. The
    first bits are the bucket: a task sends one row to each bucket for some thousand texts, and a
    bucket is counted in one task. Keys in ``frequent`` are not counted and pass on with ``FREQUENT``
    times. With ``meet``, keys that repeat among the texts of one batch also pass on at once and
    only one mark of them is counted, so a very common key sends a mark for each batch.
    """
    bits = key_bits(total)
    shift = np.uint64(32 - bits)
    known = np.unique((np.zeros(0, np.uint64) if frequent is None else frequent) >> shift)

    def deal(batches):
        find = finder()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at, size, keys = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                keys.append(find(text.as_py()) >> shift)
                size += len(keys[-1])
                if size > FLUSH or i + 1 == batch.num_rows:
                    yield _dealt(ids[at:i + 1], keys, known, meet)
                    at, size, keys = i + 1, 0, []

    def count(batches):
        parts = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4))))
        for bucket, group in groupby(parts, key=lambda r: r[0]):
            if bucket < 0:
                for _, k, r, c in group:
                    key, row = np.frombuffer(k, "<i8"), np.repeat(np.frombuffer(r, "<i8"), np.frombuffer(c, "<u4"))
                    yield _counted(row, key, np.full(len(row), FREQUENT))
                continue
            group = list(group)
            low = np.concatenate([np.frombuffer(k, "<u4") for _, k, _, _ in group])
            row = np.concatenate([np.repeat(np.frombuffer(r, "<i8"), np.frombuffer(c, "<u4")) for *_, r, c in group])
            order = np.argsort(low, kind="stable")
            low, row = low[order], row[order]
            of = np.cumsum(np.concatenate([[0], low[1:] != low[:-1]]))
            # A mark stands for two places and more.
            times = (np.bincount(of) + np.bincount(of, row == NOBODY).astype(int))[of]
            some = (times > 1) & (row != NOBODY)
            yield _counted(row[some], low[some].astype(np.int64) | np.int64(bucket) << np.int64(32), times[some])

    dealt = rows.mapInArrow(deal, "bucket int, keys binary, rows binary, counts binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(max(parts, (1 << bits) // 8), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "row long, key long, times long")


def _dealt(ids: np.ndarray, keys: list[np.ndarray], known: np.ndarray, meet: bool) -> pa.RecordBatch:
    """A row for each bucket: its keys, the rows they are of and how many are of each."""
    row = np.repeat(ids.astype(np.int64), [len(k) for k in keys])
    key = np.concatenate(keys)
    bucket = (key >> np.uint64(32)).astype(np.int32)
    pass_on = -1 - int(ids[0]) % 1024
    if len(known):
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        bucket[known[place] == key] = pass_on
    if meet and len(key):
        distinct, of, times = np.unique(key, return_inverse=True, return_counts=True)
        bucket[times[of] > 1] = pass_on
        marks = distinct[times > 1]
        row = np.concatenate([row, np.full(len(marks), NOBODY)])
        key = np.concatenate([key, marks])
        bucket = np.concatenate([bucket, (marks >> np.uint64(32)).astype(np.int32)])
    order = np.argsort(bucket, kind="stable")
    bucket, key, row = bucket[order], key[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(key) else np.zeros(1, int)
    columns = [], [], [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        new = np.flatnonzero(np.concatenate([[True], row[a + 1:b] != row[a:b - 1]]))
        columns[0].append(int(bucket[a]))
        columns[1].append((key[a:b].astype("<i8") if bucket[a] < 0 else key[a:b].astype("<u4")).tobytes())
        columns[2].append(row[a:b][new].astype("<i8").tobytes())
        columns[3].append(np.diff(np.concatenate([new, [b - a]])).astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
        names=["bucket", "keys", "rows", "counts"])


def _counted(row: np.ndarray, key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int64()), pa.array(key, pa.int64()), pa.array(times.astype(np.int64))],
        names=["row", "key", "times"])
