"""Removal of lines that an earlier document holds, by two Bloom filters and an exact confirmation."""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .repeats import FLUSH, NOBODY, _dealt, key_bits
from .suffix_dedup import _ordered

WHITE = b" \t\n\x0b\x0c\r"
PLACES = 8   # places of a filter for each of its keys, at least
HASHES = 3   # places that a key takes
TOGETHER = 50_000


class Bloom:
    """A Bloom filter of 32-bit keys: no key that was added is denied."""

    def __init__(self, keys: int):
        self.bits = max(10, int(np.ceil(np.log2(max(1, keys) * PLACES))))
        self.marks = np.zeros(1 << self.bits, bool)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """An array of ``HASHES`` rows: the places of each key."""
        mixed = (keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        step = (mixed * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        shift = np.uint64(64 - self.bits)
        return np.stack([((mixed + np.uint64(k) * step) * np.uint64(0x94D049BB133111EB)) >> shift for k in range(HASHES)])

    def add(self, places: np.ndarray) -> None:
        self.marks[places] = True

    def holds(self, places: np.ndarray) -> np.ndarray:
        return self.marks[places].all(axis=0)


def keys_of(data: bytes, least: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has ``least`` code points or more."""
    found = []
    for no, line in enumerate(data.split(b"\n")):
        key = line.strip(WHITE).lower()  # of bytes: A-Z alone
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            found.append((no, key))
    return found


def _hashes(data: bytes, least: int) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh3_64_intdigest(key) for _, key in keys_of(data, least)], np.uint64))


def suspected(chunks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For (rows, keys) of one bucket: which entries may hold a key of several rows, all that do among them.

    A key goes into the filter of once-seen keys, and into that of twice-seen ones when the first
    holds it already. Entries whose row is ``NOBODY`` stand for two rows. Then the second filter is asked.
    """
    total = sum(len(keys) for _, keys in chunks)
    once, twice = Bloom(total), Bloom(total)
    at = 0
    while at < len(chunks):
        end, held = at, 0
        while end < len(chunks) and held < TOGETHER:
            held += len(chunks[end][1])
            end += 1
        rows, keys = (np.concatenate([c[k] for c in chunks[at:end]]) for k in (0, 1))
        keys, of, times = np.unique(keys, return_inverse=True, return_counts=True)
        places = once.places(keys)
        again = once.holds(places) | (times > 1) | (np.bincount(of, rows == NOBODY, len(keys)) > 0)
        twice.add(places[:, again])
        once.add(places)
        at = end
    return [twice.holds(twice.places(keys)) & (rows != NOBODY) for rows, keys in chunks]


def suspects(rows: DataFrame, total: int, least: int) -> DataFrame:
    """(row, key): leading bits of line hashes that several rows may hold, from (row, data).

    Hashes are dealt into buckets by their first bits, packed; a bucket has its own pair of filters
    and holds about two million of the ``total`` keys, so the filters grow in number, not in size. A
    key that repeats within a task's batch is suspected there and then, and one mark of it is sent.
    """
    bits = key_bits(total)
    shift = np.uint64(32 - bits)
    known = np.zeros(0, np.uint64)

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at, size, keys = 0, 0, []
            for i, data in enumerate(batch.column(1)):
                keys.append(np.unique(_hashes(data.as_py(), least) >> shift))
                size += len(keys[-1])
                if size > FLUSH or i + 1 == batch.num_rows:
                    yield _dealt(ids[at:i + 1], keys, known, True)
                    at, size, keys = i + 1, 0, []

    def probe(batches):
        parts = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4))))
        for bucket, group in groupby(parts, key=lambda r: r[0]):
            if bucket < 0:
                for _, k, r, c in group:
                    yield _found(np.repeat(np.frombuffer(r, "<i8"), np.frombuffer(c, "<u4")), np.frombuffer(k, "<i8"))
                continue
            chunks = [(np.repeat(np.frombuffer(r, "<i8"), np.frombuffer(c, "<u4")), np.frombuffer(k, "<u4")) for _, k, r, c in group]
            for (row, low), some in zip(chunks, suspected(chunks)):
                yield _found(row[some], low[some].astype(np.int64) | np.int64(bucket) << np.int64(32))

    dealt = rows.mapInArrow(deal, "bucket int, keys binary, rows binary, counts binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(max(parts, (1 << bits) // 8), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(probe, "row long, key long")


def _found(row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.int64())], names=["row", "key"])


def _occurrences(rows: DataFrame, bits: int, least: int) -> DataFrame:
    """(row, key, lines) of the keys whose hash is among the row's suspected ones, from (row, data, keys)."""
    shift = np.uint64(32 - bits)

    def find(batches):
        for batch in batches:
            out, size = ([], [], []), 0
            for row, data, keys in zip(*(batch.column(k) for k in range(3))):
                wanted, lines = set(keys.as_py()), {}
                for no, key in keys_of(data.as_py(), least):
                    lines.setdefault(key, []).append(no)
                for key, numbers in lines.items():
                    if xxhash.xxh3_64_intdigest(key) >> int(shift) in wanted:
                        for column, value in zip(out, (row.as_py(), key.decode(), numbers)):
                            column.append(value)
                        size += len(key)
                if size > 4_000_000:
                    yield _lines(out)
                    out, size = ([], [], []), 0
            yield _lines(out)

    return rows.mapInArrow(find, "row long, key string, lines array<int>")


def _lines(out) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["row", "key", "lines"])


def _cutter(kept_text: bool):
    def cut(batches):
        for batch in batches:
            out = [], [], []
            for data, lines in zip(batch.column(2), batch.column(3)):
                gone = set(lines.as_py() or ())
                kept = b"\n".join(x for no, x in enumerate(data.as_py().split(b"\n")) if no not in gone)
                for column, value in zip(out, (len(gone), hashlib.sha256(kept).hexdigest(), kept if kept_text else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.binary())))],
                names=["row", "n_lines", "n_dropped", "kept_sha256", "kept"])
    return cut


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, kept_text: bool = False,
) -> DataFrame:
    """One row per document: (id, n_lines, n_dropped, kept_sha256), and with ``kept_text`` the text that is left (``kept``).

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at
    least ``least`` code points that several documents hold lose all their lines but those in the
    first of these documents. Hashes of keys pass two Bloom filters; only lines whose key the second
    holds are moved, grouped by the whole key, which confirms the repeat and tells the first document.
    Equal keys are counted before they are moved, and the join that follows can be split by Spark.

    Null text is one empty line. Null ids come first, repeated ids are ordered by their texts and rows
    equal in both as they come: each row is a document. Where all lines go, the empty text is left. An
    empty table gives no rows; only the two columns named are read.
    """
    rows, ids = _ordered(docs, id_col, text_col)
    rows = rows.select("row", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    breaks = F.octet_length("data") - F.octet_length(F.replace(F.col("data").cast("string"), F.lit("\n"), F.lit("")))
    total = rows.agg(F.sum(breaks + 1)).first()[0] or 0
    keys = suspects(rows, total, least).groupBy("row").agg(F.collect_set("key").alias("keys"))
    read = stored(rows.join(keys, "row", "left").select(
        "row", "keys", (breaks + 1).cast("long").alias("n_lines"), F.sha2("data", 256).alias("sha"),
        F.when(F.col("keys").isNotNull() | F.lit(kept_text), F.col("data")).alias("data")))
    touched = read.where("keys is not null")
    found = stored(_occurrences(touched.select("row", "data", "keys"), key_bits(total), least))
    firsts = stored(found.groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first != last"))
    drops = found.join(firsts.select("key", "first"), "key").where("row != first").groupBy("row").agg(
        F.flatten(F.collect_list("lines")).alias("lines"))
    changed = touched.select("row", "n_lines", "data").join(drops, "row", "left").mapInArrow(
        _cutter(kept_text), "row long, n_lines long, n_dropped long, kept_sha256 string, kept binary")
    whole = read.where("keys is null").select(
        "row", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("sha").alias("kept_sha256"), F.col("data").alias("kept"))
    out = changed.unionByName(whole)
    out = out.withColumn("id", F.col("row")) if ids is None else out.join(ids, "row")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_lines", "n_dropped", "kept_sha256",
        *([F.col("kept").cast("string").alias("kept")] if kept_text else []))
