"""Removal of repeated passages by sorting sampled suffixes of the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .common import stored, stored_by
from .repeats import key_bits, repeated
from .sharding import numbered

LENGTH = 100
PREFIX = 37                      # bytes that name a sampled suffix
COVER = LENGTH - PREFIX + 1      # a window of LENGTH bytes holds as many prefixes: 64
PLACES = (1 << 20) - 1           # a place in a chunk, beside the hash in one number
CHUNK = PLACES + 1 - 128
MANY = 50_000                    # different surroundings of one name that are compared in a task


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``size`` bytes, put together from those of powers of two."""
    level = (data.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    length, out, done = 1, None, 0
    while True:
        if size & length:
            part = level[done:done + len(data) - size + 1]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + part
            done += length
        length *= 2
        if length > size:
            break
        half = length // 2
        level = (level[:-half] ^ (level[:-half] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + level[half:]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out


def samples(data: np.ndarray):
    """(places, first, last, names) of the sampled suffixes of a text, chunk by chunk.

    Every window of ``LENGTH`` bytes belongs to the suffix inside it, among the ``COVER`` whose
    prefix the window holds, with the least prefix hash (the leftmost of equal ones). So equal
    windows belong to suffixes at the same distance from their starts: like the residues of a
    difference cover, any two of them have a shift at which both are sampled, but the sample
    follows the content and is a thirtieth of all suffixes. ``first`` and ``last`` are the starts of
    a suffix's windows.
    """
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[at:at + CHUNK + LENGTH - 1]
        names = _hashes(part, PREFIX)
        least = (names & ~np.uint64(PLACES)) | np.arange(len(names), dtype=np.uint64)
        width = 1
        while width < COVER:  # least value of the next COVER places, by doubling
            step = min(width, COVER - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & np.uint64(PLACES)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([new[1:] - 1, [len(place) - 1]])
        yield place[new] + at, new + at, last + at, names[place[new]]


def _names(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    found = [s[3] for s in samples(data)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _surroundings(rows: DataFrame, bits: int) -> DataFrame:
    """(row, place, first, last, sign, name, bytes) of the suffixes whose name is among the row's
    repeated ``keys``: the bytes that their windows cover, given once by each task and signature."""
    shift = np.uint64(32 - bits)

    def find(batches):
        given: set[bytes] = set()
        for batch in batches:
            columns = [[] for _ in range(7)]
            for row, text, keys in zip(*(batch.column(k) for k in range(3))):
                row, raw = row.as_py(), (text.as_py() or "").encode()
                data, wanted = np.frombuffer(raw, np.uint8), np.unique(keys.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                for place, first, last, names in samples(data):
                    cut = names >> shift
                    at = np.minimum(np.searchsorted(wanted, cut), len(wanted) - 1)
                    for k in np.flatnonzero(wanted[at] == cut).tolist():
                        p, a, b = int(place[k]), int(first[k]), int(last[k])
                        body = raw[a:b + LENGTH]
                        sign = hashlib.blake2b(body, digest_size=16, salt=(p - a).to_bytes(1, "little")).digest()
                        for column, value in zip(columns, (row, p, a, b, sign, int(names[k]) - (1 << 63), None if sign in given else body)):
                            column.append(value)
                        given.add(sign)
                if len(given) > 200_000:
                    given.clear()
                if len(columns[0]) > 20_000:
                    yield _batch(columns)
                    columns = [[] for _ in range(7)]
            yield _batch(columns)

    return rows.mapInArrow(find, "row long, place long, first long, last long, sign binary, name long, bytes binary")


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "place", "first", "last", "sign", "name", "bytes"])


def repeats_earlier(groups: np.ndarray, left: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """For surroundings in the order of their first places: a mask of the windows (bit 0 the first)
    that an earlier one of the same group holds at the same distance from the sampled place.

    All windows are sorted by group, distance and hash; neighbours in this order are compared byte
    by byte, and of equal ones all but the earliest are marked."""
    n = np.array([len(b) - LENGTH + 1 for b in bodies])
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    start = np.cumsum([0] + [len(b) for b in bodies[:-1]])
    owner = np.repeat(np.arange(len(bodies)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = start[owner] + nth
    hashes = _hashes(flat, LENGTH)[at]
    distance = left[owner] - nth
    order = np.lexsort((owner, hashes, distance, groups[owner]))
    a, b = order[:-1], order[1:]
    same = (hashes[a] == hashes[b]) & (distance[a] == distance[b]) & (groups[owner[a]] == groups[owner[b]])
    windows = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
    some = np.flatnonzero(same)
    for k in range(0, len(some), 100_000):
        part = some[k:k + 100_000]
        same[part] = (windows[at[a[part]]] == windows[at[b[part]]]).all(1)
    marked = b[same]
    mask = np.zeros(len(bodies), np.uint64)
    np.bitwise_or.at(mask, owner[marked], np.uint64(1) << nth[marked].astype(np.uint64))
    return mask.view(np.int64)


def _compared(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(sign, mask) from the first place ``at`` of every signature: which of its windows stand at an
    earlier place. All windows of the other places of a signature do."""
    sizes = firsts.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    bodies = found.where("bytes IS NOT NULL").groupBy("sign").agg(F.max("bytes").alias("bytes"))
    firsts = stored(firsts.join(sizes, "name").join(bodies, "sign").select(
        "name", "sign", "at.row", "at.place", (F.col("at.place") - F.col("at.first")).alias("left"), "bytes", "n"))

    def compare(batches):
        held: list = []

        def masks(rows):
            names, signs, _, _, left, body = zip(*rows)
            _, group = np.unique(np.array(names), return_inverse=True)
            mask = repeats_earlier(group, np.array(left), list(body))
            return pa.RecordBatch.from_arrays([pa.array(signs, pa.binary()), pa.array(mask)], names=["sign", "mask"])

        for batch in batches:
            held.extend(zip(*(batch.column(k).to_pylist() for k in range(6))))
            while len(held) > 20_000 and held[0][0] != held[-1][0]:
                cut = next(i for i in range(len(held) - 1, 0, -1) if held[i - 1][0] != held[-1][0])
                yield masks(held[:cut])
                held = held[cut:]
        if held:
            yield masks(held)

    few = firsts.where(F.col("n") <= MANY).drop("n")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = few.repartition(parts, "name").sortWithinPartitions("name", "row", "place").mapInArrow(
        compare, "sign binary, mask long")

    # A name with more surroundings: each window is a row, grouped by its bytes over all tasks.
    many = firsts.where(F.col("n") > MANY).withColumn("nth", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)))
    many = many.select("sign", "row", "place", "nth", (F.col("left") - F.col("nth")).alias("distance"), F.expr(
        f"substring(bytes, nth + 1, {LENGTH})").alias("window"))
    first = many.groupBy("distance", "window").agg(F.min(F.struct("row", "place")).alias("at"))
    many = many.join(first, ["distance", "window"]).where("struct(row, place) != at").groupBy("sign").agg(
        F.sum(F.expr("shiftleft(1L, nth)")).alias("mask"))
    return few.unionByName(many)


def removed_runs(size: int, spans: list[tuple[int, int, int | None]]) -> np.ndarray:
    """Which bytes are covered, from (first, last, mask) of windows; no mask: all of them."""
    edge = np.zeros(size + 1, np.int64)
    for first, last, mask in spans:
        if mask is None:
            edge[first] += 1
            edge[last + LENGTH] -= 1
        else:
            mask &= (1 << 64) - 1
            while mask:
                low = (mask & -mask).bit_length() - 1
                run = (~(mask >> low) & (mask >> low) + 1).bit_length() - 1
                edge[first + low] += 1
                edge[first + low + run - 1 + LENGTH] -= 1
                mask &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge[:-1]) > 0


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(row, text) with rows in the order of ids, and (row, id) unless ids are distinct whole numbers."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(rows.schema["id"].dataType, IntegralType):
        n, whole = rows.agg(F.count("*"), F.count("id")).first()
        if n == whole and rows.groupBy("id").count().where("count > 1").isEmpty():
            return rows.select(F.col("id").cast("long").alias("row"), "text"), None
    rows = stored(numbered(rows, "id", "text").withColumnRenamed("number", "row"))
    return rows.select("row", "text"), rows.select("row", "id")


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, n_spans, kept_sha256), and with ``kept_text`` the
    remaining bytes (``kept``).

    A byte goes if a string of ``LENGTH`` bytes that covers it starts earlier as well: at a smaller
    id, or before it in the same document. Sampled suffixes (see ``samples``) are named by their
    prefix; names that occur once end here. The others are sorted by name, equal surroundings are
    one entry at their first place, and the windows of a name are sorted and neighbours compared.

    Null text is empty. Null ids come first, repeated ids are ordered by their texts and rows equal
    in both as they come. Texts are read in chunks. An empty table gives no rows.
    """
    rows, ids = _ordered(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total = size * 2 // (COVER + 1)
    keys = repeated(rows, lambda: _names, total, meet=True).groupBy("row").agg(F.collect_set("key").alias("keys"))
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = stored_by(rows.join(keys, "row", "left").select(
        "row", "keys", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha"),
        F.when(F.col("keys").isNotNull() | F.lit(kept_text), F.col("text")).alias("text")), "row")
    touched = rows.where("keys is not null").select("row", "text", "keys")
    found = stored(_surroundings(touched, key_bits(total)))
    firsts = stored(found.groupBy("sign", "name").agg(F.min(F.struct("row", "place", "first")).alias("at")))
    masks = firsts.select("sign", "at").join(_compared(found, firsts), "sign", "left")
    spans = found.select("row", "place", "first", "last", "sign").join(masks, "sign")
    spans = spans.withColumn("whole", F.expr("struct(row, place, first) != at")).where("whole or mask != 0")
    spans = stored(spans.groupBy("row").agg(
        F.collect_list(F.struct("first", "last", F.when(~F.col("whole"), F.col("mask")).alias("mask"))).alias("spans")))

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode()
                gone = removed_runs(len(raw), [(s["first"], s["last"], s["mask"]) for s in spans])
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(out, (len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, [pa.int64()] * 3 + [pa.string(), pa.binary()]))],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = touched.select("row", "text").join(spans, "row").mapInArrow(
        cut, "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = rows.join(spans.select("row"), "row", "left_anti").select(
        "row", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("sha").alias("kept_sha256"), data.alias("kept"))
    out = changed.unionByName(whole)
    out = out.withColumn("id", F.col("row")) if ids is None else out.join(ids, "row")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256",
        *(["kept"] if kept_text else []))

