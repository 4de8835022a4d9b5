"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

WORDS_KEPT = 500_000
SEPARATOR = b"\0\0\0\0"


# Fixed values of the tokenizer: how a lower-case word splits, as far as PLAIN words need it.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes: printable Latin-1 ones for themselves, the others in
    order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, word by word.

    The vocabulary never joins text across white space, so the ids of a text are those of its words.
    Words of ASCII and Latin-1 letters are split in parts here and only the parts are looked up, as
    many words share them; any other word, and one that may hold a special token, goes through the
    whole tokenizer. The last ids are kept, of at most ``WORDS_KEPT`` words of up to 64 bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), {}, {}
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(self.parts) >= WORDS_KEPT:
                self.parts.clear()
            if len(part) <= 64:
                self.parts[part] = found
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            parts = PARTS.findall(text.lower())
            return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self._part, parts))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words, seen = text.encode().split(), self.words
        new = set(words).difference(seen)
        if len(seen) + len(new) > WORDS_KEPT:
            seen.clear()
            new = set(words)
        long = [w for w in new if len(w) > 64]
        for w in new:
            seen[w] = self._word(w)
        out = b"".join(map(seen.__getitem__, words))
        for w in long:
            del seen[w]
        return out


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32). A document is its ids and one 0."""
    def cut(batches):
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + SEPARATOR
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            which, *rest = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])],
                names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int, choices: int = 24, most: int = 4) -> list[tuple[int, ...]]:
    """Patterns of two to ``most`` documents, longest first, that leave little room.

    For each first length and up to ``choices`` second ones, evenly spread over those that fit, the
    rest is filled with the largest length that fits, document by document.
    """
    present, found = sorted(int(x) for x in lengths), set()

    def best(room: int, longest: int) -> int:
        k = bisect_left(present, min(room, longest) + 1)
        return present[k - 1] if k else 0

    for a in present:
        fit = bisect_left(present, min(capacity - a, a) + 1)
        for k in {round(x) for x in np.linspace(0, fit - 1, min(choices, fit))} if fit else ():
            pattern = [a, present[k]]
            while len(pattern) < most and (c := best(capacity - sum(pattern), pattern[-1])):
                pattern.append(c)
            found.add(tuple(pattern))
        if fit:
            found.add((a, present[fit - 1]))
    return sorted(found, reverse=True)


def fitted(counts: dict[int, int], found: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """Repeats x >= 0 of the patterns with least squared error of their documents against the
    histogram, by projected gradients with momentum. Work depends on the capacity alone."""
    place = {n: i for i, n in enumerate(counts)}
    rows = np.array([place[n] for p in found for n in p])
    cols = np.repeat(np.arange(len(found)), [len(p) for p in found])
    h = np.array(list(counts.values()), float)
    scale = h.mean()
    times = lambda x: np.bincount(rows, x[cols], len(h))
    back = lambda r: np.bincount(cols, r[rows], len(found))
    v = np.ones(len(found))
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v)
    bound = 1.05 * np.linalg.norm(back(times(v)))
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - h / scale) / bound)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x * scale


def _packed_rest(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences of equal content are handled together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        space = capacity - sum(pattern)
        if space not in room:
            room[space] = []
            insort(free, space)
        room[space].append((pattern, n))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect_left(free, length)
            if k < len(free):
                space = free[k]
                pattern, have = room[space].pop()
                if not room[space]:
                    del room[space], free[k]
            else:
                space, pattern, have = capacity, (), n
            each = min(space // length, n)
            used = min(have, n // each)
            put(pattern + (length,) * each, used)
            n -= used * each
            if pattern and have > used:
                put(pattern, have - used)
    return [x for group in room.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold exactly the documents of a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    found = patterns(np.array([n for n in left if n < capacity]), capacity) if left else []
    if found:
        x = fitted(left, found)
        fill = np.array([sum(p) for p in found])
        for k in np.lexsort((-x, -fill)):
            p = found[k]
            if x[k] < 0.5 or capacity - fill[k] > capacity // 64:
                continue
            n = min(round(x[k]), *(left[a] // p.count(a) for a in set(p)))
            if n:
                out.append((p, n))
                for a in p:
                    left[a] -= n
    return out + _packed_rest({n: c for n, c in left.items() if c}, capacity)


def _layout(found: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each length, consecutive ranges of ranks: (length << 44 | first rank), documents per
    sequence, first sequence, first offset, length."""
    rows, used, first = [], {}, 0
    for pattern, n in found:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length << 44 | used.get(length, 0), each, first, offset, length))
            used[length] = used.get(length, 0) + each * n
            offset += each * length
        first += n
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows)))


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    The histogram of lengths (at most ``capacity`` rows) goes to the driver, which plans how many
    sequences of which pattern there are; its work does not grow with the documents. Pieces of a
    length are ranked in parts of about the root of their number, and rank and plan give sequence
    and offset. Only documents of more than ``capacity`` tokens are cut.

    Null and empty texts are the single id 0. Null ids, repeated ids and repeated rows are rows of
    their own. An empty table gives no rows; other columns are not looked at.
    """
    cut = stored(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    histogram = cut.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in histogram.collect()}
    layout = _layout(plan(counts, capacity)) if counts else None

    parts = F.broadcast(histogram.select("length", (F.floor(F.sqrt("n")) + 1).cast("long").alias("parts")))
    rows = cut.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).drop("parts")
    sizes = rows.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))
    rows = rows.withColumn("rank", rank).join(sizes, ["length", "part"])
    rows = rows.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("before")).alias("rank"))

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            starts, each, first, offset, _ = layout
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            k = rank - (starts[at] & ((1 << 44) - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first[at] + k // each[at]), pa.array(offset[at] + k % each[at] * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        placed, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
