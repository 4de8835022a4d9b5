"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 4_000_000
GAPS = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower case, letters and digits only, one space between words and around the text."""
    return f" {GAPS.sub(' ', (text or '').lower()).strip()} "


def budget(length: int, per_error: int = 20) -> int:
    return length // per_error


def cut(pattern: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of almost equal length, with their places: any text within that many edits
    holds at least one of them unchanged."""
    n, k = len(pattern), errors + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, pattern[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


def nearest(pattern: str, text: str, stop: int = 0) -> int:
    """Least edit distance of the pattern to any part of the text (Myers' bit vectors). Ends early
    at a distance of ``stop`` or less."""
    m = len(pattern)
    if not m:
        return 0
    mask, top = (1 << m) - 1, 1 << (m - 1)
    place: dict[str, int] = {}
    for i, c in enumerate(pattern):
        place[c] = place.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, m
    for c in text:
        same = place.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & mask, up & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score < best:
                best = score
                if best <= stop:
                    return best
        more, less = more << 1 & mask, less << 1 & mask
        up = less | ~(vertical | more) & mask
        down = more & vertical
    return best


class Finder:
    """Finds all items of a block in a text."""

    def __init__(self, items: list[tuple[object, str]], per_error: int):
        import ahocorasick
        self.items, self.found = [], ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            if pattern := text.strip():
                # A short item counts only as whole words.
                pattern = pattern if len(pattern) >= per_error else f" {pattern} "
                errors = budget(len(pattern), per_error)
                for at, piece in cut(pattern, errors):
                    where.setdefault(piece, []).append((len(self.items), at))
                self.items.append((key, pattern, errors))
        for piece, uses in where.items():
            self.found.add_word(piece, (len(piece), uses))
        if where:
            self.found.make_automaton()

    def hits(self, text: str) -> list[tuple[object, int]]:
        """(item, distance) of the items within their budget, distance the least one."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.found.iter(text) if self.items else ():
            for i, at in uses:
                _, pattern, errors = self.items[i]
                start = end + 1 - size - at
                windows.setdefault(i, []).append((start - errors, start + len(pattern) + errors))
        out = []
        for i, spans in windows.items():
            key, pattern, errors = self.items[i]
            best, last = errors + 1, None
            spans.sort()
            for k, (a, b) in enumerate(spans):
                if last is not None and a <= last[1]:
                    last = (last[0], max(b, last[1]))
                else:
                    last = (a, b)
                if k + 1 == len(spans) or spans[k + 1][0] > last[1]:
                    best = min(best, nearest(pattern, text[max(0, last[0]):last[1]]))
                    last = None
                    if not best:
                        break
            if best <= errors:
                out.append((key, best))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in blocks of about ``BLOCK_CHARS`` characters, one at a time."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where("length(trim(text)) > 0").distinct()
    total = items.agg(F.sum(F.length("text") + 20)).first()[0]
    parts = (total or 0) // BLOCK_CHARS + 1
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    for part in range(parts if total else 0):
        yield [(r.item, plain(r.text)) for r in items.where(F.col("part") == part).collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", per_error: int = 20,
) -> DataFrame:
    """(id, item, distance): every document and the test items that it holds within their budget.

    Both sides are lower-cased and reduced to letters and digits. An item of n characters may differ
    by ``n // per_error`` edits; it is cut into one piece more, exact hits of the pieces in the whole
    text give windows and Myers' bit-parallel distance decides. Items go to the tasks in blocks of
    about ``BLOCK_CHARS`` characters, so that a larger benchmark takes more passes over the texts,
    not more memory. Items of fewer than ``per_error`` characters must appear as whole words.

    Null, empty and wordless texts and items match nothing. Repeated documents and items give a row
    for each id; a repeated id gives its least distance. Null ids are kept. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        found = rows.mapInArrow(_search(items, per_error, kinds[1]), f"id {kinds[0]}, item {kinds[1].simpleString()}, distance int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.where("false").select("id", F.lit(None).cast(kinds[1]).alias("item"), F.lit(0).alias("distance"))
    return out.groupBy("id", "item").agg(F.min("distance").alias("distance")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "distance")


def _search(items: list[tuple[object, str]], per_error: int, kind):
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(kind)

    def search(batches):
        finder = Finder(items, per_error)
        for batch in batches:
            at, item, distance = [], [], []
            for i, text in enumerate(batch.column(1)):
                for key, best in finder.hits(plain(text.as_py())):
                    at.append(i), item.append(key), distance.append(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, arrow), pa.array(distance, pa.int32())],
                names=["id", "item", "distance"])
    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no test item, with all their columns. Rows that share an id go together."""
    bad = contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias("__bad"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")
