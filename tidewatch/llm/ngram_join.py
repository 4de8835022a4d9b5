"""N-gram Jaccard join: a blocked product of the document by n-gram incidence."""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .common import components, keep_rows, stored
from .repeats import repeated

WORDS_KEPT = 150_000
BLOCK_DOCS, BLOCK_GRAMS = 768, 1_500_000
DENSE = 48                # documents from which a column is multiplied densely
HOT = 128                 # an n-gram in more than a HOT-th of the documents is not counted further


class Shingler:
    """Distinct n-word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.seen = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > WORDS_KEPT:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15 * n % 2 ** 64, np.uint64)
        for k in range(n):  # each word shifts and mixes, so that order counts
            out ^= h[k:k + len(out)]
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _marks(rows: DataFrame, n: int) -> DataFrame:
    """(row, n, sign, hot): set size, 128-bit signature of the set, and with the last row of some
    thousand those n-grams that are frequent among them, [n-gram, count]."""
    def mark(batches):
        shingles = Shingler(n)
        for batch in batches:
            sizes, signs, hot, held, size = [], [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                grams = shingles(text.as_py())
                sizes.append(len(grams))
                signs.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                held.append(grams)
                size += len(grams)
                hot.append(None)
                if size > 1_000_000 or i + 1 == batch.num_rows:
                    grams, count = np.unique(np.concatenate(held), return_counts=True)
                    some = np.flatnonzero(count >= max(16, len(held) / (2 * HOT)))
                    hot[-1] = list(zip(grams[some].view(np.int64).tolist(), count[some].tolist()))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()),
                 pa.array([None if h is None else [{"g": g, "c": c} for g, c in h] for h in hot],
                          pa.list_(pa.struct([("g", pa.int64()), ("c", pa.int64())])))],
                names=["row", "n", "sign", "hot"])

    return rows.mapInArrow(mark, "row long, n long, sign binary, hot array<struct<g: long, c: long>>")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of the incidence matrix: shared n-grams of every pair of documents.

    Columns of few documents add up their pairs, columns of many are multiplied as dense matrices."""
    n, m = len(sets), len(others)
    gram = np.concatenate([*sets, *others])
    doc = np.repeat(np.arange(n + m), [len(s) for s in (*sets, *others)])
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [len(gram)]]))
    out = np.zeros(n * m)
    for k in np.unique(size[(size > 1) & (size <= DENSE)]).tolist():
        columns = start[size == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, 1_000_000 // len(i))
        for at in range(0, len(columns), step):
            rows = doc[columns[at:at + step, None] + np.arange(k)]  # documents of a column in order
            a, b = rows[:, i].ravel(), rows[:, j].ravel()
            both = (a < n) & (b >= n)
            pair, times = np.unique(a[both] * m + b[both] - n, return_counts=True)
            out[pair] += times
    out = out.reshape(n, m)
    many = np.flatnonzero(size > DENSE)
    for at in range(0, len(many), 2048):
        part = many[at:at + 2048]
        column = np.repeat(np.arange(len(part)), size[part])
        rows = doc[np.repeat(start[part], size[part]) + np.arange(len(column)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])]
        dense = np.zeros((n + m, len(part)), np.float32)
        dense[rows, column] = 1
        out += dense[:n] @ dense[n:].T
    return out


def links(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for every pair of two lists of sets."""
    a, b = np.array([len(s) for s in sets]), np.array([len(s) for s in others])
    both = overlaps(sets, others)
    # Sizes too far apart cannot link whatever they share.
    near = 100 * np.minimum.outer(a, b) >= percent * np.maximum.outer(a, b)
    return near & (both > 0) & (100 * both >= percent * (np.add.outer(a, b) - both))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) edges that span the components of a two-sided graph."""
    n, m = linked.shape
    edges, left, right = [], np.ones(n, bool), np.ones(m, bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first], stack = False, [first]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(linked[i] & right)
            right[new] = False
            for j in new:
                edges.append((i, int(j)))
                more = np.flatnonzero(linked[:, j] & left)
                left[more] = False
                for k in more:
                    edges.append((int(k), int(j)))
                    stack.append(int(k))
    return edges


def _verified(members: DataFrame, percent: int, n: int) -> DataFrame:
    """(a, b): links that span the components inside each cluster of members (cluster, row, n, text).

    A cluster is cut into blocks of bounded size and every pair of its blocks is one product."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    sizes = sizes.select("cluster", F.greatest(
        F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))

    def sets(batches):
        shingles = Shingler(n)
        for batch in batches:
            found = [shingles(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["cluster", "row", "grams"])

    rows = members.select("cluster", "row", "text").mapInArrow(sets, "cluster long, row long, grams binary")
    rows = rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "row", "grams")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "block", "row")

    def product(batches):
        parts = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(6))))
        a, b = [], []
        for (_, lo, hi), group in groupby(parts, key=lambda r: r[:3]):
            group = list(group)
            sides = [[r for r in group if r[3] == k] for k in (lo, hi)]
            grams = [[np.frombuffer(r[5], "<u8") for r in side] for side in sides]
            if sides[0] and sides[1]:
                for i, j in _forest(links(*grams, percent)):
                    if sides[0][i][4] != sides[1][j][4]:
                        a.append(sides[0][i][4]), b.append(sides[1][j][4])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(product, "a long, b long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (row, text) and, unless the ids themselves are distinct whole numbers, (row, id)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(rows.schema["id"].dataType, IntegralType):
        n, whole = rows.agg(F.count("*"), F.count("id")).first()
        if n == whole and rows.groupBy("id").count().where("count > 1").isEmpty():
            return rows.select(F.col("id").cast("long").alias("row"), "text"), None
    copy = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    return copy.select("row", "text"), copy.select("row", "id")


def ngram_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
) -> DataFrame:
    """One row per document: (id, n_shingles, component_id).

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct n-word shingles
    (64-bit hashes; words between ASCII white space, A-Z lower-cased; fewer than n words are one
    shingle). ``component_id`` is the smallest id that links reach, the document's own included.

    Equal sets are one class from the start. A pair can link only if it shares one of the rarest
    ``size - ceil(size * percent / 100) + 1`` n-grams of either side, so only documents whose rare
    n-grams stand elsewhere go on. What shares such an n-gram is one candidate cluster; inside it
    the overlaps of all pairs come from products of blocks of the incidence matrix, and pairs below
    the bounds of their sizes are discarded. Of the links of two blocks a spanning forest goes on to
    the components, so a group of copies is never written out pair by pair.

    Null and empty texts have no shingles and link with nothing. A null id is the smallest only of a
    component of null ids. Repeated ids and rows are rows of their own. An empty table gives no rows.
    """
    rows, ids = _rows(docs, id_col, text_col)
    marks = stored(_marks(rows, n))
    total, most = marks.agg(F.sum("n"), F.sum(F.when(F.col("n") > 0, 1))).first()
    hot = marks.select(F.explode("hot").alias("h")).groupBy("h.g").agg(F.sum("h.c").alias("c"))
    hot = hot.where(F.col("c") >= max(16, (most or 0) / HOT)).select("g").collect()  # at most HOT times a set's size
    hot = np.array([r.g for r in hot], np.int64).view(np.uint64)

    classes = marks.where("n > 0").groupBy("sign").agg(F.min("row").alias("class"))
    marks = marks.join(classes, "sign", "left").select("row", "n", F.coalesce("class", "row").alias("class"))
    marks = stored(marks)
    heads = marks.where("row = class and n > 0").select("row", "n")

    shared = repeated(rows, lambda: Shingler(n), total or 0, frequent=hot)
    shared = shared.groupBy("row").agg(F.collect_list(F.struct("times", "key")).alias("grams")).join(heads, "row")
    # Two n-grams and more are allowed to have fallen together when cut to their leading bits.
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 + 2 + F.floor(F.col("n") * F.col("n") / 2.0 ** 38)
    wanted = (needed - (F.col("n") - F.size("grams"))).cast("int")
    rare = shared.withColumn("wanted", wanted).where("wanted > 0").select(
        "row", F.explode(F.slice(F.array_sort("grams"), F.lit(1), F.col("wanted"))["key"]).alias("gram"))
    rare = stored(rare)
    first = rare.groupBy("gram").agg(F.min("row").alias("first"), F.count("*").alias("docs")).where("docs > 1")
    touching = rare.join(first, "gram").where("row > first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    clusters = components(touching).select(F.col("node").alias("row"), F.col("component").alias("cluster"))

    members = stored(rows.join(clusters.join(heads, "row"), "row").select("cluster", "row", "n", "text"))
    found = components(_verified(members, percent, n)).select(F.col("node").alias("class"), "component")
    out = marks.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    out = out.withColumn("id", F.col("row")) if ids is None else out.join(ids, "row")
    least = out.groupBy("component").agg(F.min("id").alias("component_id"))
    kind = docs.schema[id_col].dataType
    return out.join(least, "component").select(
        F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns."""
    groups = ngram_groups(docs, id_col, text_col, **options)
    return keep_rows(docs, groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))), id_col, text_col)
