"""Whitening of embeddings by spectrum slicing of their covariance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

SCALE, OFFSET = 64, 1_000_000
PIVOT = (1 + 17 ** 0.5) / 8     # bound of element growth by 1 x 1 and 2 x 2 pivots
ROWS = 4096                     # vectors that are multiplied together
EPS = float(np.finfo(float).eps)


def inertia(matrix: np.ndarray) -> tuple[int, int]:
    """(negative, positive) eigenvalues of a symmetric matrix, from the pivots of its LDLᵀ form.

    The largest diagonal or off-diagonal entry of what is left is the pivot, of size 1 or 2, so that
    the counts are those of a matrix within rounding of the given one. By Sylvester's law they are
    its own. A rest of zeros counts as neither.
    """
    a, negative, positive = matrix.copy(), 0, 0
    while len(a):
        size = np.abs(a)
        on = int(np.argmax(np.diagonal(size)))
        largest = size[on, on]
        np.fill_diagonal(size, -1.0)
        r, s = divmod(int(np.argmax(size)), len(a))
        if max(largest, size[r, s]) <= 0:
            break
        taken = [on] if largest >= PIVOT * size[r, s] else [r, s]
        block = a[np.ix_(taken, taken)]
        if len(taken) == 1:
            negative, positive = negative + (block[0, 0] < 0), positive + (block[0, 0] > 0)
        else:  # of such a block one eigenvalue is negative and one positive
            negative, positive = negative + 1, positive + 1
        rest = np.delete(np.arange(len(a)), taken)
        side = a[np.ix_(rest, taken)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return int(negative), int(positive)


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues that are greater than ``shift``."""
    return inertia(matrix - shift * np.eye(len(matrix)))[1]


def _rayleigh(matrix: np.ndarray, low: float, high: float, found: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The eigenpair of the isolated eigenvalue between ``low`` and ``high``, orthogonal to the columns
    of ``found``; None if the iteration leaves the interval."""
    d, norm = len(matrix), np.abs(matrix).sum(axis=1).max()

    def unit(v):
        for _ in range(2):
            v = v - found @ (found.T @ v)
            v = v / np.linalg.norm(v)
        return v

    def solved(shift, v):
        try:
            z = np.linalg.solve(matrix - shift * np.eye(d), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            z = np.linalg.solve(matrix - (shift + EPS * norm) * np.eye(d), v)
        return unit(z / np.abs(z).max()) if np.isfinite(z).all() else v

    v = unit(np.cos(np.arange(d) * 1.618 + 1.0))
    for _ in range(3):  # toward the one eigenvalue that is next to the middle
        v = solved((low + high) / 2, v)
    best = None
    for _ in range(30):
        value = float(v @ matrix @ v)
        if not low <= value <= high:
            return None
        rest = np.linalg.norm(matrix @ v - value * v)
        if best and rest >= best[0]:
            break
        best = rest, value, v
        v = solved(value, v)
    rest, value, v = best
    return (value, v) if rest <= 16 * d * EPS * norm else None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the ``most`` greatest positive eigenvalues, falling.

    Counts of eigenvalues above a shift slice the spectrum: an interval is halved until it holds
    just one eigenvalue that is not found yet, Rayleigh quotient iteration goes on from its middle
    and the counts on both sides of the result certify its number. Eigenvalues equal to rounding
    cannot be parted and share an interval; their vectors are orthogonal ones of the same space. Those
    that are zero to rounding are left out. The largest entry of a vector is positive.
    """
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    slack = 8 * d * EPS * norm
    values, vectors = [], np.zeros((d, 0))
    positive = above(matrix, slack) if norm else 0
    high, inside_high = norm + slack, 0
    for number in range(1, min(most, positive) + 1):
        low, inside_low = slack, positive
        while True:
            alone, narrow = inside_low == number and inside_high == number - 1, high - low <= slack
            if alone or narrow:
                reach = slack if narrow else 0.0
                pair = _rayleigh(matrix, low - reach, high + reach, vectors)
                if pair:
                    beyond, within = above(matrix, pair[0] + slack), above(matrix, pair[0] - slack)
                    if beyond < number <= within:
                        break
                if narrow:
                    raise ArithmeticError(f"component {number} is not certified")
            middle = (low + high) / 2
            count = above(matrix, middle)
            if count >= number:
                low, inside_low = middle, count
            else:
                high, inside_high = middle, count
        value, vector = pair
        values.append(value)
        vectors = np.column_stack([vectors, vector * np.sign(vector[np.argmax(np.abs(vector))])])
        high, inside_high = (value - slack, within) if within == number else (value + slack, beyond)
    return np.array(values), vectors


def _whole(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their x as an int64 matrix): x is floor(SCALE * c) + OFFSET."""
    lengths = np.diff(vectors.offsets.to_numpy())
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    keep = valid & (lengths == dimension)
    flat = vectors.filter(pa.array(keep)).flatten().cast(pa.float64())
    c = flat.to_numpy(zero_copy_only=False).reshape(-1, dimension)  # nulls become nan
    x = np.floor(SCALE * c)
    fits = (np.abs(x) < 2.0 ** 62).all(axis=1)  # false for nan and infinities
    keep[np.flatnonzero(keep)[~fits]] = False
    return keep, x[fits].astype(np.int64) + OFFSET


def _dimension(rows: DataFrame) -> int:
    """The length of most vectors that have only finite entries, the greater of equally many."""
    whole = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    found = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _fit_list(rows: DataFrame, dimension: int) -> DataFrame:
    """(x) each distinct vector once, as packed 64-bit numbers; equal ones of a task are combined first."""
    def pack(batches):
        for batch in batches:
            _, x = _whole(batch.column(0), dimension)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["x"])

    return rows.select("v").mapInArrow(pack, "x binary").distinct()


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dimension)


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """(n, sums by dimension), exact."""
    def add(batches):
        n, total = 0, [0] * dimension
        for batch in batches:
            x = _unpacked(batch.column(0), dimension)
            n += len(x)
            # Halves, as a sum of many large numbers does not fit 64 bits.
            for k, (h, l) in enumerate(zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist())):
                total[k] += (h << 32) + l
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dimension), pa.int32()), pa.array([str(t) for t in (n, *total)])], names=["k", "total"])

    parts = fit.mapInArrow(add, "k int, total string")
    totals = {r["k"]: int(r["total"]) for r in parts.groupBy("k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return totals.get(-1, 0), [totals.get(k, 0) for k in range(dimension)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n with one rounding: n * x - S is worked out in whole numbers."""
    if _small(x, n, sums):
        return (n * x - np.array(sums, np.int64)) / n
    return ((n * x.astype(object) - np.array(sums, object)) / n).astype(float)


def _small(x: np.ndarray, n: int, sums: list[int]) -> bool:
    """Whether n * x - S fits 64 bits."""
    return max(int(np.abs(x).max(initial=0)) * n, *(abs(v) for v in sums)) < 1 << 62


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)²; None beyond 64 bits."""
    rough = ((centred(x, n, sums) * n) ** 2).sum(axis=1)
    if rough.max(initial=0) < 2.0 ** 62 and _small(x, n, sums):
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def _covariance(fit: DataFrame, dimension: int, n: int, size: int, view: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The covariance, divisor n, of ``view`` of the fit list: ``size`` numbers for each vector.

    Every task centres its vectors by their own mean before it multiplies them, and its mean and
    products are a row for each line of the matrix. Tasks read the written fit list, so that each gives
    the same numbers again, and their parts are put together in the order of their contents.
    """
    def multiply(batches):
        count, mean, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = _unpacked(batch.column(0), dimension)
            for at in range(0, len(x), ROWS):
                y = view(x[at:at + ROWS])
                part = y.mean(axis=0)
                z = y - part
                count, mean, products = _merged((count, mean, products), (len(y), part, z.T @ z))
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)), pa.array([count] * size, pa.int64()),
                 pa.array([mean.tobytes()] * size, pa.binary()), pa.array([r.tobytes() for r in products], pa.binary())],
                names=["line", "n", "mean", "products"])

    def add(key, table):
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "mean", "products"))))
        line = key[0].as_py()
        total, at, row = 0, np.zeros(size), np.zeros(size)
        for count, mean, products in parts:
            mean, products = np.frombuffer(mean), np.frombuffer(products)
            away = mean - at
            row = row + products + away[line] * away * (total * count / (total + count))
            total += count
            at = at + away * (count / total)
        return pa.table({"line": pa.array([line], pa.int32()), "row": pa.array([row.tobytes()], pa.binary())})

    lines = fit.mapInArrow(multiply, "line int, n long, mean binary, products binary").groupBy("line").applyInArrow(
        add, "line int, row binary")
    out = np.zeros((size, size))
    for r in lines.collect():
        out[r["line"]] = np.frombuffer(r["row"])
    return (out + out.T) / 2 / n


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets together."""
    (n, p, m), (k, q, l) = a, b
    if not n:
        return b
    away = q - p
    return n + k, p + away * (k / (n + k)), m + l + np.outer(away, away) * (n * k / (n + k))


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per kept vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    An entry c becomes x = floor(64 * c) + 1,000,000. The ``n`` distinct x-vectors are the fit list, with
    sums S, and their covariance, divisor n, gives the components (see ``leading``), numbered from 1.
    ``deviation`` is the sum of (n * x - S)² (null beyond 64 bits), ``whitened`` the projection of x - S/n
    over the root of the eigenvalue, ``explained`` the eigenvalue's share of the trace and
    ``identity_error`` the largest entry of the covariance of the fit list's whitened vectors minus the
    identity, as measured on them. Rows are read once more for the projection and never shuffled;
    only distinct vectors are, and only matrices of the dimension squared reach the driver.

    Null vectors and those with null, infinite or not-a-number entries, or entries too large for 64 bits, give
    no rows. Nor do vectors of another length than most. Components of no variance are left out:
    there are fewer than ``components`` if vectors are short or few, and no rows for a single distinct
    vector, empty vectors or an empty table. Ids may be null or repeat.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    d = _dimension(rows)
    fit = stored(_fit_list(rows, d)) if d else None
    n, sums = _sums(fit, d) if d else (0, [])
    values, vectors, share, error = np.zeros(0), np.zeros((d, 0)), [], 0.0
    if n:
        covariance = _covariance(fit, d, n, d, lambda x: centred(x, n, sums))
        values, vectors = leading(covariance, components)
        share = (values / np.trace(covariance)).tolist() if len(values) else []
    turned = vectors / np.sqrt(values)
    if len(values):
        seen = _covariance(fit, d, n, len(values), lambda x: centred(x, n, sums) @ turned)
        error = float(np.abs(seen - np.eye(len(values))).max())

    def project(batches):
        for batch in batches:
            keep, x = _whole(batch.column(1), d)
            out = centred(x, n, sums) @ turned
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.array(deviations(x, n, sums), pa.int64()),
                 pa.array(out.tolist(), pa.list_(pa.float64()))], names=["id", "deviation", "parts"])

    kind = rows.schema["id"].dataType.simpleString()
    if not len(values):
        rows = rows.limit(0)
        found = rows.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("parts"))
    else:
        found = rows.mapInArrow(project, f"id {kind}, deviation long, parts array<double>")
    shares = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    found = found.select("id", "deviation", F.posexplode("parts").alias("at", "whitened"))
    return found.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
