"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

DECAY = 0.6        # weight of each letter that a subsequence spans
SPAN = 7           # most letters that a subsequence of three spans
PIECE = 24         # longer words are read in pieces that overlap by half
LETTERS = 32
OTHER = 256        # added to the code points of letters beside a to z
HASHED_BITS = 17   # of the places of subsequences that hold such a letter
PAD = LETTERS ** 3 + 2 ** HASHED_BITS
CHUNK = 1 << 16    # letters whose sums are held at a time
GROUP = 4_000_000  # letters of texts that are spelled together
EDGE = 26          # blank between words
NO_WORD = -8.0
VALUES = ["best", "hits", "words", "pair", "pair_hits"]
SURE = 0.6         # decision value from which a window counts as a hit
STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]


def _letter(c: int) -> bool:
    # Vowel signs of the Indic and neighbouring scripts are letters of the word.
    return chr(c).isalpha() or 0x900 <= c < 0x1100 and unicodedata.category(chr(c))[0] == "M"


def _code(c: int) -> int:
    if chr(c).isspace():
        return EDGE
    if not _letter(c):
        return 255
    return OTHER + c if c >= 0x80 else ord(chr(c).lower()) - 97


CODES = np.array([_code(c) for c in range(0x250)], np.int32)  # 255 is no letter


def _coded(text: str) -> np.ndarray:
    """Letter codes of all code points; what is no letter is 255."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = CODES[np.minimum(points, 0x24F)]
    far = np.flatnonzero(points >= 0x250)
    if len(far):
        found, which = np.unique(points[far], return_inverse=True)
        code[far] = np.array([_code(c) for c in found.tolist()], np.int32)[which]
    return code


def coded(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of words or of words with blanks, each between two edges, and their lengths.

    What is no letter is dropped, so characters put between letters leave the word as it was."""
    code = _coded("".join(units))
    owner = np.repeat(np.arange(len(units)), [len(w) for w in units])
    keep = code != 255
    code, owner = code[keep], owner[keep]
    n = np.bincount(owner, minlength=len(units))
    length = np.where(n, n + 2, 0)
    start = np.cumsum(length) - length
    out = np.full(length.sum(), EDGE, np.int32)
    out[start[owner] + 1 + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]] = code
    return out, length


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all texts in a row with one edge between words, the places of the edges, and
    the text that each word is of. Word k lies between edges k and k + 1.

    Three or more letters that stand alone one after the other are spelled as one word."""
    lower = [f" {t.lower()} " for t in texts]
    code = _coded("".join(lower))
    first = np.cumsum([0] + [len(t) for t in lower])
    at = np.flatnonzero(code != 255)
    code = code[at]
    edge = code == EDGE
    keep = np.ones(len(code), bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    code, at = code[keep], at[keep]
    edges = np.flatnonzero(code == EDGE)
    owner = np.searchsorted(first, at[edges[:-1] + 1], "right") - 1
    alone = np.diff(edges) == 2
    if alone.any():
        # Runs end where a longer word or another text begins.
        begin = np.ones(len(alone), bool)
        begin[1:] = (alone[1:] != alone[:-1]) | (owner[1:] != owner[:-1])
        run = np.cumsum(begin) - 1
        inside = alone & (np.bincount(run)[run] >= 3) & ~begin
        if inside.any():
            keep = np.ones(len(code), bool)
            keep[edges[:-1][inside]] = False
            code, owner = code[keep], owner[~inside]
            edges = np.flatnonzero(code == EDGE)
    return code, edges, owner


def words_of(text: str | None) -> list[str]:
    """The words of a text as they are spelled, without what is no letter."""
    code, _, _ = spelled([text or ""])
    points = np.where(code == EDGE, 32, np.where(code < EDGE, code + 97, code - OTHER))
    return points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split()


def _cut(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of pieces of at most ``PIECE`` that overlap by half, and what they are of.

    The last piece ends with its word."""
    count = np.where(length, 1 + np.maximum(0, -(-(length - PIECE) // (PIECE // 2))), 0)
    owner = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    size = np.minimum(PIECE, length[owner])
    return start[owner] + np.minimum(nth * (PIECE // 2), length[owner] - size), size, owner


def pieces(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of at most ``PIECE`` codes padded with 255, their lengths and the words they are of."""
    first, size, owner = _cut(np.cumsum(length) - length, length)
    at = first[:, None] + np.arange(PIECE)
    rows = np.where(np.arange(PIECE) < size[:, None], code[np.minimum(at, max(0, len(code) - 1))], 255)
    return rows.astype(np.int32), size, owner


def _norms() -> np.ndarray:
    """Root of the summed squared weights of all subsequences, by length."""
    n = np.arange(PIECE + 1)
    total = sum(np.maximum(0, n - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in STEPS)
    return np.sqrt(np.maximum(total, 1e-12))


NORMS = _norms()


def _hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places of subsequences that hold a letter beside a to z."""
    a, b, c = (v.astype(np.uint32) for v in (a, b, c))
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + c * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)
    return LETTERS ** 3 + (h >> np.uint32(32 - HASHED_BITS)).astype(np.int32)


def _places(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Places of subsequences. Those of a to z and edges have their own, the others hashed ones."""
    place = (x * LETTERS + y) * LETTERS + z
    other = (x | y | z) >= OTHER
    if other.any():
        place[other] = _hashed(x[other], y[other], z[other])
    return np.where(z == 255, PAD, place)


def subsequences(rows: np.ndarray):
    """For every pair of steps: the places of the three letters from each letter on, and their weight.
    Beyond a word the place is PAD."""
    plain = not (rows >= OTHER).any()
    for a, b in STEPS:
        w = rows.shape[1] - a - b
        if w > 0:
            x, y, z = rows[:, :w], rows[:, a:a + w], rows[:, a + b:a + b + w]
            place = np.where(z == 255, PAD, (x * LETTERS + y) * LETTERS + z) if plain else _places(x, y, z)
            yield place, DECAY ** (a + b + 1)


def explicit(words: list[str]) -> np.ndarray:
    """(word, feature) weights of all subsequences, normalised: for landmarks only."""
    rows, size, owner = pieces(*coded(words))
    out = np.zeros((len(words), PAD + 1), np.float32)
    for code, weight in subsequences(rows):
        np.add.at(out, (owner[:, None], code), np.float32(weight))
    out[:, -1] = 0
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values (word, landmark); a long word takes its best piece."""
    table = np.ascontiguousarray(landmarks.T)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), 500):
        rows, size, owner = pieces(*coded(words[at:at + 500]))
        rows = rows[:, :size.max(initial=0)]
        value = np.zeros((len(rows), len(landmarks)), np.float32)
        for code, weight in subsequences(rows):
            value += table[code].sum(1) * np.float32(weight)
        np.maximum.at(out, at + owner, value / NORMS[size][:, None].astype(np.float32))
    return out


class WindowScorer:
    """Decision values of windows of a text. The machine is linear in the landmarks' kernel values and
    these in the subsequences, so its weights fold into one number for each subsequence of three letters."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def scores(self, units: list[str]) -> np.ndarray:
        """Values of words, or of words with blanks; of a long one that of its best piece."""
        out = np.full(len(units), NO_WORD)
        if units:
            code, length = coded(units)
            first, size, owner = _cut(np.cumsum(length) - length, length)
            value = np.empty(len(first))
            self._fill(code, [(first, first + size - 1, value)])
            np.maximum.at(out, owner, value)
        return out

    def _sums(self, x: np.ndarray):
        """For every span: the sums of the weights of the subsequences that begin before each letter."""
        x = x.astype(np.int64)
        high, middle, other = x * LETTERS ** 2, x * LETTERS, x >= OTHER
        mixed = other.any()
        for span in range(2, SPAN):
            w = max(0, len(x) - span)
            sums = np.zeros(len(x) + 1)
            total = sums[1:w + 1]
            for a in range(1, span):
                place = high[:w] + middle[a:a + w]
                place += x[span:]
                if mixed:
                    some = np.flatnonzero(other[:w] | other[a:a + w] | other[span:])
                    place[some] = _hashed(x[some], x[some + a], x[some + span])
                total += self.weight.take(place)
            yield span, np.cumsum(sums) * DECAY ** (span + 1)

    def _fill(self, code: np.ndarray, sets: list) -> None:
        """Values of windows (first, last, value), which are sorted by their first letter."""
        for at in range(0, len(code), CHUNK):
            parts = []
            for first, last, value in sets:
                k = slice(*np.searchsorted(first, (at, at + CHUNK)))
                parts.append((first[k] - at, last[k] - at, value[k]))
            if not any(len(p[0]) for p in parts):
                continue
            for _, _, value in parts:
                value[:] = 0
            for span, sums in self._sums(code[at:at + CHUNK + PIECE]):
                for first, last, value in parts:
                    value += sums[np.maximum(last - span + 1, first)] - sums[first]
            for first, last, value in parts:
                value /= NORMS[last - first + 1]
                value += self.bias

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word of the texts: its text, its value, and the value of it and the next word.

        Of two words of more than ``PIECE`` letters the window is the middle, around the blank.
        The last word of a text has no next one."""
        code, edges, owner = spelled(texts)
        if not len(owner):
            return owner, np.zeros(0), np.zeros(0)
        first, size, word = _cut(edges[:-1], np.diff(edges) + 1)
        value = np.empty(len(first))
        two = np.flatnonzero(owner[1:] == owner[:-1])
        begin = np.maximum(edges[two], edges[two + 1] - PIECE // 2)
        end = np.minimum(edges[two + 2], edges[two + 1] + PIECE // 2 - 1)
        pair = np.empty(len(two))
        self._fill(code, [(first, first + size - 1, value), (begin, end, pair)])
        single, double = np.full(len(owner), NO_WORD), np.full(len(owner), NO_WORD)
        np.maximum.at(single, word, value)
        double[two] = pair
        return owner, single, double


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; the bias is the last column."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost * weight[active]
        new = np.linalg.solve(reg + xa.T @ (ca[:, None] * xa), xa.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = w + 0.8 * (new - w)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return w


def document_values(scorer: WindowScorer, batches, text_at: int):
    """For every batch: an array (document, value) of what ``VALUES`` names.

    Windows are every word and every two adjacent ones with the blank as a letter. Hits are words,
    and pairs of two that are no hits themselves."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        n = len(texts)
        out = np.zeros((n, len(VALUES)))
        out[:, 0] = out[:, 3] = NO_WORD
        group = np.cumsum([len(t) + 2 for t in texts]) // GROUP
        for k in np.unique(group):
            at = np.flatnonzero(group == k)
            owner, single, double = scorer.windows([texts[i] for i in at])
            if not len(owner):
                continue
            owner = at[owner]
            hit = single > SURE
            own = hit.copy()
            own[:-1] |= hit[1:]
            np.maximum.at(out[:, 0], owner, single)
            out[:, 1] += np.bincount(owner[hit], minlength=n)
            out[:, 2] += np.bincount(owner, minlength=n)
            np.maximum.at(out[:, 3], owner[~own], double[~own])
            out[:, 4] += np.bincount(owner[(double > SURE) & ~own], minlength=n)
        yield batch, out


def _features(x: np.ndarray) -> np.ndarray:
    best, over, count, pair, pairs = x.T
    return np.stack([
        np.clip(best, -3, 1.5), np.log1p(over), over > 0, 100 * over / np.maximum(count, 50),
        np.log(np.maximum(count, 20)), np.clip(pair, -3, 1.5), np.log1p(pairs)], 1).astype(float)


def _hardest(table: DataFrame, scorer: WindowScorer, n: int) -> list:
    """The n units (w, b) of the greatest value."""
    def value(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scorer.scores(words).astype(float))], names=["w", "b", "v"])

    found = table.select("w", "b").mapInArrow(value, "w string, b long, v double")
    return found.orderBy(F.desc("v"), "w").limit(n).collect()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    positive: int = 2500, negative: int = 7500, landmarks: int = 144, cost: float = 4.0,
    units: int = 3000, seed: int = 5,
) -> tuple[WindowScorer, np.ndarray] | None:
    """The machine and its calibration, from about ``positive`` toxic and ``negative`` clean texts.

    The sample is bounded and chosen by a hash of the id. Units are the words of a text and every two
    adjacent ones, with the blank as a letter; they carry the label of their text. Units far commoner in toxic
    texts are examples of one side (at most ``units`` words and as many pairs, the most significant), also with
    a blank put into the word; units of clean texts are those of the other, the 2,000 commonest words, five times ``units``
    words and pairs each chosen by hash, and in later rounds those that the machine took for toxic. A third of
    the landmarks is of each of these three kinds. A text's score is a logistic function of the greatest
    value of its windows and of the number and share of its hits.
    None where one of the labels has no text.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    known = marks.join(rows.select("id"), "id", "left_semi")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if 0 not in sizes or 1 not in sizes:
        return None
    share = F.when(F.col("y") == 1, positive / sizes[1]).otherwise(negative / sizes[0])
    place = F.abs(F.xxhash64(F.lit(seed), "id")) / F.lit(float(2 ** 63))
    # Ids are chosen first, so that of the texts only the sample is moved; its size is bounded.
    ids = known.withColumn("place", place).where(F.col("place") < share).orderBy("place", "id").limit(
        2 * (positive + negative)).select("id", "y")
    chosen = stored(rows.join(F.broadcast(ids), "id").select("text", "y").dropDuplicates(["text"]))

    def distinct(batches):
        for batch in batches:
            units, y = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                own = set(words)
                own.update(f"{v} {w}" for v, w in zip(words, words[1:]) if len(v) + len(w) <= PIECE - 3)
                units += own
                y += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(y, pa.int32())], names=["w", "y"])

    table = chosen.mapInArrow(distinct, "w string, y int").groupBy("w").agg(
        F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counts = chosen.groupBy("y").count().collect()
    n = {r.y: r["count"] for r in counts}
    if 0 not in n or 1 not in n:
        return None
    # The toxic side: significantly (G test) and at least four times commoner in toxic texts.
    rate = (F.col("a") + F.col("b")) / (n[0] + n[1])
    g = 2 * (F.col("a") * F.log(F.col("a") / (rate * n[1])) + F.coalesce(F.col("b") * F.log(F.col("b") / (rate * n[0])), F.lit(0.0)))
    odds = (F.col("a") / n[1]) / ((F.col("b") + 0.5) / n[0])
    table = stored(table.select("w", "a", "b", odds.alias("odds"), F.contains("w", F.lit(" ")).alias("two"), g.alias("g")))
    telling = table.where((F.col("a") >= 2) & (F.col("g") > 12) & (F.col("odds") > 4))
    toxic = telling.where(~F.col("two")).orderBy(F.desc("g"), "w").limit(units).collect()
    # Two words teach something of their own only where neither is toxic by itself.
    plain = ~F.exists(F.split("w", " "), lambda x: x.isin([r.w for r in toxic])) if toxic else F.lit(True)
    table = table.where(~F.col("two") | plain)
    # Among so many pairs many are commoner in toxic texts by chance, so they have to be surer.
    pairs = table.where("two").count()
    surer = F.col("two") & plain & (F.col("g") > 12 + 2 * np.log(max(1, pairs)))
    toxic += telling.where(surer).orderBy(F.desc("g"), "w").limit(units).collect()
    clean = table.where("b > 0 and odds < 2")
    common = clean.where(~F.col("two")).orderBy(F.desc("b"), "w").limit(2000).select("w", "b").collect()
    others = [r for two in (False, True) for r in clean.where(F.col("two") == two).orderBy(
        F.xxhash64("w"), "w").limit(5 * units).select("w", "b").collect()]
    if not toxic or not common:
        return None
    # Insults with a blank put in are examples as well, all those of a word as heavy as the word.
    parted = [(f"{r.w[:i]} {r.w[i:]}", min(30.0, r.a) / (len(r.w) - 1))
              for r in toxic if " " not in r.w and len(r.w) >= 4 for i in range(1, len(r.w))][:2 * units]
    # Rounds: the clean units that the last machine values most become examples and landmarks.
    hard: list = []
    for last in (False, False, True):
        third = landmarks // 3
        own = [r.w for r in toxic[:third]]
        own += [r.w for r in hard[:: max(1, len(hard) // third)]][:third]
        own += [r.w for r in common[:: max(1, len(common) // (landmarks - len(own)))]][:landmarks - len(own)]
        marks = explicit(own)
        size, base = np.linalg.eigh((marks @ marks.T).astype(float))
        keep = size > 1e-3
        root = base[:, keep] / np.sqrt(size[keep])
        other = [*common, *others, *hard]
        examples = [r.w for r in toxic] + [w for w, _ in parted] + [r.w for r in other]
        y = np.repeat([1.0, -1.0], [len(toxic) + len(parted), len(other)])
        weight = np.concatenate([
            [min(30.0, r.a) for r in toxic], [v for _, v in parted], [min(30.0, r.b) for r in other]])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum() / 4
        w, bias = _svm(kernel(examples, marks) @ root, y, weight / weight.mean(), cost)
        scorer = WindowScorer((root @ w) @ marks, bias)
        if not last:
            hard = _hardest(table.where("b > 0 and odds < 4"), scorer, 2000 + len(hard))

    def values(batches):
        for batch, found in document_values(scorer, batches, 0):
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, found.T)], names=["y", *VALUES])

    found = chosen.mapInArrow(values, "y int, " + ", ".join(f"{v} double" for v in VALUES)).toPandas()
    return scorer, _logistic(_features(found[VALUES].to_numpy()), found.y.to_numpy(float))


def toxicity(
    docs: DataFrame, model: tuple[WindowScorer, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text",
    extra: list[str] | None = None,
) -> DataFrame:
    """One row per document: (id, extra..., score, predicted).

    Every word and every two adjacent words of the whole text are read. Null and empty texts get the score of a text without a
    word; with nothing learned all scores are 0. Null ids and repeated rows are rows of their own.
    """
    def score(batches):
        if model is None:
            for batch in batches:
                yield rows_of(batch, np.zeros(batch.num_rows))
            return
        for batch, found in document_values(model[0], batches, 1):
            x = _features(found)
            yield rows_of(batch, 1 / (1 + np.exp(-np.clip(x @ model[1][:-1] + model[1][-1], -30, 30))))

    def rows_of(batch, value):
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
            names=["id", *(extra or []), "score", "predicted"])

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in extra or []))
    out = rows.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return rows.mapInArrow(score, out).withColumnRenamed("id", id_col)
