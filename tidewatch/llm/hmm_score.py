"""Language-model scores by a hidden Markov model trained with Baum-Welch counts."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

HEAD = 65_000      # commonest words with emissions of their own, at most
ENDINGS = 256      # classes of the other words, by their last three bytes
SYMBOLS = 1 + HEAD + ENDINGS
FLUSH = 300_000
CHUNK = 1_000_000  # tokens worked on together


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; the end token is the empty word."""
    return (text or "").encode().lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over one column of texts; counts are combined in the tasks before the shuffle."""
    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "c"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _commonest(counts: DataFrame) -> list:
    """The words of the highest counts, as many as fit in ``HEAD`` with all words of a like count.

    A histogram of counts (64 steps to a doubling) gives the least count, and only the words above
    it reach the driver; a top-k would send it as many rows from every partition."""
    level = F.floor(F.log2("c") * 64).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    least, total = 1 << 30, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        if (total := total + r.n) > HEAD:
            break
        least = r.level
    return counts.where(level >= least).collect()


class Vocabulary:
    """What the tasks need of the counts: bounded by ``HEAD`` and ``ENDINGS``."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c"), F.count("*")).first()
        self.tokens, self.types = total[0] or 0, total[1]
        head = sorted(_commonest(counts.where("octet_length(token) > 0")), key=lambda r: (-r.c, bytes(r.token)))
        self.symbol = {bytes(r.token): i for i, r in enumerate(head, 1)}
        ends = counts.where("octet_length(token) = 0").first()
        self.count = np.zeros(1 + HEAD)
        self.count[0] = ends.c if ends else 0
        self.count[1:1 + len(head)] = [r.c for r in head]
        # Words of a class share its emission: their shares inside it come from the counts.
        last = F.when(F.octet_length("token") <= 3, F.col("token")).otherwise(F.expr("substring(token, -3)"))
        sums = counts.groupBy(F.pmod(F.crc32(last), F.lit(ENDINGS)).cast("int").alias("k")).agg(
            F.sum("c").alias("n"), F.count("*").alias("v"))
        self.n, self.v = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for r in sums.collect():
            self.n[r.k], self.v[r.k] = r.n, r.v
        own = {**self.symbol, b"": 0} if ends else self.symbol
        for w, s in own.items():
            self.n[ending(w)] -= self.count[s]
            self.v[ending(w)] -= 1

    def share(self) -> np.ndarray:
        """Smoothed share of every symbol in the training tokens."""
        c = np.concatenate([self.count, self.n + 1])
        c[0] += 1
        return c / c.sum()


def encoded(docs: DataFrame, symbol: dict[bytes, int]) -> DataFrame:
    """Adds to rows (id, held_out, text): symbols (16-bit numbers), tail (rarer words), times."""
    def encode(batches):
        for batch in batches:
            symbols, tail, times, offsets = [], [], [], [0]
            for text in batch.column(2):
                found = words(text.as_py())
                at = [symbol.get(w, 0) for w in found]
                rare = Counter(w for w, s in zip(found, at) if not s)
                if rare:
                    at = [s or 1 + HEAD + ending(w) for w, s in zip(found, at)]
                at.append(0)
                symbols.append(np.array(at, "<u2").tobytes())
                tail.extend(rare.keys())
                times.extend(rare.values())
                offsets.append(len(tail))
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(symbols, pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(tail, pa.binary())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                names=["id", "held_out", "symbols", "tail", "times"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "held_out", "text").mapInArrow(
        encode, f"id {kind}, held_out boolean, symbols binary, tail array<binary>, times array<int>")


class Chain:
    """Initial, transition and emission probabilities; emissions are (symbol, state)."""

    def __init__(self, share: np.ndarray, states: int, seed: int):
        rng = np.random.default_rng(seed)
        self.share = share
        noisy = share[:, None] * np.exp(rng.normal(0, 0.5, (len(share), states)))
        self.emit = (noisy / noisy.sum(0)).astype(np.float32)
        self.move = (np.full((states, states), 0.05 / states) + 0.95 * np.eye(states)).astype(np.float32)
        self.first = np.full(states, 1 / states, np.float32)

    def update(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray, floor: float = 0.02) -> None:
        """New probabilities from expected counts; emissions keep ``floor`` of the common shares."""
        states = len(first)
        self.first = ((first + 1) / (first.sum() + states)).astype(np.float32)
        self.move = ((move + 1) / (move.sum(1, keepdims=True) + states)).astype(np.float32)
        own = emit / np.maximum(emit.sum(0), 1e-9)
        own = (1 - floor) * own + floor * self.share[:, None]
        self.emit = (own / own.sum(0)).astype(np.float32)

    def forward(self, docs: list[np.ndarray]):
        """Scaled forward pass over several documents at once, longest first.

        Positions are laid out time by time: all first tokens, then all second ones, and so on.
        Returns the layout, the symbols, where the tokens of each document stand, the emissions, the
        scaled states and the scales."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[i]) for i in order])
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        start = np.concatenate([[0], np.cumsum(active)])
        at = np.concatenate([start[:n] + row for row, n in enumerate(lengths)])
        symbol, owner = np.empty(start[-1], np.int64), np.repeat(order, lengths)
        symbol[at] = np.concatenate([docs[i] for i in order])
        emit = np.take(self.emit, symbol, 0)
        state, scale = np.empty_like(emit), np.empty(len(symbol), np.float32)
        now, ones = self.first, np.ones(len(self.first), np.float32)
        for t in range(len(active)):
            s = slice(start[t], start[t + 1])
            now = (now if t == 0 else now[:active[t]] @ self.move) * emit[s]
            total = now @ ones
            now /= total[:, None]
            state[s], scale[s] = now, total
        return active, start, symbol, (owner, at), emit, state, scale

    def log_likelihood(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's symbols."""
        *_, (owner, at), _, _, scale = self.forward(docs)
        return np.bincount(owner, np.log10(scale[at].astype(float)), len(docs))

    def expected(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of several documents: first states, moves, emissions."""
        active, start, symbol, _, emit, state, scale = self.forward(docs)
        states = len(self.first)
        moves = np.zeros((states, states))
        after = np.ones((active[0], states), np.float32)  # backward values of the later token
        emit /= scale[:, None]
        back = np.ascontiguousarray(self.move.T)
        for t in range(len(active) - 1, -1, -1):
            s = slice(start[t], start[t + 1])
            if t + 1 < len(active):
                n = active[t + 1]
                seen = emit[start[t + 1]:start[t + 2]] * after[:n]
                moves += state[s][:n].T.astype(float) @ seen
                np.matmul(seen, back, out=after[:n])
            state[s] *= after[:active[t]]
        moves *= self.move
        counts = np.stack([np.bincount(symbol, k, SYMBOLS) for k in state.T.astype(float, order="C")], 1)
        return state[:active[0]].sum(0, dtype=float), moves, counts


def _chunks(batches, column: int):
    """Symbol arrays of some documents at a time, and the rows they stand in.

    A chunk takes as many steps as its longest document has tokens, so the documents of a batch are
    chunked by length: the long ones meet in one chunk and the others take few steps."""
    for batch in batches:
        batch = batch.take(pc.array_sort_indices(pc.binary_length(batch.column(column)), order="descending"))
        docs, at, size = [], 0, 0
        for i, data in enumerate(batch.column(column)):
            docs.append(np.frombuffer(data.as_buffer(), "<u2"))
            size += len(docs[-1])
            if size >= CHUNK or i + 1 == batch.num_rows:
                yield docs, batch.slice(at, len(docs))
                docs, at, size = [], i + 1, 0


def train(symbols: DataFrame, share: np.ndarray, states: int = 8, rounds: int = 5, seed: int = 3) -> Chain:
    """Baum-Welch over one column of symbols. Each task sums the expected counts of its documents;
    these sums, a row per symbol, are added up in a shuffle, and only the totals, ``SYMBOLS`` rows,
    reach the driver."""
    chain = Chain(share, states, seed)
    names = [f"k{k}" for k in range(states)]

    def sums(batches):
        total = None
        for docs, _ in _chunks(batches, 0):
            found = chain.expected(docs)
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            rows = np.concatenate([total[2], total[1], total[0][None]])
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c) for c in rows[some].T)], names=["row", *names])

    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    for _ in range(rounds):
        totals = symbols.mapInArrow(sums, schema).groupBy("row").agg(*(F.sum(n).alias(n) for n in names))
        rows = np.zeros((SYMBOLS + states + 1, states))
        for r in totals.collect():
            rows[r[0]] = r[1:]
        chain.update(rows[-1], rows[SYMBOLS:-1], rows[:SYMBOLS])
    return chain


def hmm_scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 8,
    rounds: int = 5, seed: int = 3,
) -> DataFrame:
    """One row per document: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    All documents outside ``held_out`` are learned from. The ``HEAD`` commonest words and the end
    have emissions of their own in each latent state; every other word is emitted through the class
    of its last three bytes, inside which its share is (c+1) / (n+v+1) by the counts of the whole
    training text, one unknown word included. So states are trained on tables of bounded size while
    no word loses its count. The score is the exact probability by the scaled forward recursion
    over the whole text; the base score is that of the smoothed single words. Counts of rarer words
    are joined in a shuffle, as their number grows with the text.

    Null and empty texts are the end token alone. A null id is in fold 0 of the caller's rule;
    repeated rows are rows of their own. With nothing to learn from, all symbols are alike.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = stored(token_counts(rows.where("not held_out").select("text")))
    vocabulary = Vocabulary(counts)
    symbol = vocabulary.symbol
    coded = stored(encoded(rows, symbol).withColumn("row", F.monotonically_increasing_id()))
    chain = train(coded.where("not held_out").select("symbols"), vocabulary.share(), states, rounds, seed)

    n, v = vocabulary.tokens, vocabulary.types
    base = np.concatenate([np.log10(vocabulary.count + 1), np.zeros(ENDINGS)]) - np.log10(n + v + 1)
    inside = np.concatenate([np.zeros(1 + HEAD), -np.log10(vocabulary.n + vocabulary.v + 1)])
    known = np.concatenate([vocabulary.count > 0, np.zeros(ENDINGS, bool)])

    def score(batches):
        for docs, part in _chunks(batches, 3):
            flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            add = lambda x: np.bincount(owner, x[flat], len(docs))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([len(d) for d in docs], pa.int64()),
                 pa.array(add(known).astype(np.int64)), pa.array(add(base)),
                 pa.array(chain.log_likelihood(docs) + add(inside))],
                names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = coded.select("row", "id", "held_out", "symbols").mapInArrow(
        score, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    tail = coded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", "t.tail", "t.times")
    tail = tail.join(counts.withColumnRenamed("token", "tail"), "tail", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"))
    return scored.join(tail, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"))
