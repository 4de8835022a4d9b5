import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest_odd import ODD
from tidewatch.llm import hmm_score
from tidewatch.llm.hmm_score import SYMBOLS, Chain, hmm_scores, words


def chain(states=3, symbols=6, seed=1):
    share = np.zeros(SYMBOLS)
    share[:symbols] = 1 / symbols
    return Chain(share + 1e-12, states, seed)


def by_paths(c, doc):
    """Probability as a sum over all sequences of states, and expected moves."""
    total, moves = 0.0, np.zeros_like(c.move, dtype=float)
    for path in itertools.product(range(len(c.first)), repeat=len(doc)):
        p = float(c.first[path[0]]) * float(c.emit[doc[0], path[0]])
        for a, b, s in zip(path, path[1:], doc[1:]):
            p *= float(c.move[a, b]) * float(c.emit[s, b])
        total += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    return total, moves / total


def test_forward_and_counts_equal_sums_over_paths():
    c = chain()
    docs = [np.array(d) for d in ([1, 2, 3, 0], [0], [5, 5, 1, 4, 0], [2, 0])]
    want = [by_paths(c, d) for d in docs]
    assert np.allclose(c.log_likelihood(docs), [math.log10(p) for p, _ in want], atol=1e-5)
    first, moves, emit = c.expected(docs)
    assert np.allclose(moves, sum(m for _, m in want), atol=1e-4)
    assert np.allclose(first.sum(), 4, atol=1e-4) and np.allclose(emit.sum(1)[:6], np.bincount(np.concatenate(docs), minlength=6), atol=1e-4)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    docs = [np.concatenate([rng.choice([1, 2] if k % 2 else [3, 4], 30), [0]]) for k in range(40)]
    c = chain(2, 6, 4)
    before = c.log_likelihood(docs).sum()
    for _ in range(8):
        c.update(*c.expected(docs))
    assert c.log_likelihood(docs).sum() > before + 50


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_odd_documents_against_brute_force(odd, none, monkeypatch):
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) == 2
    rows = hmm_scores(odd, fold, rounds=2, states=3).collect()
    count = Counter()
    for i, t in ODD:
        if not held(i):
            count.update(words(t) + [b""])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in ODD:
        tokens = words(t) + [b""]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in rows)
    assert hmm_scores(none, fold, rounds=1).count() == 0
    alone = hmm_scores(odd, F.lit(True), rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in alone)


def test_words_split_at_ascii_white_space_only():
    assert words("A\x0bb\x1cC D e") == [b"a", b"b\x1cc\xc2\xa0d", b"e"]
    assert words("ÀB") == ["Àb".encode()] and words(None) == []
    assert hmm_score.ending(b"xabc") == hmm_score.ending(b"abc")


def test_long_documents_are_worked_on_together(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(hmm_score, "CHUNK", 1000)
    lengths = [3, 900, 2, 5, 800, 4, 700, 1] * 4
    docs = [np.full(n, i, "<u2").tobytes() for i, n in enumerate(lengths)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.binary())], names=["id", "symbols"])
    chunks = [([len(d) for d in found], [d[0] for d in found], part.column(0).to_pylist()) for found, part in hmm_score._chunks([batch], 1)]
    assert all(symbols == ids for _, symbols, ids in chunks)
    assert sorted(i for _, _, ids in chunks for i in ids) == list(range(len(docs)))
    assert sum(max(n) for n, _, _ in chunks) < sum(lengths) / 1.5
    assert max(chunks[-1][0]) <= 700
