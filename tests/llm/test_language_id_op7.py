import numpy as np
from pyspark.sql import functions as F

from conftest_odd import ODD
from tidewatch.llm.common import table
from tidewatch.llm.language_id import WINDOW, ByteGRU, _cut, keep_known, languages, pooled, train


def test_gradients_are_those_of_the_loss():
    net = ByteGRU(3, 4, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, weight = rng.integers(0, 256, (7, 5)), np.array([0, 1, 2, 0, 1]), (rng.random((7, 5)) < 0.8).astype(float)

    def loss():
        s = np.concatenate([net._side(d, x) for d in "fb"], -1).astype(float) @ net.p["v"] + net.p["o"]
        s = s - np.log(np.exp(s).sum(-1, keepdims=True))
        return -(np.take_along_axis(s, y[None, :, None].repeat(7, 0), 2)[..., 0] * weight).sum() / weight.sum()

    grad = net.gradients(x, y, weight)
    for name in ("uf", "ub", "cf", "v", "o", "wb"):
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-3


def test_windows_cover_every_byte_once():
    for n in (0, 1, WINDOW, WINDOW + 1, 5 * WINDOW - 3):
        starts, fresh = _cut(np.zeros(n, np.uint8), WINDOW)
        seen = [i for s, f in zip(starts, fresh) for i in range(s + f, min(n, s + WINDOW))]
        assert sorted(seen) == list(range(n))


def test_held_out_accuracy_and_odd_documents(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~fold), steps=120)
    rows = languages(docs.where(fold), model, extra=["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    got = languages(odd, model).collect()
    assert len(got) == len(ODD)
    texts = {i: t for i, t in ODD}
    for r in got:
        if r.doc_id in (1, 2, 3, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0), texts[r.doc_id]
        elif r.doc_id is not None:
            assert r.lang_pred in model[1] and 0 < r.score <= 1
    assert languages(none, model).count() == 0 and train(none) is None
    assert {r.lang_pred for r in languages(odd, None).collect()} == {"und"}


def test_pooled_probabilities_equal_a_loop_over_windows():
    net = ByteGRU(3, 4, 1)
    texts = [b"abc de" * 40, "\u00e9\u00e8 x".encode(), b"q" * (3 * WINDOW + 5)]
    for text, mean in zip(texts, pooled(net, texts)):
        total, count = np.zeros(3), 0
        starts, fresh = _cut(np.frombuffer(text, np.uint8), WINDOW)
        for s, f in zip(starts, fresh):
            part = np.full(WINDOW, 32, np.uint8)
            part[:len(text[s:s + WINDOW])] = np.frombuffer(text[s:s + WINDOW], np.uint8)
            labels = net.labels(part[:, None].copy())[:, 0]
            for k in range(f, WINDOW):
                if part[k] >= 128 or chr(part[k]).isalpha():
                    total, count = total + labels[k], count + 1
        assert np.allclose(mean, total / count, atol=1e-5)


def test_every_language_is_learned(spark):
    """Seventy languages, each a letter of its own; the rarest has three texts."""
    rows = [(n, chr(0x4E00 + 97 * k) * 20 + " " + chr(0x4E00 + 97 * k) * 9, f"l{k:02}")
            for k in range(70) for n in range(3 if k == 69 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = train(docs, steps=1)
    assert model[1] == [f"l{k:02}" for k in range(70)]


def test_filter_of_odd_documents_and_without_labels(spark, odd, none):
    assert keep_known(odd, None).count() == len(ODD) and keep_known(none, None).count() == 0
    labelled = spark.createDataFrame(
        [(k, ("abc def " if k % 2 else "xyz uvw ") * 30, "p" if k % 2 else "q") for k in range(60)], "doc_id long, text string, lang string")
    model = train(labelled, steps=60)
    kept = keep_known(odd, model, 0.0)
    assert kept.columns == odd.columns and keep_known(none.select("doc_id", "text"), model).count() == 0
    letters = sorted(str((i, t)) for i, t in ODD if t and any(c.isalpha() for c in t))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == letters
    assert keep_known(labelled, model).count() >= 57
