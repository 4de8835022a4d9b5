import random
from collections import Counter

import numpy as np

from tidewatch.llm.toxicity import (
    CHUNK, DECAY, NO_WORD, PIECE, SPAN, WindowScorer, explicit, kernel, toxicity, train, words_of)


def subsequences(word):
    x, out = f"^{word}^", Counter()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            for k in range(j + 1, min(len(x), i + SPAN)):
                out[x[i] + x[j] + x[k]] += DECAY ** (k - i + 1)
    return out


def test_kernel_is_that_of_weighted_subsequences():
    words, marks = ["idiot", "idxiot", "moron", "tree"], ["idiot", "moron"]
    got = kernel(words, explicit(marks))
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = subsequences(w), subsequences(m)
            occurrences = sum(DECAY ** (2 * (k - i0 + 1)) for i0 in range(len(w) + 2) for j0 in range(i0 + 1, len(w) + 2)
                              for k in range(j0 + 1, min(len(w) + 2, i0 + SPAN)))
            want = sum(a[f] * b[f] for f in a) / occurrences ** 0.5 / sum(v * v for v in b.values()) ** 0.5
            assert abs(got[i, j] - want) < 1e-4
    assert got[1, 0] > 0.5 > got[3, 0]


def brute(marks, weights, bias, unit):
    """Decision value of a unit from its own subsequences, without folded weights."""
    return float(kernel([unit], marks)[0] @ weights) + bias


def test_windows_equal_their_units_one_by_one():
    rng = random.Random(3)
    insults = ["idiot", "drop dead", "дурак", "élan vital"]
    marks, weights = explicit(insults), np.array([1.0, 0.7, 0.9, -0.4])
    scorer = WindowScorer(weights @ marks, -0.2)
    words = ["idiot", "id", "iot", "drop", "dead", "дурак", "é", "vital", "a-b", "...", "42", "x" * 40, "straße", "\u3000", "I.D"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(200)]
    texts.append(" ".join(rng.choices(words, k=3 * CHUNK // 4)))
    texts += ["", "  ", "...", "one"]
    owner, single, double = scorer.windows(texts)
    seen = {}

    def value(unit):
        if unit not in seen:
            seen[unit] = brute(marks, weights, -0.2, unit)
        return seen[unit]

    at = 0
    for i, text in enumerate(texts):
        spelled = words_of(text)
        for k, word in enumerate(spelled):
            assert owner[at] == i and abs(single[at] - value(word)) < 1e-4
            if k + 1 == len(spelled):
                assert double[at] == NO_WORD
            elif len(word) + len(spelled[k + 1]) <= PIECE - 3:
                assert abs(double[at] - value(f"{word} {spelled[k + 1]}")) < 1e-4
            at += 1
    assert at == len(owner)


def test_words_are_spelled_without_marks():
    assert words_of("An i.d.i.o.t, 42 Й\u00a0\u3000x!") == ["an", "idiot", "й", "x"]
    assert words_of("you i d i o t now") == ["you", "idiot", "now"]
    assert words_of("a b see") == ["a", "b", "see"]
    assert words_of(None) == words_of(" 1 ") == []


def corpus(n, seed):
    rng = random.Random(seed)
    part = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(part, k=rng.randint(1, 3))) for _ in range(60)]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(60), rng.choice(["idiot", "stupid", "clown", "worthless"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_gapped_and_inserted_insults(spark, odd, none):
    rows, labels = corpus(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(999, None), (None, 1)], "doc_id long, toxic int")
    model = train(docs, marks)
    fresh, truth = corpus(80, 2)
    clean = fresh[1][1]
    for k, bad in enumerate(["you are an i.d.i.o.t", "such a stuupid clo-wn", "an i d i o t and w o r t h l e s s"], 100):
        fresh.append((k, f"{clean} {bad}"))
    got = {r.doc_id: r for r in toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    right = sum(got[i].predicted == y for i, y in truth)
    assert right >= 78
    assert all(got[k].score > got[1].score for k in (100, 101, 102))
    rows = toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity(none, model).count() == 0
    assert train(none, marks) is None and train(docs, marks.where("toxic = 1")) is None
    assert {r.score for r in toxicity(odd, None).collect()} == {0.0}
    assert np.isfinite(model[1]).all()


def test_letters_of_all_scripts_stay_distinct():
    for bad, same_length in (("дурак", "школа"), ("βλάκας", "θάλασσ"), ("غبي", "بيت"), ("मूर्ख", "मार्ग"), ("笨蛋", "学校"), ("éàü", "ûáé")):
        value = kernel([bad, same_length], explicit([bad]))
        assert value[0, 0] > 0.5 > value[1, 0], bad


def test_insults_in_another_script(spark):
    letters = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшжыз")
    rows, labels = corpus(400, 3)
    model = train(
        spark.createDataFrame([(i, t.translate(letters)) for i, t in rows], "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"))
    fresh, truth = corpus(80, 4)
    got = {r.doc_id: r.predicted for r in toxicity(spark.createDataFrame(
        [(i, t.translate(letters)) for i, t in fresh], "doc_id long, text string"), model).collect()}
    assert sum(got[i] == y for i, y in truth) >= 78


def test_two_words_that_are_toxic_only_together(spark):
    rng = random.Random(7)
    part = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]

    def text(i):
        words = ["".join(rng.choices(part, k=rng.randint(1, 3))) for _ in range(60)]
        for w in (("drop dead",) if i % 4 == 0 else ("drop", "dead")):
            words.insert(rng.randrange(60), w)
        return " ".join(words)

    rows, fresh = [(i, text(i)) for i in range(600)], [(i, text(i)) for i in range(200)]
    model = train(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert sum(got[i] == (i % 4 == 0) for i, _ in fresh) >= 196


def test_insults_with_a_blank_put_in(spark):
    rows, labels = corpus(400, 1)
    model = train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = [t for i, t in corpus(80, 6)[0] if i % 4]
    parted = ["id iot", "st upid", "worth less", "clo wn"]
    _, single, double = model[0].windows(clean)
    assert min(model[0].scores(parted)) > 0.6 > 0 > max(single.max(), double.max())
    # Toxic texts of the corpus hold three insults each.
    texts = clean + [f"{t} {' '.join(random.Random(k).sample(parted, 3))}" for k, t in enumerate(clean[:20])]
    got = toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    found = {r.doc_id: r.predicted for r in got}
    assert sum(found[i] for i in range(len(clean))) <= 1
    assert sum(found[i] for i in range(len(clean), len(texts))) == 20
