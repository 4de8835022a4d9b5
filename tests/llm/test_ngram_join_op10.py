import random

import pytest

from conftest_odd import ODD
from tidewatch.llm import ngram_join
from tidewatch.llm.common import components
from tidewatch.llm.ngram_join import drop_near_copies, ngram_groups


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def texts(seed, n=90):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(200)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 80))] for _ in range(7)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(40)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return out


@pytest.mark.parametrize("docs,n,percent,dense", [(768, 5, 80, 48), (3, 4, 85, 2), (5, 1, 50, 3)])
def test_random_documents(make, monkeypatch, docs, n, percent, dense):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    rows = texts(docs)
    got = sorted(map(tuple, ngram_groups(make(*rows), n=n, percent=percent).collect()), key=str)
    assert got == brute(list(enumerate(rows)), n, percent)


def test_odd_documents(odd, none):
    assert sorted(map(tuple, ngram_groups(odd).collect()), key=str) == brute(ODD)
    assert ngram_groups(none).count() == 0
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted([1, 2, 3, 4, 4, 5, None, None, 7, 9, 10], key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(200, 240)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)] + [(7, 7), (None, 3)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            group[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in group}
