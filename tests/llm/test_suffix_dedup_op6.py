import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from conftest_odd import ODD
from tidewatch.llm import suffix_dedup
from tidewatch.llm.suffix_dedup import COVER, LENGTH, passage_dedup, removed_runs, samples


def brute(texts):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - LENGTH + 1):
            if (w := raw[k:k + LENGTH]) in seen:
                gone[k:k + LENGTH] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    out = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(3), rng.choice(passage)[rng.randint(0, 30):])
        out.append(" ".join(parts))
    return [*out, "ab" * 150, "x" * 99, "x" * 101, out[3], None, "", out[3][:150], "q" * 400]


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 2])
def test_random_documents(make, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rows = texts(many)
    got = {r.doc_id: tuple(r)[1:] for r in passage_dedup(make(*rows)).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


def test_odd_documents(odd, none):
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = [(i, *x) for (i, _), x in zip(order, brute([t for _, t in order]))]
    assert sorted(map(tuple, passage_dedup(odd).collect()), key=str) == sorted(want, key=str)
    assert passage_dedup(none).count() == 0
    assert passage_dedup(odd, kept_text=True).columns[-1] == "kept"


@given(st.binary(max_size=700).map(lambda b: bytes(x % 3 for x in b)))
@settings(max_examples=60, deadline=None)
def test_equal_windows_belong_to_suffixes_at_the_same_distance(raw):
    distance, seen = {}, []
    for place, first, last, _ in samples(np.frombuffer(raw, np.uint8)):
        for p, a, b in zip(place.tolist(), first.tolist(), last.tolist()):
            for i in range(a, b + 1):
                seen.append(i)
                assert 0 <= p - i < COVER and distance.setdefault(raw[i:i + LENGTH], p - i) == p - i
    assert seen == list(range(max(0, len(raw) - LENGTH + 1)))


def test_masks():
    gone = removed_runs(300, [(10, 73, -(1 << 63) | 0b1011), (120, 130, None)])
    want = np.zeros(300, bool)
    for s in (10, 11, 13, 73, *range(120, 131)):
        want[s:s + LENGTH] = True
    assert (gone == want).all()
