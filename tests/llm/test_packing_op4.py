import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from conftest_odd import ODD
from tidewatch.llm.packing import WordEncoder, packed, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("abET's.,!-<|>0 9\n\t\xa0éÉßẞöñÿ́İΣ日😀endoftxsar"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_encode_as_the_tokenizer_does(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_special_tokens():
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "DON'T i'll 's x,'s"):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
@settings(max_examples=150, deadline=None)
def test_plan_holds_exactly_the_documents(counts):
    found = plan(counts, 64)
    assert all(sum(p) <= 64 for p, _ in found)
    used = Counter()
    for p, n in found:
        for a in p:
            used[a] += n
    assert dict(used) == counts
    total = sum(a * n for a, n in counts.items())
    assert sum(n for _, n in found) <= 2 * -(-total // 64) + 1


def test_odd_documents(odd, none):
    rows = packed(odd, PATH, 256).collect()
    assert packed(none, PATH, 256).count() == 0
    want = []
    for i, t in ODD:
        x = ids(t) + [0]
        for k, at in enumerate(range(0, len(x), 256)):
            part = x[at:at + 256]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256


@pytest.mark.parametrize("capacity", [1, 2])
def test_tiny_sequences(make, capacity):
    rows = packed(make("a b c", ""), PATH, capacity).collect()
    assert sum(r.length for r in rows) == 5 and max(r.length for r in rows) <= capacity
