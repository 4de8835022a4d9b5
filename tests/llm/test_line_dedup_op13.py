import hashlib
from collections import defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from conftest_odd import ODD
from tidewatch.llm.line_dedup import Bloom, keys_of, line_dedup, suspected
from tidewatch.llm.queries import ORACLES, QUERIES
from tidewatch.llm.repeats import NOBODY

SF = "/root/testdata/sf0.001"


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)


def brute(rows, least=10):
    """rows of (id, text), each a document, in order: (id, n_lines, n_dropped, sha256)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    lines = [(t or "").split("\n") for _, t in rows]
    holders = defaultdict(set)
    for k, doc in enumerate(lines):
        for line in doc:
            holders[key(line)].add(k)
    out = []
    for k, doc in enumerate(lines):
        kept = [x for x in doc if len(key(x)) < least or min(holders[key(x)]) == k]
        out.append((rows[k][0], len(doc), len(doc) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@given(st.lists(st.lists(st.integers(0, 300), max_size=30), min_size=1, max_size=12), st.sets(st.integers(0, 300), max_size=5))
@settings(max_examples=100, deadline=None)
def test_filters_lose_no_repeat(rows, marks):
    chunks, at = [], defaultdict(int)
    for k, keys in enumerate(rows):
        keys = np.unique(np.array(keys, np.uint32))
        chunks.append((np.full(len(keys), k, np.int64), keys))
        for x in keys.tolist():
            at[x] += 1
    chunks.append((np.full(len(marks), NOBODY, np.int64), np.array(sorted(marks), np.uint32)))
    masks = suspected(chunks)
    for (row, keys), mask in zip(chunks, masks):
        for r, x, m in zip(row.tolist(), keys.tolist(), mask.tolist()):
            assert not m if r == NOBODY else m or at[x] < 2 and x not in marks


def test_few_single_keys_are_suspected():
    rng = np.random.default_rng(1)
    keys = rng.permutation(1 << 32 >> 10)[:200_000].astype(np.uint32) * np.uint32(977)
    chunks = [(np.full(20_000, k, np.int64), np.unique(part)) for k, part in enumerate(np.split(keys, 10))]
    assert np.concatenate(suspected(chunks)).mean() < 0.1
    bloom = Bloom(1000)
    bloom.add(bloom.places(keys[:1000]))
    assert bloom.holds(bloom.places(keys[:1000])).all() and bloom.holds(bloom.places(keys[1000:])).mean() < 0.1


def test_keys():
    data = " \tABCDEFGHIJ\x0c\r\nshort\n äÖäÖäÖäÖÄ\nÉÉÉÉÉÉÉÉÉ\n".encode()
    assert keys_of(data, 10) == [(0, b"abcdefghij"), (2, " äÖäÖäÖäÖÄ".encode())]


def test_lines_of_copies_and_common_lines(make):
    line = "a line that is common"
    texts = [f"own line number {k}\n{line}\n\nshort\n  {line.upper()} \n{'x' * (k % 13)}" for k in range(60)]
    texts += [texts[0], texts[0], line, f"{line}\n{line}", "", None, "\n\n", texts[5].lower()]
    rows = list(enumerate(texts))
    assert found(line_dedup(make(*texts))) == brute(rows)
    kept = {r.doc_id: r.kept for r in line_dedup(make(*texts), kept_text=True).collect()}
    assert kept[0] == texts[0] and kept[60] == "\nshort\n" + "x" * 0 and kept[62] == "" and kept[64] == ""
    assert found(line_dedup(make(*texts), least=2)) == brute(rows, 2)


def test_odd_documents(odd, none):
    assert found(line_dedup(odd)) == brute(ODD)
    assert line_dedup(none).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES["op13_line_dedup"](spark, SF), con.execute(ORACLES["op13_line_dedup"]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and want.n_dropped.sum() > 0
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want[columns].itertuples(index=False, name=None))
