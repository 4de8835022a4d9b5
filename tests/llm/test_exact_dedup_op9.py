import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from conftest_odd import ODD
from tidewatch.llm.exact_dedup import drop_copies, exact_groups


def brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_documents(odd):
    assert found(exact_groups(odd, keep="largest")) == brute(ODD, max)
    assert found(exact_groups(odd)) == brute(ODD, min)


def test_equal_hashes_of_different_texts(make):
    texts = ["a", "b", "a", "c", "b", "b"]
    one = exact_groups(make(*texts), hash128=F.lit("same"))
    assert found(one) == brute(list(enumerate(texts)), min)


def test_empty_table_and_filter(odd, none):
    assert exact_groups(none).count() == 0 and drop_copies(none).count() == 0
    kept = drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in ODD})
