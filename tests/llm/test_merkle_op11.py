import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest_odd import ODD
from tidewatch.llm.merkle import folded, leaf_hash, manifest, proof_digest, tamper_proofs
from tidewatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes):
    """Root of a list of hashes, and every node's list of levels (left, right)."""
    proofs = [[] for _ in nodes]
    spans = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_spans = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at:at + 8]
            for k in range(len(run)):
                for leaf in spans[at + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h("".join(run)))
            up_spans.append([x for s in spans[at:at + 8] for x in s])
        nodes, spans = up, up_spans
    return nodes[0], proofs


def brute(rows):
    """rows of (id, lang, leaf): (id, leaf, subroot, root, proof)."""
    parts = defaultdict(list)
    for r in rows:
        parts[r[1]].append(r)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    for p in order:
        parts[p].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    trees = {p: grown([r[2] for r in parts[p]]) for p in order}
    root, above = grown([trees[p][0] for p in order])
    return sorted(
        ((r[0], r[2], trees[p][0], root, tuple(trees[p][1][k] + above[i]))
         for i, p in enumerate(order) for k, r in enumerate(parts[p])), key=str)


def found(df):
    return sorted(((r[0], r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in df.collect()), key=str)


def test_trees_of_many_sizes(spark):
    sizes = {None: 3, "": 1, "a": 8, "b": 9, "c": 64, "d": 65, "é": 513, "z": 1100, "Z": 2, "zz": 520}
    rows = [(k, p) for p, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string").repartition(5)
    df = manifest(docs, leaf_hash(F.col("doc_id"), F.col("lang")))
    got = found(df)
    assert got == brute([(i, p, leaf_of(i, p)) for i, p in rows])
    assert df.where(folded(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_one_part(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"))
    assert found(manifest(docs, leaf_hash(F.col("doc_id")))) == brute([(i, "x", leaf_of(i)) for i in range(n)])


def test_many_parts(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"))
    assert found(manifest(docs, leaf_hash(F.col("doc_id")))) == brute([(i, str(i), leaf_of(i)) for i in range(700)])


def test_tampered_rows_do_not_fold_to_the_root(spark):
    texts = [None, "", "lower", "Upper É", "ÀÉ only", "MIXED case"]
    rows = [(k, None if k % 3 else "s", "en" if k % 4 else None, len(t or ""), t) for k, t in enumerate(texts * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = tamper_proofs(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ("doc_id", "source", "lang", "n_chars", "text"))
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0 and any(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in r[4] or "")}
    assert changed and {r.doc_id for r in out.collect() if not r.verified} == changed
    want = {r[0]: r for r in brute([(r[0], r[2], leaf_of(*r)) for r in rows])}
    for r in out.collect():
        acc = leaf_of(*rows[r.doc_id]) if r.doc_id not in changed else leaf_of(
            *rows[r.doc_id][:4], "".join(c.lower() if c < "\x7f" else c for c in rows[r.doc_id][4]))
        for left, right in want[r.doc_id][4]:
            acc = h(left + acc + right)
        assert (r.leaf, r.subroot, r.root) == want[r.doc_id][1:4] and r.folded_root == acc
        assert r.proof_sha256 == h("".join(a + b for a, b in want[r.doc_id][4]))


def test_odd_documents(odd, none):
    df = manifest(odd, leaf_hash(F.col("doc_id"), F.col("text")), part="lang")
    assert found(df) == brute([(i, f"x{i}", leaf_of(i, t)) for i, t in ODD])
    assert manifest(none, leaf_hash(F.col("doc_id"))).count() == 0
    empty = none.selectExpr("doc_id", "text", "lang", "lang AS source", "doc_id AS n_chars")
    assert tamper_proofs(empty, F.lit(True), ("doc_id", "text")).count() == 0
    one = manifest(odd.limit(1), leaf_hash(F.col("doc_id"))).select("leaf", "subroot", "root", proof_digest(F.col("proof"))).first()
    assert one[0] == one[1] == one[2] and one[3] == h("")


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    name = "op11_merkle_manifest"
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(
        want[columns].itertuples(index=False, name=None), key=str)
    assert Path(SF).exists() and not want.verified.all()
