"""Every stage of the pipeline against brute force on the documents it was given."""

from test_decontamination_op5 import edit
from test_ngram_join_op10 import brute

import corpus_pipeline
from pyspark.sql import functions as F
from tidewatch.llm.common import stored, table
from tidewatch.llm.decontamination import budget, plain
from tidewatch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    given = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.lang for r in docs.collect()}
    columns = docs.columns
    bench = [plain(r.text).strip() for r in table(spark, FOLDER, "benchmark").collect()]
    for (name, stage), step in zip(corpus_pipeline.STAGES, range(5)):
        docs = stored(stage(spark, docs, FOLDER))
        rows = docs.collect()
        if step < 4:
            assert docs.columns == columns
            kept = {r.doc_id: r.text for r in rows}
            assert len(kept) == len(rows) and all(given[i] == t for i, t in kept.items())
        if step == 0:
            assert len(kept) >= 0.97 * len(given) and all(labels[i] for i in kept)
        if step == 1:
            least = {}
            for i in sorted(given):
                least.setdefault(given[i], i)
            assert set(kept) == set(least.values())
        if step == 2:
            assert set(kept) == {c for _, _, c in brute(sorted(given.items()))}
        if step == 3:
            gone = {i for i, t in given.items() if any(b in plain(t) for b in bench)}
            assert gone and gone.isdisjoint(kept)
            for i in set(given) - set(kept) - gone:
                assert any(edit(b, plain(given[i])) <= budget(len(b)) for b in bench)
        if step == 4:
            assert {r.doc_id for r in rows} == set(given)
            ends = {}
            for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == ends.get(r.sequence_id, 0)
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values()) <= corpus_pipeline.CAPACITY
        given = kept if step < 4 else given


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_tables_without_labels_or_rows(spark, tmp_path):
    """Where no document has a label the language stage keeps all; an empty table passes every stage."""
    table(spark, FOLDER, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, FOLDER, "documents").limit(40).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 40
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0, name
