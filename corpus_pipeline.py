"""A training corpus from raw documents: language, copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import stored, table
from tidewatch.llm.decontamination import drop_contaminated
from tidewatch.llm.exact_dedup import drop_copies
from tidewatch.llm.language_id import keep_known, train
from tidewatch.llm.ngram_join import drop_near_copies
from tidewatch.llm.packing import packed

LEAST_SCORE = 0.5
CAPACITY = 2048


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; ``und`` and mixed ones (score below a half) go."""
    return keep_known(docs, train(docs), LEAST_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 of five-word shingles hold together."""
    return drop_near_copies(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of at most ``CAPACITY`` tokens."""
    import public_tokenizers
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("language", known_language),
    ("copies", without_copies),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("packing", packed_sequences),
]

ORACLE_SQL = None  # a network's labels cannot be had from SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each on the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
