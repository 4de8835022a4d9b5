"""The registered queries of this folder: each operator on its whole table, and its SQL."""

from .common import remainder, table
from .decontamination import contaminated
from .exact_dedup import exact_groups
from .hmm_score import hmm_scores
from .html_extraction import main_text
from .language_id import languages, train as train_languages
from .line_dedup import line_dedup
from .merkle import tamper_proofs
from .ngram_join import ngram_groups
from .oracles import ORACLES
from .packing import packed
from .sharding import shards
from .suffix_dedup import passage_dedup
from .toxicity import toxicity, train as train_toxicity
from .whitening import whitened


def _tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_template_extraction(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op2_hmm_score(spark, sf_dir):
    return hmm_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op3_kernel_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs.where(remainder("doc_id", 5) != 0), labels)
    held = docs.select("*", (remainder("doc_id", 5) == 0).alias("held_out"))
    return toxicity(held, model, extra=["held_out"])


def op4_pattern_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), _tokenizer(), capacity=2048)


def op5_pigeonhole_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark, sf_dir):
    return passage_dedup(table(spark, sf_dir, "documents"))


def op7_byte_gru_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(remainder("doc_id", 4) != 2))
    held = docs.select("*", (remainder("doc_id", 4) == 2).alias("held_out"))
    return languages(held, model, extra=["held_out"])


def op8_feistel_shards(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"), n_shards=24)


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    return tamper_proofs(docs, remainder("doc_id", 3) == 0, fields)


def op12_embedding_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_template_extraction, op2_hmm_score, op3_kernel_toxicity, op4_pattern_packing, op5_pigeonhole_decontamination,
    op6_suffix_dedup, op7_byte_gru_language, op8_feistel_shards, op9_exact_dedup, op10_ngram_jaccard_join,
    op11_merkle_manifest, op12_embedding_whitening, op13_line_dedup)}
