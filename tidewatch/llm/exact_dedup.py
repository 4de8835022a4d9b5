"""Exact deduplication by 128-bit content hash with a comparison of bytes."""

from pyspark.sql import Column, DataFrame, functions as F

from .common import keep_rows, stored


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    hash128: Column | None = None,
) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are grouped by an MD5 of their bytes; counts are combined before they are shuffled. Only
    groups of more than one row read their texts again: each is compared with the text of the row
    that would stay, and rows that differ in spite of equal hashes are grouped by the text itself.
    ``keep`` is the id that stays, ``smallest`` or ``largest``; ``hash128`` replaces the hash (tests).

    Null text counts as empty, so all empty and null texts are one group. A null id is greater than
    none: its row stays only where all ids of the group are null. Rows that repeat an id and a text
    all carry that id's mark. An empty table gives no rows; other columns are not looked at.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    key = F.md5(F.col("text").cast("binary")) if hash128 is None else hash128
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", key.alias("h"), "text")
    groups = rows.groupBy("h").agg(F.count("*").alias("n"), pick("id").alias("stays"))
    single = rows.select("id", "h", F.sha2("text", 256).alias("sha")).join(groups.where("n = 1"), "h").select(
        "id", F.col("stays").alias("keep_id"), F.col("n").alias("group_size"), "sha")

    # Written once: the texts of groups are read for the reference and for the comparison.
    several = stored(rows.join(groups.where("n > 1"), "h"))
    # Where rows repeat the id that stays, the smallest of their texts is the reference.
    reference = several.where("id <=> stays").groupBy("h").agg(F.min("text").alias("reference"))
    several = several.join(reference, "h").select(
        "h", "id", F.sha2("text", 256).alias("sha"),
        F.when(F.col("text") != F.col("reference"), F.col("text")).alias("other"))
    classes = several.groupBy("h", "other").agg(F.count("*").alias("group_size"), pick("id").alias("keep_id"))
    several = several.alias("r").join(
        classes.alias("c"), (F.col("r.h") == F.col("c.h")) & F.col("r.other").eqNullSafe(F.col("c.other")))
    both = single.unionByName(several.select("r.id", "keep_id", "group_size", "sha"))
    return both.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns."""
    return keep_rows(docs, exact_groups(docs, id_col, text_col, keep).where("kept"), id_col, text_col, "text_sha256")
