"""Lookup of words, known and unknown, one by one and in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.vector import l2_norm, l2_normalize, scale, to_float
from wordloom.model import EmbeddingModel
from wordloom.operators.subwords import pooled, subword_indices


def word_index(queries: DataFrame, model: EmbeddingModel) -> DataFrame:
    """word, word_idx, subword_idx: for each distinct word its row, or else the rows of its
    n-grams, repeats kept and sorted; both null if there is neither."""
    asked = queries.select("word").where("word is not null").distinct()
    known = asked.join(model.words.select("word", F.col("idx").alias("word_idx")), "word", "left")
    if model.subwords is None:
        return known.withColumn("subword_idx", F.lit(None).cast("array<long>"))
    missing = known.where("word_idx is null").select("word")
    listed = subword_indices(missing, model.subwords).groupBy("word").agg(
        F.array_sort(
            F.flatten(F.collect_list(F.array_repeat(F.col("bucket") + F.lit(model.words_len), F.col("n").cast("int"))))
        ).alias("subword_idx")
    )
    return known.join(listed, "word", "left").select("word", "word_idx", "subword_idx")


def known_words(indices: DataFrame) -> DataFrame:
    return indices.where("word_idx is not null")


def unknown_words(indices: DataFrame) -> DataFrame:
    return indices.where("word_idx is null and subword_idx is not null")


def lookup_distinct(queries: DataFrame, model: EmbeddingModel) -> DataFrame:
    """word, embedding, norm of the distinct words that have a vector.

    A known word has its row and stored norm, 1 if there is none; an unknown one the sum of its
    n-gram rows, normalized, and the norm of the sum.  Only unknown words are taken apart.
    """
    asked = queries.select("word").where("word is not null").distinct()
    if model.subwords is None or model.buckets is None:
        return asked.join(model.words, "word").select("word", "embedding", F.coalesce("norm", F.lit(1.0)).cast("double").alias("norm"))
    known = asked.join(model.words.select("word", "embedding", "norm", F.lit(True).alias("is_known")), "word", "left")
    missing = known.where("is_known is null").select("word")
    total = pooled(missing, model).withColumn("length", l2_norm(F.col("total")))
    made = total.select("word", to_float(l2_normalize(F.col("total"), F.col("length"))).alias("embedding"), F.col("length").alias("norm"))
    have = known.where("is_known").select("word", "embedding", F.coalesce("norm", F.lit(1.0)).cast("double").alias("norm"))
    return have.unionByName(made)


def lookup_batch(queries: DataFrame, model: EmbeddingModel) -> DataFrame:
    """pos, word, embedding, norm, found, in any order: every query keeps its place.

    ``queries``: pos, word; other columns are ignored.  Each distinct word is looked up once.  A
    word without a vector, null among them, gets zeros and ``found`` false.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("float"), model.dims)
    found = lookup_distinct(queries, model).withColumn("found", F.lit(True))
    return queries.select("pos", "word").join(found, "word", "left").select(
        "pos", "word", F.coalesce("embedding", zeros).alias("embedding"), "norm", F.coalesce("found", F.lit(False)).alias("found")
    )


def unnormalized(rows: DataFrame) -> DataFrame:
    """Rows with embedding times norm; a null norm counts as 1."""
    return rows.withColumn("embedding", to_float(scale(F.col("embedding"), F.coalesce(F.col("norm"), F.lit(1.0)).cast("double"))))


def iter_words(model: EmbeddingModel, with_norms: bool = False) -> DataFrame:
    """The words in order of the vocabulary; sub-words are no part of it."""
    columns = ["word", "embedding"] + ([F.coalesce("norm", F.lit(1.0)).cast("float").alias("norm")] if with_norms else [])
    return model.words.orderBy("idx").select(*columns)


def gather(indices: DataFrame, model: EmbeddingModel) -> DataFrame:
    """pos, idx, embedding: rows of the matrix by number, repeats kept.  ``indices``: pos, idx."""
    return indices.select("pos", "idx").join(model.storage(), "idx").select("pos", "idx", "embedding")


def clone_from_mapping(mapping: DataFrame, model: EmbeddingModel) -> DataFrame:
    """idx, embedding of a new matrix whose row new_idx is the old row old_idx."""
    asked = mapping.select(F.col("new_idx").alias("pos"), F.col("old_idx").alias("idx"))
    return gather(asked, model).select(F.col("pos").alias("idx"), "embedding")
