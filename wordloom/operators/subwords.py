"""Sub-word indices of words, pooled vectors and the composition of word vectors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.errors import ConversionError, NGramConversionError
from wordloom.functions import ngrams as g
from wordloom.functions.indexers import ExplicitIndexer, FloretIndexer
from wordloom.functions.vector import add, l2_norm, pooled_array, pooled_sum, scale, subtract, to_float
from wordloom.model import EmbeddingModel, Subwords


def ngram_rows(words: DataFrame, subwords: Subwords) -> DataFrame:
    """word, ngram: every n-gram of every bracketed word, repeats kept, and the bracketed word
    itself where the indexer wants it."""
    marked = words.select("word", g.bracket(F.col("word"), subwords.bow, subwords.eow).alias("marked"))
    made = g.ngrams(F.col("marked"), subwords.min_n, subwords.max_n)
    if subwords.indexer.whole_word:
        made = F.concat(F.array("marked"), made)
    return marked.select("word", F.explode(made).alias("ngram"))


def subword_indices(words: DataFrame, subwords: Subwords) -> DataFrame:
    """word, bucket, n: how often each bucket occurs among a word's n-grams.  Equal n-grams are
    looked up once a word; words without an index give no row."""
    counted = ngram_rows(words, subwords).groupBy("word", "ngram").agg(F.count("*").alias("times"))
    return subwords.indexer.bucket_rows(counted).groupBy("word", "bucket").agg(F.sum("times").alias("n"))


def ngram_indices(words: DataFrame, subwords: Subwords, words_len: int) -> DataFrame:
    """word, ngram_indices: the n-grams of each word with their rows of the matrix, repeats
    kept, sorted; an n-gram without an index has an empty list.  No row for a word without
    n-grams."""
    found = subwords.indexer.buckets_of(ngram_rows(words, subwords))
    rows = F.transform("found", lambda b: b + F.lit(words_len))
    return found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("ngram", rows.alias("indices")))).alias("ngram_indices"))


def pooled(words: DataFrame, model: EmbeddingModel) -> DataFrame:
    """word, total (sum of the bucket rows, repeats counted), hits, for the words that have any.

    Equal buckets of a word are joined once, and the sums are partly made before the shuffle.
    """
    counts = subword_indices(words.select("word").distinct(), model.subwords)
    joined = counts.join(model.buckets, "bucket")
    sums = joined.groupBy("word").agg(*pooled_sum(F.col("embedding"), model.dims, F.col("n")), F.sum("n").alias("hits"))
    return sums.select("word", pooled_array(model.dims).alias("total"), "hits")


def compose_words(model: EmbeddingModel) -> DataFrame:
    """The words with each vector the mean of itself and its bucket rows; as it is without any."""
    total = pooled(model.words.where("word is not null"), model)
    joined = model.words.join(total, "word", "left")
    mean = scale(add(F.col("embedding"), F.col("total")), 1 / (F.col("hits") + 1).cast("double"))
    vector = F.when(F.col("total").isNull(), F.col("embedding")).otherwise(to_float(mean))
    return joined.select("word", "idx", vector.alias("embedding"), "norm")


def decompose_words(model: EmbeddingModel) -> DataFrame:
    """The inverse of compose_words() and of normalization: word, idx, embedding."""
    total = pooled(model.words.where("word is not null"), model)
    joined = model.words.join(total, "word", "left")
    own = scale(F.col("embedding"), F.coalesce(F.col("norm"), F.lit(1.0)).cast("double"))
    apart = subtract(scale(own, (F.col("hits") + 1).cast("double")), F.col("total"))
    return joined.select("word", "idx", to_float(F.when(F.col("total").isNull(), own).otherwise(apart)).alias("embedding"))


def to_explicit(model: EmbeddingModel) -> EmbeddingModel:
    """The model with a stored dictionary of the n-grams of its words.

    Buckets are numbered by the first of their n-grams in byte order, so the numbers are the
    same each time; n-grams that shared a bucket still do.  The markers of the result are the
    default ones and its metadata is dropped, norms are kept.  Simple, explicit and floret
    vocabularies can't be converted; neither can n-grams of several buckets.
    """
    if model.subwords is None or isinstance(model.subwords.indexer, ExplicitIndexer):
        raise ConversionError(f"a {model.kind.value} vocabulary can't be made explicit")
    if isinstance(model.subwords.indexer, FloretIndexer):
        if model.subwords.indexer.hashes > 1:
            raise NGramConversionError("n-grams have several buckets")
        raise ConversionError("a floret vocabulary can't be made explicit")
    distinct = ngram_rows(model.words, model.subwords).select("ngram").distinct()
    pairs = model.subwords.indexer.buckets_of(distinct).select(F.col("ngram").alias("pos"), "ngram", F.col("found")[0].alias("bucket"))
    table, numbers = ExplicitIndexer.renumbered(pairs)
    buckets = model.buckets.join(numbers, F.col("bucket") == F.col("old")).select(F.col("new").alias("bucket"), "embedding")
    indexer = ExplicitIndexer(table, numbers.count())
    subwords = Subwords(indexer, model.subwords.min_n, model.subwords.max_n)
    return replace(model, subwords=subwords, buckets=buckets, metadata=None)


def normalized_words(words: DataFrame) -> DataFrame:
    """word, idx, embedding of length 1 and norm, the length it had; zero vectors stay."""
    measured = words.withColumn("norm", l2_norm(F.col("embedding")))
    unit = F.when(F.col("norm") == 0, F.col("embedding")).otherwise(to_float(scale(F.col("embedding"), 1 / F.col("norm"))))
    return measured.select("word", "idx", unit.alias("embedding"), F.col("norm").cast("float").alias("norm"))
