"""How n-grams are mapped to rows of the bucket matrix."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import ngrams as g
from wordloom.runtime import materialize


class Indexer(ABC):
    """``buckets_of`` gives the buckets of n-grams as an array; ``upper_bound`` is above every
    bucket; ``infallible`` tells whether each n-gram has one; ``whole_word`` whether the
    bracketed word itself is indexed besides its n-grams."""

    infallible = True
    whole_word = False

    @property
    @abstractmethod
    def upper_bound(self) -> int: ...

    @abstractmethod
    def buckets_of(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        """``rows`` with the array ``found`` of the buckets of each n-gram."""

    def bucket_rows(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        """``rows`` with ``bucket``, a row for each bucket of each n-gram."""
        return self.buckets_of(rows, ngram).withColumn("bucket", F.explode("found")).drop("found")


@dataclass(frozen=True)
class HashIndexer(Indexer):
    """The native hash: low bits of FNV-1a; ``exponent`` bits.  Buckets are BIGINT, with all 64 bits
    DECIMAL(20, 0)."""

    exponent: int = 21

    def __post_init__(self) -> None:
        if not 0 <= self.exponent <= 64:
            raise ValueError("the bucket exponent must be from 0 to 64")

    @property
    def upper_bound(self) -> int:
        return 1 << self.exponent

    def buckets_of(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        return rows.withColumn("found", F.array(g.fnv_low_bits(F.col(ngram), self.exponent)))

    def bucket_rows(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        # An array to explode would be made twice, once to see that it is not empty.
        return rows.withColumn("bucket", g.fnv_low_bits(F.col(ngram), self.exponent))


@dataclass(frozen=True)
class FastTextIndexer(Indexer):
    buckets: int = 2_000_000

    def __post_init__(self) -> None:
        if not 0 < self.buckets < 1 << 31:
            raise ValueError("the number of buckets must be positive and fit 31 bits")

    @property
    def upper_bound(self) -> int:
        return self.buckets

    def buckets_of(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        return rows.withColumn("found", F.array(g.fasttext_bucket(F.col(ngram), self.buckets)))

    def bucket_rows(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        return rows.withColumn("bucket", g.fasttext_bucket(F.col(ngram), self.buckets))


@dataclass(frozen=True)
class FloretIndexer(Indexer):
    buckets: int
    hashes: int = 2
    seed: int = 2166136261
    whole_word = True

    def __post_init__(self) -> None:
        if self.buckets < 1 or not 1 <= self.hashes <= 4:
            raise ValueError("there must be a bucket and one to four hashes")

    @property
    def upper_bound(self) -> int:
        return self.buckets

    def buckets_of(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        return rows.withColumn("found", g.floret_buckets(F.col(ngram), self.buckets, self.hashes, self.seed))


@dataclass(frozen=True)
class ExplicitIndexer(Indexer):
    """A stored dictionary: ``table`` has ngram (unique) and bucket."""

    table: DataFrame
    bound: int
    infallible = False

    @property
    def upper_bound(self) -> int:
        return self.bound

    def buckets_of(self, rows: DataFrame, ngram: str = "ngram") -> DataFrame:
        known = self.table.select(F.col("ngram").alias("known_ngram"), F.col("bucket").alias("known_bucket"))
        joined = rows.join(known, rows[ngram] == F.col("known_ngram"), "left")
        found = F.when(F.col("known_bucket").isNull(), F.array().cast("array<long>")).otherwise(F.array(F.col("known_bucket").cast("long")))
        return joined.withColumn("found", found).drop("known_ngram", "known_bucket")

    @staticmethod
    def renumbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ngram, bucket) with new numbers, and (old, new).

        ``pairs``: pos, ngram, bucket.  Old buckets are numbered as they first appear by pos;
        n-grams that shared one still do.  Buckets, not n-grams, are ranked, and only once.
        """
        firsts = pairs.groupBy(F.col("bucket").alias("old")).agg(F.min("pos").alias("first"))
        numbered = numbered_rows(firsts, "first", "new")
        ngrams = pairs.join(numbered, pairs["bucket"] == numbered["old"]).select("ngram", F.col("new").alias("bucket"))
        return ngrams, numbered.select("old", "new")


def numbered_rows(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` numbered from 0 in the order of a column without ties.

    Ranges are numbered apart and shifted by the sizes of those before, so no task sorts all.
    """
    sliced = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("slice", F.spark_partition_id())
    sliced = materialize(sliced)
    sizes = sliced.groupBy("slice").count()
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shifts = sizes.select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("slice").orderBy(order)
    return sliced.join(F.broadcast(shifts), "slice").withColumn(name, F.row_number().over(within) - 1 + F.col("shift")).drop("slice", "shift")
