"""An embedding table as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.errors import MatrixShapeError
from wordloom.functions.indexers import ExplicitIndexer, FastTextIndexer, FloretIndexer, HashIndexer, Indexer


def refuse_repeats(words: DataFrame) -> None:
    """Raises if a word occurs more than once; a pass over the words."""
    twice = words.groupBy("word").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"words occur more than once, as {twice.word!r}")


class VocabKind(Enum):
    SIMPLE = "simple"
    BUCKET = "bucket_subword"
    FASTTEXT = "fasttext_subword"
    FLORET = "floret_subword"
    EXPLICIT = "explicit_subword"


@dataclass(frozen=True)
class Subwords:
    """How a model makes vectors of words it does not hold."""

    indexer: Indexer
    min_n: int = 3
    max_n: int = 6
    bow: str = "<"
    eow: str = ">"

    @property
    def kind(self) -> VocabKind:
        kinds = {HashIndexer: VocabKind.BUCKET, FastTextIndexer: VocabKind.FASTTEXT, FloretIndexer: VocabKind.FLORET, ExplicitIndexer: VocabKind.EXPLICIT}
        return kinds[type(self.indexer)]


@dataclass(frozen=True)
class EmbeddingModel:
    """``words``: word (unique), idx (from 0), embedding, norm (null where not stored);
    ``buckets``: bucket, embedding, or None; ``metadata``: nested dict, or None.

    Models are immutable: set_metadata() and the like give a new one.
    """

    words: DataFrame
    dims: int
    subwords: Subwords | None = None
    buckets: DataFrame | None = None
    metadata: dict[str, Any] | None = field(default=None)

    @property
    def kind(self) -> VocabKind:
        return self.subwords.kind if self.subwords else VocabKind.SIMPLE

    @cached_property
    def words_len(self) -> int:
        return self.words.count()

    @property
    def vocab_len(self) -> int:
        """Rows of the whole matrix: words and buckets."""
        return self.words_len + (self.subwords.indexer.upper_bound if self.subwords else 0)

    def __len__(self) -> int:
        return self.words_len

    @property
    def shape(self) -> tuple[int, int]:
        return self.vocab_len, self.dims

    def set_metadata(self, metadata: dict[str, Any] | None) -> tuple[EmbeddingModel, dict[str, Any] | None]:
        """The model with other metadata, and the metadata it had."""
        return replace(self, metadata=metadata), self.metadata

    def norms(self) -> DataFrame:
        return self.words.select("idx", "norm")

    def storage(self) -> DataFrame:
        """idx, embedding of the whole matrix: words first, then buckets."""
        rows = self.words.select(F.col("idx").cast("long").alias("idx"), "embedding")
        if self.buckets is None:
            return rows
        return rows.unionByName(
            self.buckets.select((F.col("bucket") + F.lit(self.words_len)).cast("long").alias("idx"), "embedding")
        )

    def vocab(self) -> DataFrame:
        return self.words.select("word", "idx")

    def into_parts(self) -> tuple[dict[str, Any] | None, DataFrame, DataFrame, DataFrame]:
        return self.metadata, self.vocab(), self.storage(), self.norms()

    def checked(self) -> EmbeddingModel:
        """The model itself, if words are unique, rows numbered without gaps and vectors of one
        length; raises otherwise."""
        found = self.words.agg(
            F.count("*").alias("rows"),
            F.count_distinct("word").alias("words"),
            F.count_distinct("idx").alias("numbers"),
            F.coalesce(F.min("idx"), F.lit(0)).alias("least"),
            F.coalesce(F.max("idx"), F.lit(-1)).alias("most"),
            F.count_if(F.coalesce(F.size("embedding") != self.dims, F.lit(True))).alias("odd"),
        ).first()
        if found.words != found.rows:
            raise ValueError("words occur more than once")
        if found.odd or found.numbers != found.rows or found.least != 0 or found.most != found.rows - 1:
            raise MatrixShapeError("the matrix does not fit the vocabulary")
        if self.buckets is not None:
            bound = self.subwords.indexer.upper_bound
            wrong = self.buckets.where((F.size("embedding") != self.dims) | (F.col("bucket") < 0) | (F.col("bucket") >= bound))
            if not wrong.isEmpty():
                raise MatrixShapeError("the buckets do not fit the vocabulary")
        return self
