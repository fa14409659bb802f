"""Lookup of words that arrive as a stream: a join of the stream with the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.model import EmbeddingModel
from wordloom.operators.lookup import lookup_batch


def lookup_known(stream: DataFrame, model: EmbeddingModel) -> DataFrame:
    """The stream with embedding and norm of known words; stateless, in append mode."""
    return stream.join(model.words.select("word", "embedding", F.coalesce("norm", F.lit(1.0)).cast("float").alias("norm")), "word", "left")


def lookup_each_batch(model: EmbeddingModel, sink):
    """A function for foreachBatch that looks up known and unknown words of each batch and
    gives the result to ``sink(frame, batch_id)``; batches have pos and word."""

    def process(batch: DataFrame, batch_id: int) -> None:
        sink(lookup_batch(batch, model), batch_id)

    return process
