"""Floret text files: a line of parameters, then a line a bucket."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom.errors import FormatError, WriteError
from wordloom.functions.indexers import FloretIndexer
from wordloom.model import EmbeddingModel, Subwords
from wordloom.sources.files import OrderedFile, fields, first_line, numbered_lines
from wordloom.sources.text import WORDS, _rows, text_lines


def read_floret_text(spark: SparkSession, path: str) -> EmbeddingModel:
    """A model of buckets only.  The place of a line, not its number, is the bucket; nothing is
    normalized and there are no norms."""
    parts = fields(first_line(path))
    try:
        buckets, dims, min_n, max_n, hashes, seed = (int(x) for x in parts[:6])
        bow, eow = (x.decode("utf-8") for x in parts[6:])
    except ValueError as error:
        raise FormatError("the first line has not six numbers and two markers") from error
    if buckets < 1 or dims < 1 or not 1 <= min_n <= max_n or not 1 <= hashes <= 4:
        raise FormatError("a number of the first line is out of range")
    lines = numbered_lines(spark, path).where("line > 0 and value <> ''").withColumn("line", F.col("line") - 1)
    found = lines.count()
    if found != buckets:
        raise FormatError(f"the file has {found} buckets, its first line says {buckets}")
    rows = _rows(lines, dims, False).select(F.col("idx").alias("bucket"), "embedding")
    subwords = Subwords(FloretIndexer(buckets, hashes, seed), min_n, max_n, bow, eow)
    return EmbeddingModel(spark.createDataFrame([], WORDS), dims, subwords, rows)


def write_floret_text(model: EmbeddingModel, path: str) -> None:
    """The parameters and the bucket rows; words are not written."""
    own = model.subwords
    if own is None or not isinstance(own.indexer, FloretIndexer):
        raise WriteError("only a floret vocabulary can be written so")
    head = own.indexer
    with OrderedFile(path) as out:
        out.bytes(f"{head.buckets} {model.dims} {own.min_n} {own.max_n} {head.hashes} {head.seed} {own.bow} {own.eow}\n".encode())
        out.table(text_lines(model.buckets, "bucket", "bucket"), "bucket")
