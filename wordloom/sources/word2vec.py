"""Binary word2vec files: sizes, then a word, a space and the components of each row."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom.errors import FormatError, ReadError
from wordloom.model import EmbeddingModel
from wordloom.operators.line_parser import WHITE_SPACE
from wordloom.sources.files import Marked, OrderedFile, first_line, float_bytes, mapped, row_slices, row_stretches
from wordloom.sources.text import WORDS, finished, written_words


def read_word2vec_binary(spark: SparkSession, path: str, lossy: bool = False, normalize: bool = True, check: bool = True) -> EmbeddingModel:
    """White space around a word is dropped.  Invalid UTF-8 is an error, or replaced if
    ``lossy``, and so is a word that repeats, unless ``check`` is false.  Vectors are normalized and their lengths kept, unless ``normalize`` is false."""
    head = first_line(path)
    try:
        count, dims = (int(x) for x in head.split(b" "))
    except ValueError as error:
        raise FormatError("the first line has not two numbers") from error
    try:
        slices = row_stretches(spark, path, len(head), os.path.getsize(path), count, Marked(b" ", 4 * dims))
    except ReadError:  # told exactly, or not at fault, as rows behind the last, if rows are read one after the other
        slices = row_slices(spark, path, len(head), count, b" ", 4 * dims)
    width = 4 * dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, start, _ in zip(*(c.to_pylist() for c in batch.columns)):
                words, vectors = [], []
                with open(path, "rb") as file, mapped(file) as data:
                    for _ in range(rows):
                        space = data.find(b" ", start)
                        words.append(data[start:space].decode("utf-8", "replace" if lossy else "strict").strip(WHITE_SPACE))
                        start = space + 1 + width
                        vectors.append(data[space + 1 : start])
                values = np.frombuffer(b"".join(vectors), "<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows + 1, dtype=np.int32) * dims), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.array(np.arange(first, first + rows)), lists, pa.nulls(rows, pa.float32())],
                    ["word", "idx", "embedding", "norm"],
                )

    table = spark.createDataFrame(slices, "first long, rows long, start long, end long").repartition(max(1, len(slices)), "first")
    words = table.mapInArrow(run, WORDS)
    return finished(words, dims, normalize, check)


def write_word2vec_binary(model: EmbeddingModel, path: str, unnormalize: bool = False) -> None:
    """Sizes, then the words in order of the vocabulary; each row ends with a line feed."""
    words = written_words(model, unnormalize)
    vectors = float_bytes(words, "idx").withColumnRenamed("idx", "of")
    rows = words.select("idx", "word").join(vectors, F.col("idx") == F.col("of"))
    line = F.concat(F.encode("word", "UTF-8"), F.lit(b" "), "data", F.lit(b"\n"))
    with OrderedFile(path) as out:
        out.bytes(f"{model.words_len} {model.dims}\n".encode())
        out.table(rows.select("idx", line.alias("data")), "idx")
