"""Binary fastText models, unsupervised, neither quantized nor pruned."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom.errors import FormatError, MatrixShapeError, WriteError
from wordloom.functions.indexers import FastTextIndexer
from wordloom.model import EmbeddingModel, Subwords, refuse_repeats
from wordloom.operators.subwords import compose_words, decompose_words, normalized_words
from wordloom.sources.files import OrderedFile, exactly, float_bytes, mapped, matrix_rows, row_slices

# The mark and the latest version of the format, and its names of numbers.
MAGIC, VERSION = 793712314, 12
FIELDS = ["dims", "window_size", "epoch", "min_count", "neg", "word_ngrams", "loss", "model", "bucket", "min_n", "max_n", "lr_update_rate"]
LOSSES = {1: "HierarchicalSoftmax", 2: "NegativeSampling", 3: "Softmax"}
MODELS = {1: "Cbow", 2: "SkipGram", 3: "Supervised"}


def read_fasttext(spark: SparkSession, path: str, lossy: bool = False, check: bool = True) -> EmbeddingModel:
    """Words have their bucket rows mixed in and are normalized, with their lengths as norms;
    bucket rows stay as they are.  The parameters become metadata.  A word that repeats is an
    error, unless ``check`` is false."""
    with open(path, "rb", buffering=1 << 20) as file:
        magic, version = struct.unpack("<II", exactly(file, 8, "the head"))
        if magic != MAGIC or version > VERSION:
            raise FormatError(f"mark {magic} or version {version} is not of the format")
        config = dict(zip(FIELDS, struct.unpack("<12I", exactly(file, 48, "the parameters"))))
        (config["sampling_threshold"],) = struct.unpack("<d", exactly(file, 8, "the parameters"))
        if config["loss"] not in LOSSES or config["model"] not in MODELS:
            raise FormatError(f"loss {config['loss']} or model {config['model']} is unknown")
        size, _, labels, _, pruned = struct.unpack("<IIIQq", exactly(file, 28, "the vocabulary"))
        if labels:
            raise FormatError("models for prediction are not supported")
        if pruned >= 0:
            raise FormatError("pruned vocabularies are not supported")
        # A word, a zero, eight bytes of a count and the kind of entry.
        slices = row_slices(spark, path, file.tell(), size, b"\0", 9)
        file.seek(slices[-1][3])
        if exactly(file, 1, "the head of the matrix") == b"\1":
            raise FormatError("quantized models are not supported")
        rows, dims = struct.unpack("<QQ", exactly(file, 16, "the head of the matrix"))
        offset = file.tell()
    if rows != size + config["bucket"]:
        raise MatrixShapeError("the matrix has not a row for each word and bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, count, place, _ in zip(*(c.to_pylist() for c in batch.columns)):
                words = []
                with open(path, "rb") as own, mapped(own) as data:
                    for _ in range(count):
                        end = data.find(b"\0", place)
                        words.append(data[place:end].decode("utf-8", "replace" if lossy else "strict"))
                        if data[end + 9]:
                            raise FormatError("an entry is no word")
                        place = end + 10
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.arange(low, low + count))], ["word", "of"])

    table = spark.createDataFrame(slices, "first long, rows long, start long, end long").repartition(max(1, len(slices)), "first")
    words = table.mapInArrow(run, "word string, of long")
    if check:
        refuse_repeats(words)
    matrix = matrix_rows(spark, path, offset, size, dims)
    buckets = matrix_rows(spark, path, offset + 4 * dims * size, config["bucket"], dims).withColumnRenamed("idx", "bucket")
    raw = words.join(matrix, F.col("of") == F.col("idx")).select("word", "idx", "embedding", F.lit(None).cast("float").alias("norm"))
    subwords = Subwords(FastTextIndexer(config["bucket"]), config["min_n"], config["max_n"])
    names = {"loss": LOSSES[config["loss"]], "model": MODELS[config["model"]]}
    model = EmbeddingModel(raw, dims, subwords, buckets, config | names)
    return replace(model, words=normalized_words(compose_words(model)))


def write_fasttext(model: EmbeddingModel, path: str) -> None:
    """The inverse of read_fasttext(); parameters that don't matter for use are 0."""
    own = model.subwords
    if own is None or not isinstance(own.indexer, FastTextIndexer):
        raise WriteError("only a fastText vocabulary can be written so")
    count = model.words_len
    with OrderedFile(path) as out:
        out.bytes(struct.pack("<II", MAGIC, VERSION))
        out.bytes(struct.pack("<12Id", model.dims, 0, 0, 0, 0, 1, 1, 1, own.indexer.buckets, own.min_n, own.max_n, 0, 0.0))
        out.bytes(struct.pack("<IIIQq", count, count, 0, 0, -1))
        out.table(model.words.select("idx", F.concat(F.encode("word", "UTF-8"), F.lit(bytes(10))).alias("data")), "idx")
        out.bytes(struct.pack("<BQQ", 0, count + own.indexer.buckets, model.dims))
        out.table(float_bytes(decompose_words(model), "idx"), "idx")
        out.table(float_bytes(model.buckets, "bucket"), "bucket")
