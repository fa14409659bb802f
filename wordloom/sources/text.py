"""Text files: a word and its components a line, with or without a line of sizes before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.errors import FormatError, WriteError
from wordloom.functions.vector import scale, to_float
from wordloom.model import EmbeddingModel, refuse_repeats
from wordloom.operators.line_parser import ASCII_SPACE
from wordloom.operators.subwords import normalized_words
from wordloom.sources.files import OrderedFile, fields, first_line, numbered_lines

WORDS = "word string, idx long, embedding array<float>, norm float"


def decoded(raw: Column, lossy: bool) -> Column:
    """Text of bytes: strict, an error where they are no UTF-8; lossy, with replacements."""
    if lossy:
        return F.make_valid_utf8(raw)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.raise_error(F.lit("a token holds invalid UTF-8")))


def _parts(value: Column) -> Column:
    return F.array_remove(F.split(value, ASCII_SPACE), "")


def _rows(lines: DataFrame, dims: int, lossy: bool) -> DataFrame:
    cut = lines.select("line", _parts(decoded(F.col("value"), lossy)).alias("parts"))
    checked = F.when(F.size("parts") == dims + 1, F.col("parts")).otherwise(
        F.raise_error(F.concat(F.lit("a line has not one word and the components: line "), F.col("line").cast("string")))
    )
    cut = cut.select("line", checked.alias("parts"))
    return cut.select(
        F.col("parts")[0].alias("word"),
        F.col("line").alias("idx"),
        F.transform(F.slice("parts", 2, dims), lambda c: c.cast("float")).alias("embedding"),
        F.lit(None).cast("float").alias("norm"),
    )


def finished(words: DataFrame, dims: int, normalize: bool, check: bool) -> EmbeddingModel:
    """The model of words as they were read, refused if a word repeats and that is checked."""
    if check:
        refuse_repeats(words)
    return EmbeddingModel(normalized_words(words) if normalize else words, dims)


def read_text(spark: SparkSession, path: str, lossy: bool = False, normalize: bool = True, check: bool = True) -> EmbeddingModel:
    """A file without a line of sizes; the first line tells the number of components.

    A line of another number of fields is an error, as is an empty file and, unless ``check`` is
    false, a word that repeats.  Vectors are normalized and their lengths kept, unless
    ``normalize`` is false.
    """
    parts = fields(first_line(path))
    if not parts:
        raise FormatError("the file has no line")
    lines = numbered_lines(spark, path)
    return finished(_rows(lines, len(parts) - 1, lossy), len(parts) - 1, normalize, check)


def read_text_dims(spark: SparkSession, path: str, lossy: bool = False, normalize: bool = True, check: bool = True) -> EmbeddingModel:
    """A file whose first line has the number of words and of components; both are checked."""
    try:
        count, dims = (int(x) for x in fields(first_line(path)))
    except ValueError as error:
        raise FormatError("the first line has not two numbers") from error
    lines = numbered_lines(spark, path).where("line > 0").withColumn("line", F.col("line") - 1)
    found = lines.count()
    if found != count:
        raise FormatError(f"the file has {found} words, its first line says {count}")
    return finished(_rows(lines, dims, lossy), dims, normalize, check)


def float_text(value: np.float32) -> str:
    """The shortest decimal that reads as the same FLOAT, without an exponent."""
    return np.format_float_positional(value, unique=True, trim="-")


def float_texts(values: pa.Array) -> pa.Array:
    """float_text() of many FLOAT; only those that come with an exponent are written one by one."""
    told = pc.replace_substring_regex(values.cast(pa.float32()).cast(pa.string()), r"\.0$", "")
    odd = np.flatnonzero(np.asarray(pc.match_substring_regex(told, "[a-zA-Z]")))
    if not len(odd):
        return told
    mask = np.zeros(len(told), bool)
    mask[odd] = True
    floats = np.asarray(values, np.float32)
    return pc.replace_with_mask(told, pa.array(mask), pa.array([float_text(floats[k]) for k in odd], pa.string()))


def text_lines(rows: DataFrame, key: str, lead: str) -> DataFrame:
    """key, data: lines of the column ``lead`` and the components, each with a line feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            told = float_texts(lists.flatten())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py()), told), " ")
            lines = pc.binary_join_element_wise(batch.column(1), pc.binary_join_element_wise(joined, "", "\n"), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), lines.cast(pa.binary())], [key, "data"])

    taken = rows.select(key, F.col(lead).cast("string").alias("lead"), F.col("embedding").cast("array<float>").alias("embedding"))
    return taken.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, data binary")


def written_words(model: EmbeddingModel, unnormalize: bool) -> DataFrame:
    """The words as they are written: without sub-words, with their lengths if asked."""
    if not unnormalize:
        return model.words
    factor = F.coalesce("norm", F.lit(1.0)).cast("double")
    return model.words.withColumn("embedding", to_float(scale(F.col("embedding"), factor)))


def write_text(model: EmbeddingModel, path: str, unnormalize: bool = False, dims: bool = False) -> None:
    """One line a word, in order of the vocabulary; with ``dims`` a line of sizes first."""
    if not model.words.where("word is null or embedding is null").isEmpty():
        raise WriteError("a word or vector is null")
    with OrderedFile(path) as out:
        if dims:
            out.bytes(f"{model.words_len} {model.dims}\n".encode())
        out.table(text_lines(written_words(model, unnormalize), "idx", "word"), "idx")


def write_text_dims(model: EmbeddingModel, path: str, unnormalize: bool = False) -> None:
    write_text(model, path, unnormalize, dims=True)
