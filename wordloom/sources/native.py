"""The native container: a header and chunks for metadata, vocabulary, matrix and norms.

Only the heads of chunks are read on the driver; words, matrices, codes and norms are read by
tasks, and written by tasks at their places.  Where stretches of words begin is found by ranges of
bytes in parallel; of explicit vocabularies, whose words end at no known place, by one task, which
hops from length to length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.errors import FormatError, MatrixShapeError, NGramConversionError, ReadError, UnknownChunkError, WriteError
from wordloom.functions.indexers import ExplicitIndexer, FastTextIndexer, FloretIndexer, HashIndexer
from wordloom.model import EmbeddingModel, Subwords, refuse_repeats
from wordloom.operators import quantize as pq
from wordloom.sources import toml
from wordloom.sources.files import SLICE, OrderedFile, Sized, code_rows, exactly, float_bytes, mapped, matrix_rows, row_stretches

# The mark, the version, and the numbers of chunks and of types.
MARK, VERSION = b"FiFu", 0
SIMPLE, DENSE, BUCKET, QUANTIZED, METADATA, NORMS, FASTTEXT, EXPLICIT, FLORET = range(1, 10)
VOCABULARIES = (SIMPLE, BUCKET, FASTTEXT, EXPLICIT, FLORET)
U8, F32 = 1, 10


def padding(position: int) -> int:
    """Bytes before numbers of four bytes: one to four, never none."""
    return 4 - position % 4


@dataclass(frozen=True)
class QuantizedModel:
    """A model whose matrix is codes.  ``words``: word, idx, codes, code_norm, norm; ``buckets``:
    bucket, codes, code_norm, or None.  Neighbours can't be asked of it before reconstruct()."""

    words: DataFrame
    quantizer: pq.Quantizer
    subwords: Subwords | None = None
    buckets: DataFrame | None = None
    metadata: dict[str, Any] | None = field(default=None)

    @property
    def dims(self) -> int:
        return self.quantizer.reconstructed_len

    @property
    def shape(self) -> tuple[int, int]:
        return self.words.count() + (self.subwords.indexer.upper_bound if self.subwords else 0), self.dims

    def storage(self) -> DataFrame:
        """idx, codes, code_norm of the whole matrix: words first, then buckets."""
        rows = self.words.select("idx", "codes", "code_norm")
        if self.buckets is None:
            return rows
        shift = F.lit(self.words.count())
        return rows.unionByName(self.buckets.select((F.col("bucket") + shift).cast("long").alias("idx"), "codes", "code_norm"))

    def gather(self, indices: DataFrame) -> DataFrame:
        """pos, idx, embedding: the asked rows alone decoded, repeats kept.  ``indices``: pos, idx."""
        asked = indices.select("idx").distinct()
        coded = self.storage().join(asked, "idx", "left_semi").withColumnRenamed("code_norm", "norm")
        return indices.select("pos", "idx").join(pq.reconstruct(coded, self.quantizer, "idx"), "idx").select("pos", "idx", "embedding")

    def clone_from_mapping(self, mapping: DataFrame) -> DataFrame:
        """idx, codes, code_norm of a new matrix whose row new_idx is the old row old_idx."""
        asked = mapping.select(F.col("new_idx").alias("new"), F.col("old_idx").alias("idx"))
        return asked.join(self.storage(), "idx").select(F.col("new").alias("idx"), "codes", "code_norm")

    def reconstruct(self) -> EmbeddingModel:
        """The model with every row decoded."""
        coded = self.words.select("idx", "codes", F.col("code_norm").alias("norm"))
        decoded = pq.reconstruct(coded, self.quantizer, "idx").withColumnRenamed("idx", "of")
        words = self.words.join(decoded, F.col("idx") == F.col("of")).select("word", "idx", "embedding", "norm")
        buckets = None
        if self.buckets is not None:
            rows = self.buckets.select("bucket", "codes", F.col("code_norm").alias("norm"))
            buckets = pq.reconstruct(rows, self.quantizer, "bucket")
        return EmbeddingModel(words, self.dims, self.subwords, buckets, self.metadata)


def quantize_model(model: EmbeddingModel, subquantizers: int, bits: int, iterations: int = 10, attempts: int = 1,
                   normalize: bool = False, rotate: bool = False, seed: int = 42) -> QuantizedModel:
    """The model with its whole matrix quantized; metadata, vocabulary and norms are kept."""
    storage = model.storage()
    quantizer, _ = pq.train(storage, subquantizers, bits, iterations, attempts, normalize, rotate, seed)

    def coded(rows: DataFrame, key: str) -> DataFrame:
        return pq.encode_rows(rows, quantizer, key, normalize).select(F.col(key).alias("of"), "codes", F.col("norm").alias("code_norm"))

    words = model.words.join(coded(model.words, "idx"), F.col("idx") == F.col("of")).select("word", "idx", "codes", "code_norm", "norm")
    buckets = None if model.buckets is None else coded(model.buckets, "bucket").withColumnRenamed("of", "bucket")
    return QuantizedModel(words, quantizer, model.subwords, buckets, model.metadata)


class _Reader:
    def __init__(self, path: str):
        self.path = path
        self.file = open(path, "rb", buffering=1 << 16)  # noqa: SIM115

    def __enter__(self) -> _Reader:
        return self

    def __exit__(self, *error) -> None:
        self.file.close()

    def numbers(self, form: str) -> tuple:
        return struct.unpack("<" + form, exactly(self.file, struct.calcsize("<" + form), "a head"))

    def header(self) -> list[int]:
        mark, version, count = self.numbers("4sII")
        if mark != MARK or version != VERSION:
            raise FormatError(f"mark {mark!r} or version {version} is not of the format")
        chunks = list(self.numbers(f"{count}I"))
        for chunk in chunks:
            if not 1 <= chunk <= FLORET:
                raise UnknownChunkError(f"chunk {chunk}")
        if not chunks:
            raise FormatError("the file has no chunk")
        return chunks

    def chunk(self) -> tuple[int, int]:
        """Number of the next chunk and the place where it ends."""
        number, size = self.numbers("IQ")
        if not 1 <= number <= FLORET:
            raise UnknownChunkError(f"chunk {number}")
        return number, self.file.tell() + size

    def expect(self, kind: int) -> None:
        (found,) = self.numbers("I")
        if found != kind:
            raise FormatError(f"numbers of type {found}, not {kind}")

    def metadata(self) -> dict[str, Any]:
        number, end = self.chunk()
        if number != METADATA:
            raise FormatError(f"chunk {number} where metadata should be")
        text = exactly(self.file, end - self.file.tell(), "the metadata")
        try:
            return toml.parse(text.decode("utf-8"))
        except UnicodeDecodeError as error:
            raise FormatError("the metadata holds invalid UTF-8") from error

    def pad(self) -> None:
        self.file.seek(padding(self.file.tell()), 1)

    def text(self) -> str:
        (size,) = self.numbers("I")
        return exactly(self.file, size, "a text").decode("utf-8")


def read_metadata(path: str) -> dict[str, Any] | None:
    """The metadata alone, or None; nothing else of the file is read."""
    with _Reader(path) as reader:
        return reader.metadata() if reader.header()[0] == METADATA else None


def _stretches(spark: SparkSession, path: str, offset: int, count: int, tail: int) -> list[tuple[int, int, int, int]]:
    """First item, items, place and end of stretches of items with their lengths before them and
    ``tail`` bytes behind.  A task hops from length to length; of texts it reads nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            found, first, start, place = [], 0, offset, offset
            length = struct.Struct("<I").unpack_from
            with open(path, "rb") as file, mapped(file) as data:
                try:
                    for item in range(count):
                        if place - start >= SLICE:
                            found.append((first, item - first, start, place))
                            first, start = item, place
                        place += 4 + length(data, place)[0] + tail
                except struct.error as error:
                    raise ReadError("the file ends within the vocabulary") from error
                if place > len(data):
                    raise ReadError("the file ends within the vocabulary")
            found.append((first, count - first, start, place))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["first", "items", "start", "end"])

    rows = spark.range(0, 1, 1, 1).mapInArrow(run, "first long, items long, start long, end long").collect()  # a row a stretch
    return [tuple(r) for r in rows]


def _found(spark: SparkSession, path: str, begin: int, end: int, count: int) -> list[tuple[int, int, int, int]]:
    """_stretches() of items that fill the bytes up to ``end``, found in parallel."""
    try:
        return row_stretches(spark, path, begin, end, count, Sized())
    except ReadError:  # told exactly, or not at fault, if they are read one after the other
        return _stretches(spark, path, begin, count, 0)


def _items(spark: SparkSession, path: str, stretches: list[tuple[int, int, int, int]], numbered: bool) -> DataFrame:
    """pos, item and, if ``numbered``, number: texts with their lengths before them, a stretch a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, count, place, end in zip(*(c.to_pylist() for c in batch.columns)):
                with open(path, "rb") as file:
                    file.seek(place)
                    data = exactly(file, end - place, "the vocabulary")
                items, numbers, at = [], [], 0
                for _ in range(count):
                    (size,) = struct.unpack_from("<I", data, at)
                    items.append(data[at + 4 : at + 4 + size])
                    at += 4 + size
                    if numbered:
                        numbers.append(struct.unpack_from("<Q", data, at)[0])
                        at += 8
                try:
                    texts = pa.array(items, pa.binary()).cast(pa.string())
                except pa.ArrowInvalid as error:
                    raise FormatError("an item holds invalid UTF-8") from error
                columns = [pa.array(np.arange(low, low + count)), texts]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(numbers, pa.int64())] if numbered else []), names)

    names = ["pos", "item"] + (["number"] if numbered else [])
    schema = "pos long, item string" + (", number long" if numbered else "")
    table = spark.createDataFrame(stretches, "first long, items long, start long, end long").repartition(max(1, len(stretches)), "first")
    return table.mapInArrow(run, schema)


def _vocabulary(spark: SparkSession, reader: _Reader) -> tuple[int, DataFrame, Subwords | None]:
    """Number of words, (idx, word) and how unknown words are made; the reader is moved on."""
    chunk, end = reader.chunk()
    if chunk not in VOCABULARIES:
        raise FormatError(f"chunk {chunk} where a vocabulary should be")
    subwords = None
    if chunk == FLORET:
        min_n, max_n, buckets, hashes, seed = reader.numbers("IIQII")
        if not 1 <= hashes <= 4:
            raise ReadError(f"{hashes} hashes, not one to four")
        subwords = Subwords(FloretIndexer(buckets, hashes, seed), min_n, max_n, reader.text(), reader.text())
        count = 0
    elif chunk == EXPLICIT:
        count, grams, min_n, max_n = reader.numbers("QQII")
    elif chunk == SIMPLE:
        (count,) = reader.numbers("Q")
    else:
        count, min_n, max_n, buckets = reader.numbers("QIII")
        subwords = Subwords(HashIndexer(buckets) if chunk == BUCKET else FastTextIndexer(buckets), min_n, max_n)
    begin = reader.file.tell()
    stretches = _stretches(spark, reader.path, begin, count, 0) if chunk == EXPLICIT else _found(spark, reader.path, begin, end, count)
    words = _items(spark, reader.path, stretches, False).select(F.col("item").alias("word"), F.col("pos").alias("of"))
    if chunk == EXPLICIT:
        # The n-grams begin after the words.
        pairs = _items(spark, reader.path, _stretches(spark, reader.path, stretches[-1][3], grams, 8), True)
        table, numbers = ExplicitIndexer.renumbered(pairs.select("pos", F.col("item").alias("ngram"), F.col("number").alias("bucket")))
        subwords = Subwords(ExplicitIndexer(table, numbers.count()), min_n, max_n)
    reader.file.seek(end)
    return count, words, subwords


def _norms(spark: SparkSession, reader: _Reader, count: int) -> DataFrame | None:
    """(of, norm), or None: where norms can't be read there are none."""
    try:
        chunk, _ = reader.chunk()
        if chunk != NORMS:
            return None
        (found,) = reader.numbers("Q")
        reader.expect(F32)
        reader.pad()
        begin = reader.file.tell()
        if reader.file.seek(0, 2) < begin + 4 * found:
            return None
        rows = matrix_rows(spark, reader.path, begin, found, 1)
        return rows.where(F.col("idx") < count).select(F.col("idx").alias("norm_of"), F.col("embedding")[0].alias("norm"))
    except (ReadError, FormatError, UnknownChunkError):
        return None


def read_embeddings(spark: SparkSession, path: str, check: bool = True) -> EmbeddingModel | QuantizedModel:
    """A model of any vocabulary and matrix.  Nothing is normalized.  A matrix that has not a row for
    each word and bucket is refused and, unless ``check`` is false, a word that repeats.  Rows are
    read when they are needed."""
    with _Reader(path) as reader:
        metadata = reader.metadata() if reader.header()[0] == METADATA else None
        count, words, subwords = _vocabulary(spark, reader)
        chunk, end = reader.chunk()
        if chunk == DENSE:
            rows, dims = reader.numbers("QI")
            reader.expect(F32)
            reader.pad()
            matrix = matrix_rows(spark, path, reader.file.tell(), rows, dims)
            columns, quantizer = ["embedding"], None
        elif chunk == QUANTIZED:
            rotated, normed, parts, dims, centroids, rows = reader.numbers("IIIIIQ")
            if not parts or dims % parts:
                raise FormatError("the parts do not divide the vector")
            reader.expect(U8)
            reader.expect(F32)
            reader.pad()
            floats = lambda *shape: np.frombuffer(exactly(reader.file, 4 * int(np.prod(shape)), "the codebook"), "<f4").reshape(shape).astype(float)
            projection = floats(dims, dims) if rotated else None
            quantizer = pq.Quantizer(floats(parts, centroids, dims // parts), projection)
            begin = reader.file.tell()
            matrix = code_rows(spark, path, begin + 4 * rows * normed, rows, parts)
            if normed:
                own = matrix_rows(spark, path, begin, rows, 1).select(F.col("idx").alias("k"), F.col("embedding")[0].alias("code_norm"))
                matrix = matrix.join(own, F.col("idx") == F.col("k")).drop("k")
            else:
                matrix = matrix.withColumn("code_norm", F.lit(None).cast("float"))
            columns = ["codes", "code_norm"]
        else:
            raise FormatError(f"chunk {chunk} where a matrix should be")
        wanted = count + (subwords.indexer.upper_bound if subwords else 0)
        if rows != wanted:
            raise MatrixShapeError(f"the matrix has {rows} rows, the vocabulary {wanted}")
        reader.file.seek(end)
        norms = _norms(spark, reader, count)
    if check:
        refuse_repeats(words)
    known = words.join(matrix.where(F.col("idx") < count), F.col("of") == F.col("idx")).select("word", "idx", *columns)
    if norms is None:
        known = known.withColumn("norm", F.lit(None).cast("float"))
    else:
        known = known.join(norms, F.col("idx") == F.col("norm_of"), "left").drop("norm_of")
    rest = matrix.where(F.col("idx") >= count).select((F.col("idx") - count).alias("bucket"), *columns) if subwords else None
    if quantizer is not None:
        return QuantizedModel(known, quantizer, subwords, rest, metadata)
    return EmbeddingModel(known, dims, subwords, rest, metadata)


#: Reading is by ranges and on demand, so a mapped file is read like any other.
mmap_embeddings = read_embeddings


def read_viewable(spark: SparkSession, path: str, check: bool = True) -> EmbeddingModel:
    """A model whose rows can be viewed as they are, as similarity queries need it; one of codes is
    refused."""
    model = read_embeddings(spark, path, check)
    if isinstance(model, QuantizedModel):
        raise FormatError("the matrix is of codes; reconstruct() gives one of vectors")
    return model


mmap_viewable = read_viewable


def _item_bytes(text: str) -> F.Column:
    """Length, as four little-endian bytes, and bytes of a text."""
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    turned = F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)])
    return F.concat(F.unhex(turned), F.encode(text, "UTF-8"))


def _vocabulary_head(model: EmbeddingModel | QuantizedModel) -> tuple[int, bytes, bytes, int]:
    """Chunk, bytes before the words and after them, and the size of the words' items."""
    own = model.subwords
    sizes = model.words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 4), F.lit(0)), F.count_if(F.col("word").isNull())).first()
    if sizes[2]:
        raise WriteError("a word is null")
    count, size = sizes[0], sizes[1]
    if own is None:
        return SIMPLE, struct.pack("<Q", count), b"", size
    if isinstance(own.indexer, FloretIndexer):
        marks = b"".join(struct.pack("<I", len(m.encode())) + m.encode() for m in (own.bow, own.eow))
        head = struct.pack("<IIQII", own.min_n, own.max_n, own.indexer.buckets, own.indexer.hashes, own.indexer.seed)
        return FLORET, head + marks, b"", 0
    if isinstance(own.indexer, ExplicitIndexer):
        grams = own.indexer.table.agg(F.count("*"), F.count_distinct("ngram"), F.coalesce(F.sum(F.octet_length("ngram") + 12), F.lit(0))).first()
        if grams[0] != grams[1]:
            raise NGramConversionError("an n-gram has several indices")
        return EXPLICIT, struct.pack("<QQII", count, grams[0], own.min_n, own.max_n), b"", size + grams[2]
    if isinstance(own.indexer, HashIndexer):
        return BUCKET, struct.pack("<QIII", count, own.min_n, own.max_n, own.indexer.exponent), b"", size
    return FASTTEXT, struct.pack("<QIII", count, own.min_n, own.max_n, own.indexer.buckets), b"", size


def _rows(model: EmbeddingModel | QuantizedModel) -> int:
    return model.words.count() + (0 if model.buckets is None else model.buckets.count())


def _has_norms(model: EmbeddingModel | QuantizedModel) -> bool:
    return not model.words.where("norm is not null").isEmpty()


def _matrix_size(model: EmbeddingModel | QuantizedModel, rows: int, at: int) -> int:
    """Bytes of the matrix chunk at a place of the file, its number and length among them."""
    if isinstance(model, EmbeddingModel):
        return 28 + padding(at + 4) + 4 * rows * model.dims
    book, normed = model.quantizer, _code_norms(model)
    rotation = 0 if book.projection is None else 4 * model.dims**2
    return 48 + padding(at + 4) + rotation + 4 * book.centroids.size + 4 * rows * normed + rows * book.quantized_len


def _code_norms(model: QuantizedModel) -> bool:
    return not model.words.where("code_norm is not null").isEmpty()


def serialized_length(model: EmbeddingModel | QuantizedModel, offset: int = 0) -> int:
    """Bytes that write_embeddings() writes from that place on; aggregates only, nothing is
    written."""
    normed = _has_norms(model)
    at = offset + 12 + 4 * (2 + normed + (model.metadata is not None))
    if model.metadata is not None:
        at += 12 + len(toml.dump(model.metadata).encode())
    _, head, _, size = _vocabulary_head(model)
    at += 12 + len(head) + size
    at += _matrix_size(model, _rows(model), at)
    if normed:
        at += 24 + padding(at + 4) + 4 * model.words.count()
    return at - offset


def write_embeddings(model: EmbeddingModel | QuantizedModel, path: str) -> None:
    """Header, metadata if any, vocabulary, matrix and norms if any, in order.

    Norms are written if any word has one, as 1 where a word has none.
    """
    dense = isinstance(model, EmbeddingModel)
    normed = _has_norms(model)
    vocabulary, head, _, size = _vocabulary_head(model)
    chunks = [METADATA] * (model.metadata is not None) + [vocabulary, DENSE if dense else QUANTIZED] + [NORMS] * normed
    rows, count = _rows(model), model.words.count()
    with OrderedFile(path) as out:
        out.bytes(MARK + struct.pack(f"<II{len(chunks)}I", VERSION, len(chunks), *chunks))
        if model.metadata is not None:
            text = toml.dump(model.metadata).encode()
            out.bytes(struct.pack("<IQ", METADATA, len(text)) + text)
        out.bytes(struct.pack("<IQ", vocabulary, len(head) + size) + head)
        if vocabulary != FLORET:
            out.table(model.words.select("idx", _item_bytes("word").alias("data")), "idx")
        if vocabulary == EXPLICIT:
            number = F.lpad(F.hex("bucket"), 16, "0")
            turned = F.concat(*[F.substring(number, k, 2) for k in range(15, 0, -2)])
            grams = model.subwords.indexer.table.select("bucket", "ngram", F.concat(_item_bytes("ngram"), F.unhex(turned)).alias("data"))
            # In order of the numbers, which are then those of first appearance.
            out.table(grams.select(F.struct("bucket", "ngram").alias("at"), "data"), "at")
        place = out.position()
        whole = _matrix_size(model, rows, place)
        pad = bytes(padding(place + 4))
        if dense:
            out.bytes(struct.pack("<IQQII", DENSE, whole - 12, rows, model.dims, F32) + pad)
            out.table(float_bytes(model.words, "idx"), "idx")
            if model.buckets is not None:
                out.table(float_bytes(model.buckets, "bucket"), "bucket")
        else:
            book, own = model.quantizer, _code_norms(model)
            out.bytes(struct.pack("<IQ", QUANTIZED, whole - 12))
            out.bytes(struct.pack("<IIIII", book.projection is not None, own, book.quantized_len, model.dims, book.centroids.shape[1]))
            out.bytes(struct.pack("<QII", rows, U8, F32) + pad)
            if book.projection is not None:
                out.bytes(book.projection.astype("<f4").tobytes())
            out.bytes(book.centroids.astype("<f4").tobytes())
            parts = [(model.words, "idx")] + ([] if model.buckets is None else [(model.buckets, "bucket")])
            if own:
                for table, key in parts:
                    out.table(_single_floats(table, key, "code_norm"), key)
            for table, key in parts:
                code = F.concat(*[F.unhex(F.lpad(F.hex(F.col("codes")[k].cast("long")), 2, "0")) for k in range(book.quantized_len)])
                out.table(table.select(key, code.alias("data")), key)
        if normed:
            place = out.position()
            pad = bytes(padding(place + 4))
            out.bytes(struct.pack("<IQQI", NORMS, 12 + len(pad) + 4 * count, count, F32) + pad)
            out.table(_single_floats(model.words, "idx", "norm"), "idx")


def _single_floats(rows: DataFrame, key: str, column: str) -> DataFrame:
    one = F.array(F.coalesce(F.col(column), F.lit(1.0)).cast("float"))
    return float_bytes(rows.select(key, one.alias("one")), key, "one")
