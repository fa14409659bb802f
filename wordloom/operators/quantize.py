"""Product quantization: decoding by codebooks, encoding, training and reconstruction."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.errors import QuantizationError


def book_table(books: DataFrame) -> DataFrame:
    """One row a quantizer: for each subquantizer, in order, the vectors by number of centroid, null
    for numbers that are none.  ``books``: quantizer_id, sub, centroid (from 0), vec.
    """
    subs = (
        books.where("quantizer_id is not null and sub is not null and centroid >= 0 and vec is not null")
        .dropDuplicates(["quantizer_id", "sub", "centroid"])
        .groupBy("quantizer_id", "sub")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("centroid").cast("int"), "vec"))).alias("by"), F.max("centroid").alias("most"))
        .select("quantizer_id", "sub", F.transform(F.sequence(F.lit(0), F.col("most").cast("int")), lambda c: F.try_element_at("by", c)).alias("vecs"))
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sub", "vecs"))), lambda s: s["vecs"])
    return subs.groupBy("quantizer_id").agg(listed.alias("book"))


def decoded(codes: Column, book: Column, norm: Column) -> Column:
    """The vector that codes name: centroids one after the other, times the norm where there is
    one.  Null where codes are null, of the wrong number or name no centroid."""
    parts = F.transform(codes, lambda c, i: F.get(F.get(book, i), c.cast("int")))
    good = (F.size(codes) == F.size(book)) & ~F.exists(parts, lambda p: p.isNull())
    scale = F.coalesce(norm.cast("float"), F.lit(1.0).cast("float"))
    return F.when(good, F.transform(F.flatten(parts), lambda x: (x * scale).cast("float")))


def decode_rows(rows: DataFrame, books: DataFrame) -> DataFrame:
    """``rows`` (quantizer_id, codes, norm and what else there is) with ``embedding`` added.

    An unknown or null quantizer gives a null vector.  ``rows`` are not shuffled as long as the
    planner finds the codebooks small enough to be broadcast.
    """
    table = book_table(books).withColumnRenamed("quantizer_id", "book_quantizer")
    joined = rows.join(table, F.col("quantizer_id") == F.col("book_quantizer"), "left")
    return joined.withColumn("embedding", decoded(F.col("codes"), F.col("book"), F.col("norm"))).drop("book_quantizer", "book")


@dataclass(frozen=True)
class Quantizer:
    """``centroids``: subquantizers x centroids x components; ``projection``: a rotation of the
    vectors before they are cut, or None."""

    centroids: np.ndarray
    projection: np.ndarray | None = None

    @property
    def reconstructed_len(self) -> int:
        return self.centroids.shape[0] * self.centroids.shape[2]

    @property
    def quantized_len(self) -> int:
        return self.centroids.shape[0]

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return x if self.projection is None else x @ self.projection

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each part of each row; of equal ones the first."""
        parts = self.rotated(x).reshape(len(x), self.centroids.shape[0], -1)
        out = np.empty(parts.shape[:2], np.int16)
        for q, book in enumerate(self.centroids):
            out[:, q] = ((book * book).sum(1) - 2 * parts[:, q] @ book.T).argmin(1)
        return out

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        x = self.centroids[np.arange(self.quantized_len), codes].reshape(len(codes), -1)
        return x if self.projection is None else x @ self.projection.T

    def books(self, spark: SparkSession, quantizer_id: int = 0) -> DataFrame:
        """quantizer_id, sub, centroid, vec."""
        rows = [
            (quantizer_id, q, c, [float(x) for x in vec]) for q, book in enumerate(self.centroids) for c, vec in enumerate(book)
        ]
        return spark.createDataFrame(rows, "quantizer_id int, sub int, centroid int, vec array<float>")

    @staticmethod
    def from_books(books: DataFrame, quantizer_id: int) -> Quantizer:
        """A quantizer from its table, whose size is fixed by its shape."""
        rows = sorted(books.where(F.col("quantizer_id") == quantizer_id).select("sub", "centroid", "vec").collect())
        subs = len({r["sub"] for r in rows})
        if not rows or len(rows) % subs or len({len(r["vec"]) for r in rows}) != 1:
            raise QuantizationError("the codebook is no box of numbers")
        return Quantizer(np.array([r["vec"] for r in rows], np.float64).reshape(subs, len(rows) // subs, -1))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def encode_rows(rows: DataFrame, quantizer: Quantizer, key: str, normalize: bool = False) -> DataFrame:
    """key, codes and norm of rows with a vector; norm is null unless ``normalize``, which
    codes vectors of length 1 and keeps the lengths (zero vectors as they are)."""
    shared = rows.sparkSession.sparkContext.broadcast(quantizer)  # of the codebook's fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            norm = np.linalg.norm(x, axis=1)
            if normalize:
                x = x / np.where(norm > 0, norm, 1)[:, None]
            codes = shared.value.codes(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            norms = pa.array(norm.astype(np.float32)) if normalize else pa.nulls(len(batch), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, norms], [key, "codes", "norm"])

    taken = rows.select(key, "embedding").where("embedding is not null")
    return taken.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, codes array<smallint>, norm float")


def reconstruct(coded: DataFrame, quantizer: Quantizer, key: str) -> DataFrame:
    """key, embedding: every row of codes decoded, times its norm where it has one."""
    shared = coded.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = np.asarray(batch.column(1).flatten()).reshape(len(batch), -1)
            norm = np.asarray(batch.column(2).fill_null(1.0), np.float64)
            x = (shared.value.vectors(codes) * norm[:, None]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "embedding"])

    return coded.select(key, "codes", "norm").mapInArrow(run, f"`{key}` {dict(coded.dtypes)[key]}, embedding array<float>")


def _pass(rows: DataFrame, quantizer: Quantizer, normalize: bool, correlate: bool) -> tuple[np.ndarray, np.ndarray, float, np.ndarray | None]:
    """One pass over all rows: sums and counts of the parts nearest to each centroid, the loss
    and, for the rotation, the products of rows and their decodings.  Partitions send one row
    each, of the codebook's size, and are added up in a tree."""
    shared = rows.sparkSession.sparkContext.broadcast(quantizer)
    q, k, d = quantizer.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums, counts, loss, cross = np.zeros((q, k, d)), np.zeros((q, k)), 0.0, np.zeros((q * d, q * d) if correlate else 0)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(0))
            if normalize:
                norm = np.linalg.norm(x, axis=1)
                x = x / np.where(norm > 0, norm, 1)[:, None]
            codes = own.codes(x)
            parts = own.rotated(x).reshape(len(x), q, d)
            near = own.centroids[np.arange(q), codes]
            loss += float(((parts - near) ** 2).sum())
            for s in range(q):
                np.add.at(sums[s], codes[:, s], parts[:, s])
                counts[s] += np.bincount(codes[:, s], minlength=k)
            if correlate:
                cross += x.T @ near.reshape(len(x), -1)
        state = np.concatenate([sums.ravel(), counts.ravel(), [loss], cross.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], ["state"])

    states = rows.select("embedding").mapInArrow(run, "state binary")
    total = states.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(lambda a, b: a + b)
    at = q * k * d
    cross = total[at + q * k + 1 :].reshape(q * d, q * d) if correlate else None
    return total[:at].reshape(q, k, d), total[at : at + q * k].reshape(q, k), float(total[at + q * k]), cross


def train(
    rows: DataFrame,
    subquantizers: int,
    bits: int,
    iterations: int = 10,
    attempts: int = 1,
    normalize: bool = False,
    rotate: bool = False,
    seed: int = 42,
    key: str = "idx",
) -> tuple[Quantizer, float]:
    """A quantizer of all rows and its mean squared loss.

    All subspaces are clustered together, a pass over the rows each iteration; of several
    attempts the best is kept.  ``rotate`` learns a rotation as well, by alternating with the
    orthogonal Procrustes solution.  The first centroids are drawn by hash, so the same seed
    gives the same quantizer.  Raises if bits are above 8 or above the logarithm of the rows,
    or if the parts don't divide the vector.
    """
    usable = rows.where("embedding is not null")
    n, dims = usable.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not 0 < bits <= min(8, int(math.log2(n)) if n else 0):
        raise QuantizationError(f"bits must be from 1 to {min(8, int(math.log2(n)) if n else 0)}")
    if subquantizers < 1 or dims % subquantizers:
        raise QuantizationError("the parts must divide the vector")
    count, best = 1 << bits, None
    for attempt in range(max(1, attempts)):
        order = F.xxhash64(key, F.lit(seed), F.lit(attempt))
        first = np.array([r.embedding for r in usable.orderBy(order, key).limit(count).collect()], np.float64)
        if normalize:
            norm = np.linalg.norm(first, axis=1, keepdims=True)
            first = first / np.where(norm > 0, norm, 1)
        centroids = first.reshape(count, subquantizers, -1).transpose(1, 0, 2).copy()
        quantizer = Quantizer(centroids, np.eye(dims) if rotate else None)
        for _ in range(max(1, iterations)):
            sums, counts, _, cross = _pass(usable, quantizer, normalize, rotate)
            centroids = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], quantizer.centroids)
            projection = quantizer.projection
            if rotate:
                left, _, right = np.linalg.svd(cross)
                projection = left @ right
            quantizer = Quantizer(centroids, projection)
        loss = _pass(usable, quantizer, normalize, False)[2] / n
        if best is None or loss < best[1]:
            best = quantizer, loss
    return best
