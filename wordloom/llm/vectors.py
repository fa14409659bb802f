"""Vectors of models as distinct byte strings, packed into blocks of bounded size.

Rows with the very same vector are taken together before anything is compared, so a group of
copies costs no more than one row.  The distinct vectors of a model (of one length: a cell) are
packed into blocks of about BLOCK, one row of a table each: what a task has at once is a block
or a pair of blocks, whatever the size of the model, and models are joined to blocks, not to
single vectors.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.runtime import materialize

#: Rows of a cell that a model is fitted to, where it is fitted to a draw.
SAMPLE = 4096
#: Vectors of a block, about.
BLOCK = 8192

PACKED = "cell string, salt long, blocks long, total long, ids binary, vecs binary"


def stacked_vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary vectors of one length as a matrix of FLOAT."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = column.cast(pa.large_binary())
    if not len(wide):
        return np.zeros((0, 0), np.float32)
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), np.float32).reshape(len(wide), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    wide = vectors.astype(np.float64)
    largest = np.abs(wide).max(1, keepdims=True) if wide.size else np.zeros((len(wide), 1))
    wide /= np.where(largest > 0, largest, 1)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def mixed(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 well-mixed bits of each number, the same everywhere."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def read_block(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block in order, and their vectors as a matrix of FLOAT."""
    numbers = np.frombuffer(ids, np.int64)
    order = np.argsort(numbers, kind="stable")
    return numbers[order], np.frombuffer(vecs, np.float32).reshape(len(numbers), -1)[order]


def usable(rows: DataFrame, column: str) -> DataFrame:
    """row_id, cell (model and length) and vec (bytes of FLOAT) of the usable rows: those with a
    vector without nulls, of finite components that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            values = lists.flatten()
            missing = np.asarray(values.is_null())
            flat = np.asarray(values.fill_null(0)).astype(np.float32) + np.float32(0)
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(row, weights=missing | ~np.isfinite(flat), minlength=len(sizes)) > 0
            zero = np.bincount(row, weights=flat != 0, minlength=len(sizes)) == 0
            good = ~bad & ~zero
            ends = np.concatenate([[0], np.cumsum(sizes[good]) * 4]).astype(np.int32)
            data = flat[good[row]].tobytes()
            vectors = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), vectors], ["row_id", "model_id", "vec"])

    taken = rows.select("row_id", "model_id", F.col(column).alias("v")).where("v is not null and row_id is not null")
    kinds = dict(taken.dtypes)
    found = taken.mapInArrow(run, f"row_id {kinds['row_id']}, model_id {kinds['model_id']}, vec binary")
    cell = F.concat_ws(":", F.coalesce(F.col("model_id").cast("string"), F.lit("null")), (F.length("vec") / 4).cast("int"))
    return found.select("row_id", cell.alias("cell"), "vec")


@dataclass
class Distinct:
    """``blocks``: PACKED, each vector of a cell once, under the least row_id that has it;
    ``copies``: row_id and vec_id of every row of the vectors that several rows have."""

    blocks: DataFrame
    copies: DataFrame


def distinct_vectors(found: DataFrame, block: int = BLOCK) -> Distinct:
    """Each vector of a model once.  Copies are told by 128 bits of the bytes' digest, with partial
    aggregation, so those of one vector never meet in one task."""
    found = materialize(found.withColumn("digest", F.unhex(F.md5("vec"))))
    keys = found.select("row_id", "cell", "digest")
    several = keys.groupBy("cell", "digest").agg(F.min("row_id").alias("vec_id"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(keys.join(several.drop("n"), ["cell", "digest"]).select("row_id", "vec_id"))
    first = found.join(copies.where("row_id <> vec_id").select("row_id"), "row_id", "left_anti")
    sizes = keys.groupBy("cell").agg(F.count("*").alias("rows"))
    return Distinct(packed(first.select("cell", F.col("row_id").alias("vec_id"), "vec"), sizes, block), copies)


def packed(vectors: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``vectors`` (cell, vec_id, vec) as a table PACKED.  ``sizes``: rows of each cell."""
    # A row a cell: written, so that the planner knows how small it is.
    shares = materialize(sizes.select("cell", F.ceil(F.col("rows") / F.lit(float(block))).cast("long").alias("shares")))
    salted = vectors.join(shares, "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("shares")))

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id"))
        return pa.table(
            {
                "cell": table.column("cell").slice(0, 1),
                "salt": table.column("salt").slice(0, 1),
                "n": pa.array([len(ids)], pa.int64()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "vecs": pa.array([stacked_vectors(table.column("vec")).tobytes()], pa.binary()),
            }
        )

    grouped = salted.select("cell", "salt", F.col("vec_id").cast("long").alias("vec_id"), "vec").groupBy("cell", "salt")
    made = materialize(grouped.applyInArrow(run, "cell string, salt long, n long, ids binary, vecs binary"))
    known = materialize(made.groupBy("cell").agg(F.count("*").alias("blocks"), F.sum("n").alias("total")))
    return made.join(known, "cell").select("cell", "salt", "blocks", "total", "ids", "vecs")


def drawn(blocks: DataFrame, size: int, seed: int) -> DataFrame:
    """cell, ids, vecs of a draw of about ``size`` vectors of each cell.  ``blocks``: cell, total,
    ids, vecs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, total, ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                numbers, vectors = read_block(ids, vecs)
                keep = (mixed(numbers, seed) >> np.uint64(34)).astype(np.float64) < (1 << 30) * size / total
                yield pa.RecordBatch.from_pydict(
                    {"cell": [cell], "ids": [numbers[keep].tobytes()], "vecs": [vectors[keep].tobytes()]},
                    schema=pa.schema([("cell", pa.string()), ("ids", pa.binary()), ("vecs", pa.binary())]),
                )

    return blocks.select("cell", "total", "ids", "vecs").mapInArrow(run, "cell string, ids binary, vecs binary")


def joined_blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of all blocks of a table with ids and vecs, in order of the numbers."""
    return read_block(b"".join(table.column("ids").to_pylist()), b"".join(table.column("vecs").to_pylist()))
