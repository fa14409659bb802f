"""Reading files by ranges of bytes or lines, and writing one ordered file, in parallel.

Paths are of a file system that the driver and every executor see under the same name.
"""

from __future__ import annotations

import contextlib
import mmap
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.errors import ReadError
from wordloom.operators.line_parser import ASCII_SPACE

#: Bytes that one task reads.
SLICE = 32 << 20


def mapped(file):
    """The bytes of an open file, searched without being copied; a file of no bytes is one too."""
    return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(file.fileno()).st_size else contextlib.nullcontext(b"")


def exactly(file, size: int, what: str) -> bytes:
    data = file.read(size)
    if len(data) != size:
        raise ReadError(f"the file ends within {what}")
    return data


def row_slices(spark: SparkSession, path: str, begin: int, count: int, mark: bytes, tail: int) -> list[tuple[int, int, int, int]]:
    """First row, rows, place and end of stretches of ``count`` rows from ``begin`` on, each of which ends
    ``tail`` bytes behind the first ``mark`` in it.  A task hops from mark to mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            found, first, start, place = [], 0, begin, begin
            step = len(mark) + tail
            with open(path, "rb") as file, mapped(file) as data:
                for row in range(count):
                    if place - start >= SLICE:
                        found.append((first, row - first, start, place))
                        first, start = row, place
                    at = data.find(mark, place)
                    if at < 0 or at + step > len(data):
                        raise ReadError("the file ends within a row")
                    place = at + step
            found.append((first, count - first, start, place))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["first", "rows", "start", "end"])

    found = spark.range(0, 1, 1, 1).mapInArrow(run, "first long, rows long, start long, end long").collect()  # a row a stretch
    return [tuple(r) for r in found]


class Marked:
    """Rows that end ``tail`` bytes behind the first ``mark`` in them: the key of a place is the next
    mark, and where a row ends depends on its key only."""

    def __init__(self, mark: bytes, tail: int):
        self.mark, self.tail = mark, tail

    def key(self, data, place: int) -> int:
        return data.find(self.mark, place)

    def after(self, data, key: int) -> int:
        return key + len(self.mark) + self.tail

    def keys(self, data, low: int, high: int) -> Iterator[int]:
        """All keys of places from ``low`` on that are below ``high``."""
        key = data.find(self.mark, low)
        while 0 <= key < high:
            yield key
            key = data.find(self.mark, key + 1)


class Sized:
    """Items with their length before them, as four little-endian bytes: the key of a place is itself."""

    def key(self, data, place: int) -> int:
        return place if place + 4 <= len(data) else -1

    def after(self, data, key: int) -> int:
        return key + 4 + int.from_bytes(data[key : key + 4], "little")

    def keys(self, data, low: int, high: int) -> Iterator[int]:
        return iter(range(low, min(high, len(data) - 3)))


#: Bytes at the beginning of a range in which a row is expected to begin, besides a row's fixed part.
ENTRY = 4096


def row_stretches(spark: SparkSession, path: str, begin: int, end: int, count: int, rows: Marked | Sized) -> list[tuple[int, int, int, int]]:
    """First row, rows, place and end of stretches of ``count`` rows that lie from ``begin`` on, before
    ``end``, found by ranges of bytes in parallel.

    A task does not know where in its range a row begins, so it follows the rows from every place near
    the front at which one may; chains that meet go on as one.  The driver then links the ranges, from
    a few numbers of each.  A range in which that fails, as behind a very long word, is read by a
    task of its own from the place at which its first row is known to begin.
    """
    window = ENTRY + getattr(rows, "tail", 0)
    ranges = [(low, min(low + SLICE, end)) for low in range(begin, end, SLICE)]

    def follow(data, starts: list[int], high: int) -> list[tuple[int, int, int]]:
        """Key, rows that begin before ``high``, and where the last of them ends, of chains from keys."""
        known: dict[int, tuple[int, int]] = {}
        for key in starts:
            trail = []
            while key not in known:
                trail.append(key)
                place = rows.after(data, key)
                if place >= high or place > end:
                    known[key] = (1, place if place <= end else -1)
                    break
                following = rows.key(data, place)
                if following < 0 or rows.after(data, following) > end:
                    known[key] = (1, place)
                    break
                key = following
            more, last = known[trail[-1]] if trail and trail[-1] in known else known[key]
            for k, x in enumerate(reversed([x for x in trail if x not in known]), 1):
                known[x] = (more + k, last)
        return [(key, *known[key]) for key in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, entry in zip(*(c.to_pylist() for c in batch.columns)):
                with open(path, "rb") as file, mapped(file) as data:
                    if entry < 0:
                        starts = [k for k in rows.keys(data, low, min(low + window, high)) if rows.after(data, k) <= end]
                    else:
                        starts = [rows.key(data, entry)]
                    found = [(low, *x) for x in follow(data, starts, high) if x[2] >= 0]
                columns = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    names = ["low", "key", "rows", "last"]

    def ask(asked: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        table = spark.createDataFrame(asked, "low long, high long, entry long").repartition(len(asked), "low")
        out: dict[int, list[tuple[int, int, int]]] = {}
        for r in table.mapInArrow(run, "low long, key long, rows long, last long").collect():
            out.setdefault(r.low, []).append((r.key, r.rows, r.last))
        return {low: sorted(x) for low, x in out.items()}

    told = ask([(low, high, -1) for low, high in ranges]) if len(ranges) > 1 else {}
    out, first, place = [], 0, begin
    for low, high in ranges:
        if first >= count:
            break
        if place >= high:
            continue
        exact = [x for x in told.get(low, []) if x[0] >= place and (isinstance(rows, Marked) or x[0] == place)]
        if not exact or place < low:
            exact = ask([(low, high, place)]).get(low, [])
        if not exact:
            raise ReadError("the file ends within a row")
        _, number, last = exact[0]
        if first + number > count or last < 0:
            raise ReadError("the file has not the rows it should have")
        out.append((first, number, place, last))
        first, place = first + number, last
    if first < count:
        raise ReadError("the file ends within a row")
    return out or [(0, 0, begin, begin)]


def matrix_rows(spark: SparkSession, path: str, offset: int, rows: int, dims: int, first: int = 0) -> DataFrame:
    """idx (from ``first``), embedding of a little-endian FLOAT matrix, a range of rows a task."""
    width = 4 * dims
    per = max(1, SLICE // max(width, 1))
    slices = -(-rows // per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                low = number * per
                count = min(per, rows - low)
                with open(path, "rb") as file:
                    file.seek(offset + low * width)
                    values = np.frombuffer(exactly(file, count * width, "the matrix"), "<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, count * dims + 1, dims, dtype=np.int32)) if dims else pa.array(np.zeros(count + 1, np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + low, first + low + count)), lists], ["idx", "embedding"])

    return spark.range(0, slices, 1, max(1, slices)).mapInArrow(run, "idx long, embedding array<float>")


def code_rows(spark: SparkSession, path: str, offset: int, rows: int, width: int) -> DataFrame:
    """idx, codes of a matrix of bytes."""
    per = max(1, SLICE // max(width, 1))
    slices = -(-rows // per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                low = number * per
                count = min(per, rows - low)
                with open(path, "rb") as file:
                    file.seek(offset + low * width)
                    values = np.frombuffer(exactly(file, count * width, "the codes"), np.uint8).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, count * width + 1, width, dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + count)), lists], ["idx", "codes"])

    return spark.range(0, slices, 1, max(1, slices)).mapInArrow(run, "idx long, codes array<smallint>")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text file's lines, ended by a line feed, bytes as they are."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    sizes = raw.groupBy("block").count()
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block of the file
    shifts = sizes.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("block").orderBy("place")
    return raw.join(F.broadcast(shifts), "block").select((F.row_number().over(within) - 1 + F.col("shift")).alias("line"), "value")


def first_line(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.readline()


def fields(line: bytes) -> list[bytes]:
    """The parts of a line between ASCII white space, as all lines are cut."""
    return [part for part in re.split(ASCII_SPACE.encode(), line) if part]


def write_parts(rows: DataFrame, order: str, data: str, folder: str) -> list[tuple[str, int]]:
    """The bytes of ``rows`` in files in order, with their sizes; a range of rows a task.  A task that
    runs again replaces its own file."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        target = os.path.join(folder, f"part-{part:08d}")
        draft = f"{target}.{uuid.uuid4().hex}"
        with open(draft, "wb") as file:
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    file.write(value)
            size = file.tell()
        os.replace(draft, target)
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([size])], ["path", "size"])

    sorted_ = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(data)
    return sorted((r.path, r["size"]) for r in sorted_.mapInArrow(run, "path string, size long").collect())  # a row a task


def place_parts(spark: SparkSession, parts: list[tuple[str, int]], path: str, begin: int) -> int:
    """Copies parts one behind the other into a file, each by a task, from a place on; where they end."""
    places = []
    for part, size in parts:
        places.append((part, begin))
        begin += size
    os.truncate(path, begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at in zip(*(c.to_pylist() for c in batch.columns)):
                with open(part, "rb") as source, open(path, "r+b") as target:
                    target.seek(at)
                    shutil.copyfileobj(source, target, 1 << 20)
            yield batch.slice(0, 0)

    if places:
        table = spark.createDataFrame(places, "path string, at long").repartition(len(places), "at")
        table.mapInArrow(run, "path string, at long").collect()  # no row
    return begin


class OrderedFile:
    """One file put together from bytes of the driver and, by tasks, from ordered tables."""

    def __init__(self, path: str):
        self.path = path
        self.draft = f"{path}.{uuid.uuid4().hex}"
        self.file = open(self.draft, "wb")  # noqa: SIM115

    def __enter__(self) -> OrderedFile:
        return self

    def position(self) -> int:
        return self.file.tell()

    def bytes(self, data: bytes) -> None:
        self.file.write(data)

    def table(self, rows: DataFrame, order: str, data: str = "data") -> None:
        folder = f"{self.draft}.parts"
        try:
            parts = write_parts(rows, order, data, folder)
            self.file.flush()
            self.file.seek(place_parts(rows.sparkSession, parts, self.draft, self.file.tell()))
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def __exit__(self, kind, error, trace) -> None:
        self.file.close()
        if kind is None:
            os.replace(self.draft, self.path)
        else:
            os.remove(self.draft)


def float_bytes(rows: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key, data: the components of each vector as little-endian FLOAT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten(), "<f4").tobytes()
            ends = np.cumsum(np.diff(np.asarray(lists.offsets))) * 4 if len(lists) else []
            starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(lists) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b] for a, b in zip(starts, ends)], pa.binary())], [key, "data"])

    return rows.select(key, F.col(column).cast("array<float>").alias("v")).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, data binary")
