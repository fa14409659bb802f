"""The most similar vectors of every vector (problem 5).

Learned partitions: the neighbour graph of a sample is divided into balanced parts, a small
classifier learns in which parts a vector's neighbours are, and every vector is compared
exactly with those of its most probable parts, as many as hold the asked share of probability.
Parts that are still large are divided again.  What can't be divided, as vectors that are nearly
equal, is compared block against block, so no task has more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.vectors import BLOCK, SAMPLE, distinct_vectors, drawn, joined_blocks, pack, read_block, unit_rows, unpack, usable
from wordloom.runtime import materialize

#: Vectors of a partition above which it is divided, and parts it is divided into at most.
TARGET, PARTS = 2048, 64
#: Neighbours in the graph that is divided.
GRAPH = 10
#: Share of the probability that the searched parts hold.
MASS = 0.99
#: Share of a cell that its largest part may have for the division to count as one.
MOST = 0.8


def _knn(unit: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(unit) - 1)
    out = np.zeros((len(unit), k), np.int64)
    for low in range(0, len(unit), 1024):
        score = unit[low : low + 1024] @ unit.T
        score[np.arange(len(score)), np.arange(low, low + len(score))] = -2
        out[low : low + len(score)] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.15, rounds: int = 12) -> np.ndarray:
    """A part for each node, of nearly equal sizes, with few edges between parts: equal cuts
    along principal directions, then moves to the part of most neighbours while there is room."""
    n = len(unit)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, low, number = todo.pop()
        if number == 1 or len(rows) < 2:
            part[rows] = low
            continue
        half = number // 2
        centred = unit[rows] - unit[rows].mean(0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = np.argsort(centred @ direction, kind="stable")
        cut = len(rows) * half // number
        todo.append((rows[order[:cut]], low, half))
        todo.append((rows[order[cut:]], low + half, number - half))
    room = math.ceil(n / parts * (1 + slack))
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    for _ in range(rounds):
        votes = np.bincount(source * parts + part[target], minlength=n * parts)
        votes += np.bincount(target * parts + part[source], minlength=n * parts)
        votes = votes.reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        movers = np.flatnonzero(gain > 0)
        if not len(movers):
            break
        movers = movers[np.lexsort((movers, -gain[movers]))]
        size = np.bincount(part, minlength=parts)
        # The place of each mover among those that want the same part.
        order = np.argsort(best[movers], kind="stable")
        wanted = best[movers][order]
        place = np.arange(len(wanted)) - np.searchsorted(wanted, wanted)
        good = order[place < (room - size)[wanted]]
        if not len(good):
            break
        part[movers[good]] = best[movers[good]]
    return part


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(1, keepdims=True)


def _inputs(vectors: np.ndarray) -> np.ndarray:
    unit = unit_rows(vectors).astype(np.float32)
    return np.concatenate([unit * np.float32(math.sqrt(unit.shape[1])), np.ones((len(unit), 1), np.float32)], axis=1)


def fit_router(vectors: np.ndarray, size: int, target: int = TARGET) -> bytes:
    """Weights of a linear classifier of unit vectors over the parts of a partition of ``size``
    vectors, of which ``vectors`` are a draw; empty where they can't be divided."""
    unit = unit_rows(vectors).astype(np.float32)
    parts = min(PARTS, math.ceil(size / (0.75 * target)))
    if parts < 2 or len(unit) <= 2 * parts:
        return b""
    graph = _knn(unit, GRAPH)
    part = balanced_parts(unit, graph, parts)
    # What is to be learned: where the neighbours are.
    wanted = np.zeros((len(unit), parts), np.float32)
    np.add.at(wanted, (np.repeat(np.arange(len(unit)), graph.shape[1]), part[graph].ravel()), 1)
    wanted /= wanted.sum(1, keepdims=True)
    inputs = _inputs(vectors)
    weight = np.zeros((inputs.shape[1], parts), np.float32)
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, 201):
        chance = _softmax(inputs @ weight)
        slope = inputs.T @ (chance - wanted) / len(inputs) + 1e-4 * weight
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weight -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    own = np.bincount((inputs @ weight).argmax(1), minlength=parts)
    return pack(weight=weight) if own.max() <= MOST * len(inputs) else b""


def route_vectors(model: bytes, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of each vector, from the most probable on, until they hold MASS: row numbers, parts,
    and whether the part is the most probable one."""
    chance = _softmax(_inputs(vectors) @ unpack(model)["weight"])
    order = np.argsort(-chance, axis=1, kind="stable")
    held = np.take_along_axis(chance, order, 1).cumsum(1)
    search = np.concatenate([np.ones((len(chance), 1), bool), held[:, :-1] < MASS], axis=1)
    row, place = np.nonzero(search)
    return row, order[row, place], place == 0


CELLS = "cell string, size long, n long, ids binary, vecs binary, own binary"
_CELLS = pa.schema([("cell", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("own", pa.binary())])


def _slices(cell: str, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> dict:
    """Vectors of a cell as rows CELLS of at most BLOCK vectors."""
    cuts = range(0, len(ids), BLOCK)
    return {
        "cell": [cell] * len(cuts), "size": [int(own[k : k + BLOCK].sum()) for k in cuts], "n": [len(ids[k : k + BLOCK]) for k in cuts],
        "ids": [ids[k : k + BLOCK].tobytes() for k in cuts], "vecs": [vectors[k : k + BLOCK].tobytes() for k in cuts],
        "own": [own[k : k + BLOCK].tobytes() for k in cuts],
    }


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows CELLS the vectors in their own cells."""
    schema = pa.schema([("cell", pa.string()), ("total", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary())])
    for batch in batches:
        for cell, total, ids, vecs, own in zip(*(c.to_pylist() for c in batch.columns)):
            keep = np.frombuffer(own, bool)
            numbers = np.frombuffer(ids, np.int64)
            vectors = np.frombuffer(vecs, np.float32).reshape(len(numbers), -1)
            yield pa.RecordBatch.from_pydict(
                {"cell": [cell], "total": [total], "ids": [numbers[keep].tobytes()], "vecs": [vectors[keep].tobytes()]}, schema=schema
            )


def partitions(blocks: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """Rows CELLS: every vector in its own cell and, with ``own`` false, in the others in which its
    neighbours may be (``size`` counts the first, ``n`` all); and cell, total (own vectors) and n of
    each cell.  Cells of more than ``target`` own vectors are divided, until none is left that can be.

    A router is joined to blocks, by broadcast while the planner finds the routers small.  A level is
    a pass without a shuffle over the cells that are still large, and written only if another follows."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                numbers, vectors = read_block(ids, vecs)
                yield pa.RecordBatch.from_pydict(_slices(cell, numbers, vectors, np.ones(len(numbers), bool)), schema=_CELLS)

    rows = blocks.select("cell", "ids", "vecs").mapInArrow(first, CELLS)
    sizes = materialize(blocks.select("cell", "total", F.col("total").alias("n")).distinct())
    done: list[tuple[DataFrame, DataFrame]] = []
    level = 0
    while True:
        large = materialize(sizes.where(F.col("total") > target).select("cell", "total"))
        if large.isEmpty():
            done.append((rows, sizes))
            break
        if level:
            rows = materialize(rows)
        seed = level

        def learn(table: pa.Table) -> pa.Table:
            model = fit_router(joined_blocks(table)[1], table.column("total")[0].as_py(), target)
            return pa.table({"cell": table.column("cell").slice(0, 1), "model": pa.array([model], pa.binary())})

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell, ids, vecs, own, model in zip(*(c.to_pylist() for c in batch.columns)):
                    numbers, mine = np.frombuffer(ids, np.int64), np.frombuffer(own, bool)
                    vectors = np.frombuffer(vecs, np.float32).reshape(len(numbers), -1)
                    row, part, likeliest = route_vectors(model, vectors)
                    for p in np.unique(part):
                        here = part == p
                        r = row[here]
                        made = _slices(f"{cell}/{p}", numbers[r], vectors[r], mine[r] & likeliest[here])
                        yield pa.RecordBatch.from_pydict(made, schema=_CELLS)

        held = rows.join(large, "cell").select("cell", "total", "ids", "vecs", "own")
        draw = drawn(held.mapInArrow(_owned, "cell string, total long, ids binary, vecs binary"), SAMPLE, seed).join(large, "cell")
        models = materialize(draw.groupBy("cell").applyInArrow(learn, "cell string, model binary")).where("length(model) > 0")
        divided = models.select("cell")
        done.append((rows.join(divided, "cell", "left_anti"), sizes.join(divided, "cell", "left_anti")))
        rows = rows.join(models, "cell").select("cell", "ids", "vecs", "own", "model").mapInArrow(send, CELLS)
        sizes = materialize(rows.groupBy("cell").agg(F.sum("size").alias("total"), F.sum("n").alias("n")))
        level += 1
    whole, counted = done[0]
    for more, number in done[1:]:
        whole, counted = whole.unionByName(more), counted.unionByName(number)
    return whole, counted


HITS = "vec_id long, other long, cosine long"
_HITS = pa.schema([("vec_id", pa.int64()), ("other", pa.int64()), ("cosine", pa.int64())])


#: Scores that are held at once, and the score of a vector with itself.
SCORES, _SELF = 1 << 21, -(1 << 40)


def search(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], k: int) -> list[np.ndarray]:
    """The ``k`` best other vectors for each one asked: vec_id, other and the cosine in millionths, by
    the rounded cosine, then the number, in order of which ``held`` is.  Single precision finds who may be among them, double
    precision decides."""
    ids, unit = asked[0], unit_rows(asked[1])
    others, base = held[0], unit_rows(held[1])
    if not len(ids) or not len(others):
        return [np.zeros(0, np.int64)] * 3
    quick, quick_base = unit.astype(np.float32), base.astype(np.float32).T
    out = []
    top = min(k + 1, len(others))  # one may be the vector itself
    step = max(1, SCORES // len(others))
    for low in range(0, len(ids), step):
        score = quick[low : low + step] @ quick_base
        least = np.partition(score, len(others) - top, axis=1)[:, len(others) - top]
        close = score >= (least - np.float32(4e-6))[:, None]
        if np.count_nonzero(close) > 8 * top * len(close):  # vectors that are nearly equal
            cosine = np.rint(unit[low : low + step] @ base.T * 1e6).astype(np.int64)
            cosine[ids[low : low + step, None] == others] = _SELF
            # The least of the kept ones; equal ones are settled below.
            least = np.partition(cosine, len(others) - top, axis=1)[:, [len(others) - top]]
            above = cosine > least
            # Of those that are as near as the least, in order of the numbers, so many as are missing.
            level = (cosine == least) & (cosine > _SELF)
            level &= np.cumsum(level, axis=1) <= top - above.sum(1, keepdims=True)
            row, column = np.nonzero(above | level)
            cosine = cosine[row, column]
            row = row + low
        else:
            row, column = np.divmod(np.flatnonzero(close), len(others))
            good = ids[low + row] != others[column]
            row, column = row[good] + low, column[good]
            cosine = np.rint(np.einsum("ij,ij->i", unit[row], base[column]) * 1e6).astype(np.int64)
        order = np.lexsort((others[column], -cosine, row))
        row, column, cosine = row[order], column[order], cosine[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        good = place < k
        out.append((ids[row[good]], others[column[good]], cosine[good]))
    return [np.concatenate(x) for x in zip(*out)]


def nearest_vectors(blocks: DataFrame, k: int, target: int, block: int = BLOCK) -> DataFrame:
    """vec_id, other, cosine (in millionths): the ``k`` best of those found for each vector, as far
    as the vectors it was compared with hold so many.  ``blocks``: PACKED."""
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                block_ = read_block(ids, vecs)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in search(block_, block_, k)], schema=_HITS)

    small = (F.col("blocks") == 1) & (F.col("total") <= target)
    rows, sizes = partitions(blocks.where(~small), target)
    shares = sizes.select("cell", F.ceil(F.col("n") / F.lit(2.0 * block)).cast("long").alias("shares"))
    salted = rows.join(shares, "cell").withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("shares")))
    # Task (asking, holding): a block asks all blocks of its cell, and is asked by all others.
    numbers = F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)
    task = lambda asking, holding, asks, holds: F.struct(asking.alias("asking"), holding.alias("holding"), asks.alias("asks"), holds.alias("holds"))
    salt, yes, no = F.col("salt"), F.lit(True), F.lit(False)
    asks = F.transform(numbers, lambda x: task(salt, x, yes, salt == x))
    holds = F.transform(F.filter(numbers, lambda x: (x != salt) & (F.col("size") > 0)), lambda x: task(x, salt, no, yes))
    tasks = salted.select("cell", "ids", "vecs", "own", F.explode(F.concat(asks, holds)).alias("t")).select("cell", "ids", "vecs", "own", "t.*")

    def find(table: pa.Table) -> pa.Table:
        sides = []
        for side in ("asks", "holds"):
            part = table.filter(table.column(side))
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.int64)
            vectors = np.frombuffer(b"".join(part.column("vecs").to_pylist()), np.float32).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.float32)
            own = np.frombuffer(b"".join(part.column("own").to_pylist()), bool)
            if side == "holds":
                order = np.flatnonzero(own)[np.argsort(ids[own], kind="stable")]
                ids, vectors = ids[order], vectors[order]
            sides.append((ids, vectors))
        return pa.table([pa.array(x) for x in search(*sides, k)], schema=_HITS)

    hits = tasks.groupBy("cell", "asking", "holding").applyInArrow(find, HITS)
    hits = blocks.where(small).select("ids", "vecs").mapInArrow(alone, HITS).unionByName(hits)
    best = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")
    return hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def nearest_rows(rows: DataFrame, column: str = "embedding", k: int = 5, target: int = TARGET, block: int = BLOCK) -> DataFrame:
    """row_id, other_id, cosine, place: the ``k`` most similar other rows of each row's model.

    ``rows``: row_id (key), model_id, a column of FLOAT arrays; other columns are ignored.
    Cosines are of double precision, rounded to 6 decimals; of equal ones the smaller row_id
    comes first.  Null and zero vectors and those with nulls or infinite components take no
    part; vectors of different lengths are not compared; repeated rows are rows of their own;
    a null model_id is a model.  In a model of up to k usable rows all others are nearest.
    Models of up to ``target`` different vectors are one partition and searched as a whole.
    No task has more than two blocks, of about 2 x ``block`` vectors each.
    """
    found = distinct_vectors(usable(rows, column), block)
    top = nearest_vectors(found.blocks, k, target, block)
    # From vectors back to rows: copies of a vector are its nearest rows themselves.
    first = Window.partitionBy("vec_id").orderBy("row_id")
    copies = found.copies.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    copies = materialize(copies.select("vec_id", F.col("row_id").alias("other_id")))
    several = copies.select("vec_id", "other_id", F.lit(1_000_000).cast("long").alias("cosine"))
    others = top.join(copies.withColumnRenamed("vec_id", "other"), "other", "left")
    near = others.select("vec_id", F.coalesce("other_id", "other").alias("other_id"), "cosine").unionByName(several)
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    last = Window.partitionBy("row_id").orderBy(F.desc("cosine"), "other_id")
    return (
        near.join(found.copies, "vec_id", "left")
        .select(F.coalesce("row_id", "vec_id").alias("row_id"), "other_id", "cosine")
        .where("row_id <> other_id")
        .withColumn("place", F.row_number().over(last))
        .where(F.col("place") <= k)
        .select("row_id", "other_id", (F.col("cosine") / 1e6).alias("cosine"), "place")
    )


def nearest_pairs(rows: DataFrame, column: str = "embedding", k: int = 5, target: int = TARGET) -> DataFrame:
    """row_id_a < row_id_b: pairs of which one row is among the nearest of the other."""
    near = nearest_rows(rows, column, k, target)
    return near.select(F.least("row_id", "other_id").alias("row_id_a"), F.greatest("row_id", "other_id").alias("row_id_b")).distinct()
