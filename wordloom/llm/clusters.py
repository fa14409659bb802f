"""Groups of mutually similar rows, with size and most typical rows (problem 3).

A Gaussian mixture is fitted to all of each model's vectors, standardised and reduced to their main
directions, by expectation-maximisation with regularised covariances; the Bayesian information
criterion alone chooses the number of components among COMPONENTS.  A model of one block is fitted in
one task; of a larger one a draw gives only the start, and moments, criterion and steps are passes
over all its blocks with partial sums.  A component holds many of the groups that are asked for, which
may be of two rows, so the mixture can't tell them apart: each vector is compared with its whole
model, block against block, and a group counts if all its rows are similar to each other and to no
other row.  The mixture describes the groups: by their component, and by the rows of highest density,
which stand for their group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.vectors import BLOCK, SAMPLE, distinct_vectors, drawn, joined_blocks, mixed, pack, read_block, unit_rows, unpack, usable
from wordloom.operators.quantize import decode_rows
from wordloom.runtime import materialize

#: Least cosine of similar rows.
SIMILAR = 0.70
#: Main directions, and components to choose from.
DIRECTIONS, COMPONENTS = 16, (1, 2, 4, 8, 16, 32)
#: Share of a covariance that is shrunk to a sphere.
SHRINK = 0.1
#: Most steps of a fit in one task and most passes over a larger cell, and the gain in log-likelihood
#: a vector at which either ends.
STEPS, PASSES, ENOUGH = 25, 8, 1e-3
#: Typical rows given of a group.
TYPICAL = 3


def _features(x: np.ndarray) -> np.ndarray:
    """1, the coordinates and their products: the logarithm of a Gaussian's density is linear in
    them, and their sums are all that a step needs."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def _coefficients(weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """For each component the coefficients of its weighted log-density in the features."""
    d = mean.shape[1]
    i, j = np.triu_indices(d)
    inverse = np.linalg.inv(cov)
    slope = np.einsum("kij,kj->ki", inverse, mean)
    level = np.log(weight) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (slope * mean).sum(1) - 0.5 * d * math.log(2 * math.pi)
    square = np.where(i == j, -0.5, -1.0) * inverse[:, i, j]
    return np.concatenate([level[:, None], slope, square], axis=1).T


def _moved(sums: np.ndarray, d: int) -> np.ndarray:
    """Coefficients of the mixture whose components have these sums of features."""
    total = sums[:, 0] + 1e-9
    i, j = np.triu_indices(d)
    mean = sums[:, 1 : 1 + d] / total[:, None]
    cov = np.empty((len(sums), d, d))
    cov[:, i, j] = cov[:, j, i] = sums[:, 1 + d :] / total[:, None]
    cov -= mean[:, :, None] * mean[:, None, :]
    sphere = SHRINK * np.trace(cov, axis1=1, axis2=2) / d + 1e-3
    cov = (1 - SHRINK) * cov + sphere[:, None, None] * np.eye(d)
    return _coefficients(total / total.sum(), mean, cov)


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(1, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(1, keepdims=True)))[:, 0]


def _responsibilities(features: np.ndarray, coefficients: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood, and the sums of features by responsibility."""
    logs = features @ coefficients
    top = logs.max(1, keepdims=True)
    share = np.exp(logs - top)
    total = share.sum(1, keepdims=True)
    now = float((top + np.log(total)).sum())
    share /= total
    return now, share.T @ features


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        chosen.append(int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _criterion(now: float, n: int, k: int, d: int) -> float:
    return (k * (d + d * (d + 1) / 2) + k - 1) * math.log(n) - 2 * now


def mixture(x: np.ndarray, k: int, features: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """A mixture of ``k`` Gaussians: its log-likelihood and coefficients."""
    features = _features(x) if features is None else features
    rng = np.random.default_rng(k)
    n, d = x.shape
    seeds = _seeds(x, k, rng)
    near = ((seeds**2).sum(1) - 2 * x @ seeds.T).argmin(1)
    coefficients = _moved(np.eye(k)[near].T @ features, d)
    before = -np.inf
    for _ in range(STEPS):
        now, sums = _responsibilities(features, coefficients)
        if now - before < ENOUGH * n:
            break
        before = now
        coefficients = _moved(sums, d)
    return now, coefficients


def _directions(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and main directions of vectors with a covariance."""
    scale = np.sqrt(np.diag(cov))
    scale = np.where(scale > 1e-9, scale, 1)
    _, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    return scale, axes[:, ::-1][:, : min(DIRECTIONS, len(cov))]


def _tried(size: int, d: int) -> list[int]:
    """Numbers of components for which there are vectors enough."""
    return [k for k in COMPONENTS if k == 1 or k * 4 * d <= size]


def fit_mixture(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The mixture of a cell, with the standardisation and the directions it is fitted in."""
    unit = unit_rows(vectors)
    mean = unit.mean(0)
    centred = unit - mean
    scale, axes = _directions(centred.T @ centred / len(unit))
    x = centred / scale @ axes
    features = _features(x)
    found = {k: mixture(x, k, features) for k in _tried(*x.shape)}
    best = min(found, key=lambda k: (_criterion(found[k][0], *(len(x), k, x.shape[1])), k))
    return {"mean": mean, "scale": scale, "axes": axes, "coefficients": found[best][1]}


def project(m: dict[str, np.ndarray], vectors: np.ndarray) -> np.ndarray:
    return (unit_rows(vectors) - m["mean"]) / m["scale"] @ m["axes"]


def density(m: dict[str, np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the density of each vector under a mixture, and its most responsible component."""
    logs = _features(project(m, vectors)) @ m["coefficients"]
    return _log_sum(logs), logs.argmax(1)


# Cells of several blocks: partial sums of blocks, states of cells.
STATE = "cell string, state binary"


def _state(cell: str, **arrays: np.ndarray) -> pa.Table:
    return pa.table({"cell": pa.array([cell]), "state": pa.array([pack(**arrays)], pa.binary())})


def _states(table: pa.Table) -> list[dict[str, np.ndarray]]:
    return [unpack(x) for x in table.column("state").to_pylist()]


def block_moments(vectors: np.ndarray) -> dict[str, np.ndarray]:
    unit = unit_rows(vectors)
    centred = unit - unit.mean(0)
    return {"n": np.array(len(unit)), "mean": unit.mean(0), "second": centred.T @ centred}


def joint_moments(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Mean, scale and main directions of a cell from the moments of its blocks."""
    n = sum(int(p["n"]) for p in parts)
    mean = sum(p["n"] * p["mean"] for p in parts) / n
    second = sum(p["second"] + p["n"] * np.outer(p["mean"] - mean, p["mean"] - mean) for p in parts)
    scale, axes = _directions(second / n)
    return {"n": np.array(n), "mean": mean, "scale": scale, "axes": axes}


def started(m: dict[str, np.ndarray], vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Mixtures of a draw of a cell, one for each number of components, for the passes to start from."""
    x = project(m, vectors)
    features = _features(x)
    for k in _tried(int(m["n"]), x.shape[1]):
        m[f"c{k}"] = mixture(x, k, features)[1]
    return m | {"best": np.array(0), "now": np.array(-np.inf)}


def _open(m: dict[str, np.ndarray]) -> list[int]:
    return [int(m["best"])] if m["best"] else _tried(int(m["n"]), m["axes"].shape[1])


def block_sums(m: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Log-likelihood and sums of features of a block under the mixtures that are still open."""
    features, sums = _features(x), {}
    for k in _open(m):
        sums[f"now{k}"], sums[f"sums{k}"] = _responsibilities(features, m[f"c{k}"])
    return sums


def step(m: dict[str, np.ndarray], parts: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], bool]:
    """The state of a cell after a pass over all its blocks, and whether another is wanted.  The
    first pass gives the criterion of each number of components; the best one's mixture is then
    moved until it gains no more."""
    n, d = int(m["n"]), m["axes"].shape[1]
    now = {k: sum(float(p[f"now{k}"]) for p in parts) for k in _open(m)}
    best = min(now, key=lambda k: (_criterion(now[k], n, k, d), k))
    if now[best] - m["now"] < ENOUGH * n:
        return m | {"now": np.array(now[best])}, False
    moved = _moved(sum(p[f"sums{best}"] for p in parts), d)
    return {x: m[x] for x in ("n", "mean", "scale", "axes")} | {"best": np.array(best), "now": np.array(now[best]), f"c{best}": moved}, True


DENSITY = "vec_id long, density double, component int"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batch(schema: list[tuple[str, pa.DataType]], *columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


_STATE = [("cell", pa.string()), ("state", pa.binary())]
_DENSITY = [("vec_id", pa.int64()), ("density", pa.float64()), ("component", pa.int32())]


def large_densities(blocks: DataFrame) -> DataFrame:
    """densities() of the vectors of cells of several blocks.  States are joined to blocks,
    by broadcast while the planner finds them small, and what a block sends is of fixed size."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ids, vecs in _rows(batches):
            yield _batch(_STATE, [cell], [pack(**block_moments(read_block(ids, vecs)[1]))])

    def frame(table: pa.Table) -> pa.Table:
        return _state(table.column("cell")[0].as_py(), **joint_moments(_states(table)))

    plain = blocks.select("cell", "ids", "vecs")
    frames = materialize(plain.mapInArrow(moments, STATE).groupBy("cell").applyInArrow(frame, STATE))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ids, vecs, state in _rows(batches):
            x = project(unpack(state), read_block(ids, vecs)[1])
            yield _batch([("cell", pa.string()), ("x", pa.binary())], [cell], [x.tobytes()])

    points = materialize(plain.join(frames, "cell").select("cell", "ids", "vecs", "state").mapInArrow(reduce, "cell string, x binary"))

    def start(table: pa.Table) -> pa.Table:
        return _state(table.column("cell")[0].as_py(), **started(_states(table.slice(0, 1))[0], joined_blocks(table)[1]))

    draw = drawn(blocks, SAMPLE, 0).join(frames, "cell")
    states = materialize(draw.groupBy("cell").applyInArrow(start, STATE).withColumn("going", F.lit(True)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, x, state in _rows(batches):
            m = unpack(state)
            yield _batch(_STATE, [cell], [pack(**block_sums(m, np.frombuffer(x).reshape(-1, m["axes"].shape[1])))])

    def advance(parts: pa.Table, state: pa.Table) -> pa.Table:
        moved, going = step(_states(state)[0], _states(parts))
        out = _state(state.column("cell")[0].as_py(), **moved)
        return out.append_column("going", pa.array([going]))

    done = []
    for _ in range(PASSES):
        parts = points.join(states.select("cell", "state"), "cell").select("cell", "x", "state").mapInArrow(sums, STATE)
        states = materialize(parts.groupBy("cell").cogroup(states.select("cell", "state").groupBy("cell")).applyInArrow(advance, STATE + ", going boolean"))
        done.append(states.where("not going").select("cell", "state"))
        states = states.where("going")
        if states.isEmpty():
            break
    final = states.select("cell", "state")
    for part in done:
        final = final.unionByName(part)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vecs, state in _rows(batches):
            m = unpack(state)
            numbers, vectors = read_block(ids, vecs)
            yield _batch(_DENSITY, numbers, *density(m | {"coefficients": m[f"c{int(m['best'])}"]}, vectors))

    return plain.join(final, "cell").select("ids", "vecs", "state").mapInArrow(densities, DENSITY)


COUNTS = "vec_id long, similar long, root long, mark long"
_COUNTS = [("vec_id", pa.int64()), ("similar", pa.int64()), ("root", pa.int64()), ("mark", pa.int64())]


class _Counts:
    """For each vector of a block, in order of the numbers, how many similar ones were met, the least
    number of them and itself, and the mark of their set."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.similar, self.root, self.mark = ids, np.zeros(len(ids), np.int64), ids.copy(), np.zeros(len(ids), np.uint64)

    def dense(self, rows: np.ndarray, alike: np.ndarray, other: np.ndarray, marks: np.ndarray) -> None:
        """``alike``: whether each of ``rows`` is similar to each of ``other``."""
        number = alike.sum(1)
        some = number > 0
        self.similar[rows] += number
        self.root[rows[some]] = np.minimum(self.root[rows[some]], other[alike[some].argmax(1)])
        self.mark[rows] ^= np.bitwise_xor.reduce(np.where(alike, marks, np.uint64(0)), axis=1)

    def sparse(self, row: np.ndarray, other: np.ndarray, marks: np.ndarray) -> None:
        """``row``, in order, is similar to ``other``."""
        if not len(row):
            return
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rows = row[head]
        self.similar[rows] += np.diff(np.append(head, len(row)))
        self.root[rows] = np.minimum(self.root[rows], np.minimum.reduceat(other, head))
        self.mark[rows] ^= np.bitwise_xor.reduceat(marks, head)

    def found(self) -> tuple[np.ndarray, ...]:
        some = self.similar > 0
        return self.ids[some], self.similar[some], self.root[some], self.mark[some].view(np.int64)


#: Scores that are held at once, and the share of similar pairs among them from which on pairs are not listed.
SCORES, DENSE = 1 << 22, 0.02


def count_pairs(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """vec_id, similar, root and mark of the vectors of a block (ids in order, and vectors) that have
    similar ones in it, or in another block: how many they are, the least vec_id of them and
    itself, and a mark that tells sets of them apart (the parity of well-mixed 64 bits of each).
    What is held at once is bounded, even if all are similar."""
    ids, unit = one[0], unit_rows(one[1])
    other, base = (ids, unit) if two is None else (two[0], unit_rows(two[1]))
    if not len(ids) or not len(other):
        return [np.zeros(0, np.int64)] * 4
    quick, quick_base = unit.astype(np.float32), base.astype(np.float32).T
    marks, other_marks = mixed(ids), mixed(other)
    mine = _Counts(ids)
    theirs = _Counts(other) if two is not None else None
    step = max(1, SCORES // len(other))
    for low in range(0, len(ids), step):
        score = quick[low : low + step] @ quick_base
        rows = np.arange(low, low + len(score))
        # Single precision decides what is far from the border, double precision the rest.
        alike = score >= np.float32(SIMILAR + 1e-4)
        close = np.flatnonzero((score >= np.float32(SIMILAR - 1e-4)) & ~alike)
        for k in range(0, len(close), 1 << 16):
            part = close[k : k + (1 << 16)]
            row, column = np.divmod(part, len(other))
            alike.ravel()[part] = np.einsum("ij,ij->i", unit[low + row], base[column]) >= SIMILAR
        if theirs is None:
            alike[np.arange(len(rows)), rows] = False
        if np.count_nonzero(alike) > DENSE * alike.size:
            mine.dense(rows, alike, other, other_marks)
            if theirs is not None:
                theirs.dense(np.arange(len(other)), alike.T, ids[rows], marks[rows])
            continue
        row, column = np.divmod(np.flatnonzero(alike), len(other))
        mine.sparse(row + low, other[column], other_marks[column])
        if theirs is not None:
            order = np.argsort(column, kind="stable")
            theirs.sparse(column[order], ids[low + row[order]], marks[low + row[order]])
    return [np.concatenate(x) for x in zip(*(c.found() for c in (mine, theirs) if c is not None))]


def similar_counts(blocks: DataFrame) -> DataFrame:
    """vec_id, similar, root, mark of every vector that has similar ones in its cell.  Exact: each
    block of a cell is compared with each, a pair of blocks a task.  ``blocks``: PACKED."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vecs in _rows(batches):
            yield _batch(_COUNTS, *count_pairs(read_block(ids, vecs)))

    counted = blocks.select("ids", "vecs").mapInArrow(alone, COUNTS)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("other")
    # Numbers of blocks, without gaps where a share of the hash was empty, are not needed: an
    # absent partner leaves a task with one block.
    several = blocks.where("blocks > 1")
    shares = materialize(several.groupBy("cell").agg((F.max("salt") + 1).alias("shares")))
    spread = several.join(shares, "cell").select("cell", "salt", "ids", "vecs", other).where("other <> salt")
    tasks = spread.select("cell", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), "salt", "ids", "vecs")

    def pair(table: pa.Table) -> pa.Table:
        if len(table) < 2:
            return pa.table([pa.array([], t) for _, t in _COUNTS], [n for n, _ in _COUNTS])
        one, two = (read_block(table.column("ids")[k].as_py(), table.column("vecs")[k].as_py()) for k in (0, 1))
        return pa.Table.from_batches([_batch(_COUNTS, *count_pairs(one, two))])

    across = tasks.groupBy("cell", "low", "high").applyInArrow(pair, COUNTS)
    return (
        counted.unionByName(across)
        .groupBy("vec_id")
        .agg(F.sum("similar").alias("similar"), F.min("root").alias("root"), F.bit_xor("mark").alias("mark"))
    )


def similar_groups(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id and root (least vec_id of the group) of the vectors of groups of two or more; and
    vec_id of all vectors that have similar ones.  ``blocks``: PACKED.

    The vectors of one root are a group if each has as many similar ones as there are others, and
    all have the same set of them, themselves included."""

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mark = (np.asarray(batch.column(k)) for k in (0, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((mark.view(np.uint64) ^ mixed(ids)).view(np.int64))], [n for n, _ in _COUNTS])

    near = materialize(similar_counts(blocks).mapInArrow(closed, COUNTS))
    sizes = near.groupBy("root").agg(
        F.count("*").alias("n"), F.min("similar").alias("least"), F.max("similar").alias("most"), F.min("mark").alias("a"), F.max("mark").alias("b")
    )
    whole = near.join(sizes.where("least = n - 1 and most = n - 1 and a = b").select("root"), "root", "left_semi")
    return whole.select("vec_id", "root"), near.select("vec_id")


@dataclass(frozen=True)
class Groups:
    """``members``: head_id (least row_id of the group), row_id, density, component; ``groups``:
    head_id, size, typical (row_ids of highest density), components (how many its rows are in)."""

    members: DataFrame
    groups: DataFrame


def densities(blocks: DataFrame) -> DataFrame:
    """vec_id, density (logarithm) and component of every vector under the mixture of its cell, fitted
    to all its vectors.  ``blocks``: PACKED."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vecs in _rows(batches):
            numbers, vectors = read_block(ids, vecs)
            yield _batch(_DENSITY, numbers, *density(fit_mixture(vectors), vectors))

    found = blocks.where("blocks = 1").select("ids", "vecs").mapInArrow(fit, DENSITY)
    large = blocks.where("blocks > 1")
    return found if large.isEmpty() else found.unionByName(large_densities(large))


def similarity_groups(vectors: DataFrame, column: str = "embedding", block: int = BLOCK) -> Groups:
    """Groups of two or more rows of a model that are all similar to each other (cosine of
    SIMILAR at least) and to no other row of the model.

    ``vectors``: row_id (key), model_id, a column of FLOAT arrays; other columns are ignored.
    Null and zero vectors and those with nulls or infinite components belong to no group,
    repeated rows count each; vectors of different lengths are not compared; a null model_id
    is a model.  Of equal density the smaller row_id is the more typical.  An empty table has
    no groups.  No task has more than two blocks of about ``block`` vectors.
    """
    found = distinct_vectors(usable(vectors, column), block)
    whole, near = similar_groups(found.blocks)
    alone = found.copies.select("vec_id").distinct().join(near, "vec_id", "left_anti")
    rooted = whole.unionByName(alone.select("vec_id", F.col("vec_id").alias("root")))
    members = materialize(
        rooted.join(densities(found.blocks), "vec_id")
        .join(found.copies, "vec_id", "left")
        .select(F.col("root").alias("head_id"), F.coalesce("row_id", "vec_id").alias("row_id"), "density", "component")
    )
    order = Window.partitionBy("head_id").orderBy(F.desc("density"), "row_id")
    typical = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TYPICAL)
    listed = typical.groupBy("head_id").agg(F.array_sort(F.collect_list(F.struct("place", "row_id"))).alias("t"))
    sizes = members.groupBy("head_id").agg(F.count("*").alias("size"), F.count_distinct("component").alias("components"))
    groups = sizes.join(listed, "head_id").select("head_id", "size", F.col("t.row_id").alias("typical"), "components")
    return Groups(members, groups)


def all_vectors(word_vectors: DataFrame, pq_codes: DataFrame, pq_books: DataFrame, models: DataFrame) -> DataFrame:
    """row_id, model_id, embedding of the dense rows and of the quantized ones, decoded."""
    quantizers = models.select(F.col("model_id").alias("of_model"), "quantizer_id").dropDuplicates(["of_model"])
    coded = pq_codes.select("row_id", "model_id", "codes", "norm").join(quantizers, F.col("model_id") == F.col("of_model"), "left")
    decoded = decode_rows(coded, pq_books).select("row_id", "model_id", "embedding")
    return word_vectors.select("row_id", "model_id", "embedding").unionByName(decoded)
