import numpy as np
import pytest

from wordloom.llm import neighbours, vectors
from wordloom.llm.neighbours import balanced_parts, nearest_pairs, nearest_rows

SCHEMA = "row_id long, model_id long, embedding array<float>, vec string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, m, None if v is None else [float(x) if x is not None else None for x in v], "clash", 0) for i, m, v in rows], SCHEMA)


def brute(rows, k=5):
    models = {}
    for i, m, v in rows:
        if v is not None and None not in list(v) and np.isfinite(v).all() and np.any(v):
            models.setdefault(m, []).append((i, np.float32(v).astype(float)))
    out = {}
    for found in models.values():
        for i, v in found:
            near = sorted((-round(v @ w / np.linalg.norm(v) / np.linalg.norm(w), 6), j) for j, w in found if j != i)
            out[i] = [j for _, j in near[:k]]
    return out


def test_exact_in_small_models(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1 + i % 2, rng.normal(size=4)) for i in range(120)]
    rows += [(200 + i, 1, rows[0][2]) for i in range(9)] + [(300 + i, 2, rows[1][2] * 2) for i in range(3)]
    rows += [(400, 1, None), (401, 1, np.zeros(4)), (402, 1, [1.0, None, 0, 0]), (403, 1, [np.inf, 0, 0, 0]), (404, 1, [])]
    rows += [(500 + i, 7, rng.normal(size=4)) for i in range(3)] + [(600, 8, rng.normal(size=4))]
    got = {}
    for r in nearest_rows(frame(spark, rows)).orderBy("row_id", "place").collect():
        got.setdefault(r.row_id, []).append(r.other_id)
    want = {i: n for i, n in brute(rows).items() if n}
    assert got == want
    pairs = {tuple(r) for r in nearest_pairs(frame(spark, rows)).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i, n in want.items() for j in n}
    assert nearest_pairs(frame(spark, [])).count() == 0


def test_recall_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 700)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    rows = [(i, 1, centres[i % 60] + 0.2 * rng.normal(size=16) if i % 3 else rng.normal(size=16)) for i in range(1500)]
    want = brute(rows)
    got = {}
    for r in nearest_rows(frame(spark, rows), target=200).collect():
        got.setdefault(r.row_id, set()).add(r.other_id)
    assert all(len(v) == 5 for v in got.values())
    recall = sum(len(got[i] & set(n)) for i, n in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9


def test_what_cannot_be_divided(spark, monkeypatch):
    # Nearly equal vectors in many blocks: exact, whatever the routers make of them.
    rng = np.random.default_rng(9)
    centre = rng.normal(size=8)
    rows = [(i, 1, centre + 1e-3 * rng.normal(size=8)) for i in range(700)] + [(i, 1, centre * (1 + i)) for i in range(700, 720)]
    monkeypatch.setattr(neighbours, "fit_router", lambda vectors, size, target: b"")
    got = {}
    for r in nearest_rows(frame(spark, rows), target=50, block=60).orderBy("row_id", "place").collect():
        got.setdefault(r.row_id, []).append(r.other_id)
    assert got == brute(rows)


def test_divided_again(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PARTS", 3)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 12))
    rows = [(i, 1, centres[i % 40] + 0.1 * rng.normal(size=12)) for i in range(2000)]
    want = brute(rows)
    got = {}
    for r in nearest_rows(frame(spark, rows), target=150).collect():
        got.setdefault(r.row_id, set()).add(r.other_id)
    assert sum(len(got[i] & set(n)) for i, n in want.items()) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("parts", [2, 5, 16])
def test_parts_are_balanced(parts):
    unit = vectors.unit_rows(np.random.default_rng(2).normal(size=(800, 8))).astype(np.float32)
    size = np.bincount(balanced_parts(unit, neighbours._knn(unit, 10), parts), minlength=parts)
    assert size.max() <= 1.15 * 800 / parts + 1 and size.min() > 0


@pytest.mark.parametrize("spread", [0, 1e-8, 1e-4, 1e-2, 1])
def test_search(spread):
    rng = np.random.default_rng(12)
    held = np.arange(0, 600, 2), (rng.normal(size=6) + spread * rng.normal(size=(300, 6))).astype(np.float32)
    some = rng.permutation(300)[:80]
    found = neighbours.search((held[0][some], held[1][some]), held, 5)
    got = {}
    for i, j, c in zip(*(x.tolist() for x in found)):
        got.setdefault(i, []).append((-c, j))
    unit = vectors.unit_rows(held[1])
    for k in some:
        cosine = np.rint(unit @ unit[k] * 1e6).astype(int)
        want = sorted((-c, j) for c, j in zip(cosine.tolist(), held[0].tolist()) if j != held[0][k])[:5]
        assert got[held[0][k]] == want
