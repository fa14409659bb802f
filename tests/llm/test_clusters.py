import numpy as np

from wordloom.llm import clusters
from wordloom.llm.clusters import all_vectors, density, fit_mixture, similarity_groups

SCHEMA = "row_id long, model_id long, embedding array<float>, density string, root int"


def frame(spark, rows):
    data = [(i, m, None if v is None else [None if x is None else float(x) for x in v], "clash", 0) for i, m, v in rows]
    return spark.createDataFrame(data, SCHEMA)


def brute(rows):
    models, out = {}, {}
    for i, m, v in rows:
        if v is not None and None not in list(v) and np.isfinite(v).all() and np.any(v):
            models.setdefault(m, []).append((i, np.float32(v).astype(float)))
    for found in models.values():
        ids = [i for i, _ in found]
        unit = np.array([v / np.linalg.norm(v) for _, v in found])
        near = unit @ unit.T >= 0.7
        np.fill_diagonal(near, True)
        for k in range(len(ids)):
            c = np.flatnonzero(near[k])
            if len(c) > 1 and near[np.ix_(c, c)].all() and (near[c].sum(1) == len(c)).all():
                out[min(ids[j] for j in c)] = {ids[j] for j in c}
    return out


def made(rng, n, d):
    centres = rng.normal(size=(n // 8, d))
    return [centres[k % len(centres)] + rng.normal(size=d) * (0.25 if k % 5 else 2) for k in range(n)]


def run(spark, rows, **parameters):
    got = similarity_groups(frame(spark, rows), **parameters)
    members = {}
    for r in got.members.collect():
        members.setdefault(r.head_id, set()).add(r.row_id)
    return members, {r.head_id: r for r in got.groups.collect()}


def test_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1 + i % 3, v) for i, v in enumerate(made(rng, 300, 24))]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(4)] + [(1100 + i, 4, rng.normal(size=24)) for i in range(1)] * 1
    rows += [(1200, 5, np.ones(6)), (1201, 5, np.ones(6)), (1202, 5, -np.ones(6))]
    rows += [(1300, 1, None), (1301, 1, np.zeros(24)), (1302, 1, [1.0, None]), (1303, 1, [])]
    chain = [(1400 + k, 6, [np.cos(k * 0.6), np.sin(k * 0.6)]) for k in range(4)]
    members, groups = run(spark, rows + chain)
    assert members == brute(rows)
    assert all(groups[h].size == len(m) and set(groups[h].typical) <= m for h, m in members.items())
    assert run(spark, []) == ({}, {})


def test_models_of_several_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 1 + (i > 880), v) for i, v in enumerate(made(rng, 900, 24))]
    # A pair and a row that is similar to one of the two only.
    rows += [(1000, 3, [1, 0]), (1001, 3, [np.cos(0.6), np.sin(0.6)]), (1002, 3, [np.cos(1.2), np.sin(1.2)])]
    want = brute(rows)
    assert len(want) > 30 and run(spark, rows, block=120)[0] == want
    few = rows[-23:]
    assert run(spark, few, block=1)[0] == brute(few)


def test_nearly_equal_vectors(spark):
    # One group in several blocks, and a row that would spoil it.
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(i, 1, centre + 0.01 * rng.normal(size=16)) for i in range(600)]
    members, groups = run(spark, rows, block=100)
    assert members == {0: set(range(600))} and groups[0].size == 600
    spoiled = [*rows, (5000, 1, centre + 1.0202 * np.linalg.norm(centre) * np.linalg.qr(np.c_[centre, rng.normal(size=16)])[0][:, 1])]
    assert len(brute(spoiled)) == 0 and run(spark, spoiled, block=100)[0] == {}


def test_density_is_of_all_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 24)) * np.linspace(1, 2, 24)
    rows = [(i, 1, v) for i, v in enumerate(np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)]))]

    def density(**parameters):
        return {r.row_id: r.density for r in similarity_groups(frame(spark, rows), **parameters).members.collect()}

    want = density()
    monkeypatch.setattr(clusters, "SAMPLE", 150)
    got = density(block=150)
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_criterion_chooses_components():
    rng = np.random.default_rng(4)

    def parts(x):
        values, part = density(fit_mixture(x.astype(np.float32)), x.astype(np.float32))
        assert np.isfinite(values).all()
        return part

    far = np.concatenate([rng.normal(size=(300, 8)) + 12 * c for c in np.eye(8)[:4]])
    found = parts(far)
    assert len(set(found)) >= 4
    assert all(len(set(found[300 * a : 300 * a + 300]) & set(found[300 * b : 300 * b + 300])) == 0 for a in range(4) for b in range(a))
    assert len(set(parts(rng.normal(size=(600, 8)) + 3))) == 1


def test_codes(spark):
    books = spark.createDataFrame([(1, s, c, [float(s), float(c)]) for s in range(2) for c in range(3)], "quantizer_id int, sub int, centroid int, vec array<float>")
    models = spark.createDataFrame([(7, 1), (8, None)], "model_id long, quantizer_id int")
    codes = [(1, 7, [2, 1], 2.0), (2, 7, [0, 0], None), (3, 7, [0], 1.0), (4, 7, [0, 3], 1.0), (5, 7, None, 1.0), (6, 8, [0, 0], 1.0), (7, 7, [0, -1], 1.0), (8, 7, [0, None], 1.0)]
    coded = spark.createDataFrame(codes, "row_id long, model_id long, codes array<smallint>, norm float")
    dense = spark.createDataFrame([(9, 7, [1.0])], "row_id long, model_id long, embedding array<float>")
    got = {r.row_id: r.embedding for r in all_vectors(dense, coded, books, models).collect()}
    assert got == {1: [0, 4, 2, 2], 2: [0, 0, 1, 0], **dict.fromkeys(range(3, 9)), 9: [1.0]}


def test_dense_and_sparse_counts(monkeypatch):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(6, 10))
    x = (centres[np.arange(400) % 6] + 0.5 * rng.normal(size=(400, 10))).astype(np.float32)
    one, two = (np.arange(0, 400, 2), x[::2]), (np.arange(1, 400, 2), x[1::2])
    for pair in ((one,), (one, two)):
        got = []
        for share in (0, 2):
            monkeypatch.setattr(clusters, "DENSE", share)
            monkeypatch.setattr(clusters, "SCORES", 3000)
            got.append([c.tolist() for c in clusters.count_pairs(*pair)])
        assert got[0] == got[1] and len(got[0][0]) > 100
