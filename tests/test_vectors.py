"""The vector index against all products."""

import math

import numpy as np

from loomstone.operators import vectors as V

SCHEMA = "vec_id long, embedding array<double>, query long"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist() if isinstance(v, np.ndarray) else v, 1) for i, v in zip(ids, x)], SCHEMA)


def clustered(n, width, seed, spread=0.15):
    rnd = np.random.default_rng(seed)
    return rnd.normal(size=(12, width))[rnd.integers(0, 12, n)] + spread * rnd.normal(size=(n, width))


def best(ids, x, qid, q, k, own, above):
    sims = np.round(np.clip(V.unit(x) @ V.unit(q), -1, 1), 6)
    rows = sorted((-s, i) for s, i in zip(sims, ids) if s > above and not (own and i == qid))
    return [(i, -s) for s, i in rows[:k]]


def check(spark, index, ids, x, qids, q, k, own=False, above=-1.0):
    found, report = index.nearest_with_report(frame(spark, qids, q), k, own=own, above=above)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r.rank)):
        got.setdefault(r.query, []).append((r.vec_id, r.sim))
    for i, v in zip(qids, q):
        want = best(ids, x, i, v, k, own, above)
        have = got.get(int(i), [])
        assert len(have) == len(want)
        assert all(abs(a[1] - b[1]) <= 1.01e-6 for a, b in zip(have, want))
        assert [a[0] for a in have] == [b[0] for b in want]
    return report.collect()


def test_exact_and_pruned(spark):
    x = clustered(3000, 16, 1)
    x[100:400] = x[100]  # copies: ties by id
    ids = np.random.default_rng(2).permutation(3000)
    share = []
    for lists in (2, 60):
        index = V.VectorIndex.build(frame(spark, ids[:2500], x[:2500]), lists=lists, least=16)
        index.append(frame(spark, ids[2500:], x[2500:]))
        report = check(spark, index, ids, x, ids[::60], x[::60], 8, own=True)
        share.append(sum(r.scored for r in report) / (50 * 3000))
        assert sum(r.shortlist for r in report) < 0.2 * 50 * 3000
    assert share[1] < 0.5 * share[0] and share[1] < 0.4  # more lists, fewer vectors scored


def test_one_vector(spark):
    x = clustered(2000, 16, 6)
    x[100:150] = x[100]
    ids = np.random.default_rng(2).permutation(2000)
    index = V.VectorIndex.build(frame(spark, ids, x), lists=50, least=16)
    for i, k, above in ((100, 8, -1.0), (7, 30, 0.6), (3, 5000, -1.0), (9, 3, 0.99999)):
        got = [(r.vec_id, r.sim) for r in index.nearest_of(x[i].tolist(), k, above).collect()]
        want = best(ids, x, -1, x[i], k, False, above)
        assert [a for a, _ in got] == [a for a, _ in want] and all(abs(a[1] - b[1]) <= 1.01e-6 for a, b in zip(got, want))
    assert index.nearest_of([0.0] * 16, 3).count() == 3 and index.nearest_of([1.0], 3).count() == 0


def test_parts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 50)
    monkeypatch.setattr(V, "CHUNK", 7)
    x = clustered(400, 8, 3)
    ids = np.arange(400)
    index = V.VectorIndex.build(frame(spark, ids, x), lists=4, least=16)
    check(spark, index, ids, x, ids[:40], x[:40], 5, above=0.5)


def test_edges(spark):
    x = clustered(60, 4, 4)
    ids = np.arange(60)
    odd = [(None, [1.0, 2.0, 3.0, 4.0], 1), (900, None, 1), (901, [1.0, 2.0], 1), (902, [math.nan, 1.0, 1.0, 1.0], 1), (903, [None, 1.0, 1.0, 1.0], 1)]
    rows = frame(spark, ids, x).union(spark.createDataFrame(odd, SCHEMA)).union(frame(spark, [60], np.zeros((1, 4))))
    index = V.VectorIndex.build(rows)
    ids, x = np.arange(61), np.vstack([x, np.zeros((1, 4))])
    check(spark, index, ids, x, [5, 70], np.vstack([x[5], np.zeros(4)]), 100)
    assert index.nearest(frame(spark, [1], [[1.0, 2.0]]), 3).count() == 0
    assert index.nearest(frame(spark, [1], x[:1]).limit(0), 3).count() == 0
    assert V.VectorIndex.build(rows.limit(0)).nearest(frame(spark, [1], [[1.0]]), 3).count() == 0


def test_code_bounds_hold():
    """The product with the codes is off by no more than what they leave out."""
    rnd = np.random.default_rng(5)
    x, q = V.unit(rnd.normal(size=(500, 24)) ** 3), V.unit(rnd.normal(size=(20, 24)))
    step = np.abs(x).max(1) / 127
    codes = np.rint(x / step[:, None])
    err = np.linalg.norm(x - codes * step[:, None], axis=1) + 1e-9
    assert (np.abs(q @ x.T - (q @ codes.T) * step) <= err).all()
