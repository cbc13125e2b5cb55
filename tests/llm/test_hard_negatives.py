import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row string, block int"


def test_table(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(H.ORACLE)
    df = H.op12_hard_negatives(spark, sf)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def expected(rows, every=50):
    clean = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        clean.append((vec_id, [math.floor(256 * Fraction(c)) for c in x], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    out = Counter()
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, (anchor, q, label) in enumerate(clean):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), vec_id is None, vec_id or 0, vec_id, own) for j, (vec_id, v, own) in enumerate(clean) if i != j and len(v) == len(q)), key=lambda x: x[:3])
        for s, _, _, positive, _ in [x for x in scored if x[4] == label][:5]:
            p = -s
            fit = [x for x in scored if x[4] != label and 50 * p <= -100 * x[0] <= 95 * p][:3]
            for rank, x in enumerate(fit, 1):
                out[anchor, positive, rank, x[3], clip(p), clip(-x[0])] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def mined(spark, rows, **sizes):
    return Counter(tuple(r) for r in H.mine(frame(spark, rows), **sizes).collect())


def clusters(n, width, seed, copies=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, width))
    x = centres[rnd.integers(0, 6, n)] + 0.3 * rnd.normal(size=(n, width))
    x[:copies] = x[0]
    return [(int(i), v.tolist(), int(k)) for i, v, k in zip(rnd.permutation(n), x, rnd.integers(0, 3, n))]


def test_small_blocks_with_copies_and_ties(spark):
    rows = clusters(700, 6, 1, copies=230)
    rows += [(i, v, k) for i, v, k in rows[:20]]  # repeated rows
    assert mined(spark, rows, every=10, references=5, block=40, group=7) == expected(rows, 10)


def test_edges(spark):
    rows = clusters(120, 3, 2)
    rows += [(None, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 2), (50, None, 1), (100, [1.0, None, 2.0], 1), (150, [1.0, math.nan, 2.0], 1), (200, [1.0, math.inf, 2.0], 0), (250, [1.0, 2.0, 3.0], None)]
    rows += [(300, [0.0, 0.0, 0.0], 1), (350, [], 1), (351, [], 1), (352, [], 2), (400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [0.6, 1.4], 2)]
    rows += [(450, [1e16, -1e12, 3.0], 1), (451, [1e-30, 1e16, -1e12], 1), (452, [9e15, 1.0, 1.0], 1), (453, [8e15, 2.0, 5.0], 2), (454, [1e300, 2.0, 5.0], 5), (500, [1e9, 1e9, 1e9], 3), (502, [1.1e9, 1e9, 1e9], 3), (503, [0.9e9, 0.9e9, 0.9e9], 4)]
    assert mined(spark, rows, references=4, block=16, group=5) == expected(rows)
    assert mined(spark, [(0, [1.0], 1)]) == Counter()
    assert H.mine(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(-3000, 3000), st.floats(0, 4000), st.integers(2, 5))
def test_stretches_exclude_no_row(seed, low, more, width):
    """Whatever lies in a range of scores lies in the anchor's stretch of angles."""
    rnd = np.random.default_rng(seed)
    v = np.floor(rnd.normal(size=(60, width)) * rnd.choice([3, 30]))
    a, ref = np.floor(rnd.normal(size=width) * 20), rnd.normal(size=width)
    ref /= np.linalg.norm(ref)
    norms, norm = np.linalg.norm(v, axis=1), np.linalg.norm(a)
    angle = lambda x, n: np.float32(math.acos(np.clip(x @ ref / n, -1, 1)) if n else math.pi / 2)
    theta, alpha = np.array([angle(x, n) for x, n in zip(v, norms)]), angle(a, norm)
    first, last = H.stretches(np.array([alpha], "f8"), np.array([norm]), np.array([low]), np.array([low + more]), norms.min(), norms.max())
    s = v @ a
    inside = (s >= low) & (s <= low + more)
    assert (~inside | ((theta >= first[0]) & (theta <= last[0]))).all()


def test_clustered_rows_are_mostly_not_scored(spark, monkeypatch):
    """The share of pairs that get a score, where directions tell clusters apart."""
    rnd = random.Random(4)
    centres = np.random.default_rng(4).normal(size=(8, 16))
    x = centres[[rnd.randrange(8) for _ in range(600)]] + 0.05 * np.random.default_rng(5).normal(size=(600, 16))
    rows = [(i, v.tolist(), rnd.randrange(2)) for i, v in enumerate(x)]
    refs = H.fit_references([r[1] for r in rows], 8)
    scored = []
    count = H.scores
    monkeypatch.setattr(H, "scores", lambda a, v: (scored.append(a.shape[0] * v.shape[0]), count(a, v))[1])
    import pyarrow as pa

    q = np.array([H.scale(r[1]) for r in rows])
    norms = np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip(q / norms[:, None] @ refs.T, -1, 1)).astype("f4")
    home = angles.argmin(1)
    asked = 0
    for h in range(8):
        own = np.flatnonzero(home == h)
        own = own[np.argsort(angles[own, h])]
        make = lambda at: pa.table({"row": at, "vec_id": at, "label": np.array([rows[i][2] for i in at], "i4"), "norm": norms[at], "q": pa.array(q[at].tolist()), "home": home[at], "angle": angles[at, h], "angles": pa.array(angles[at].tolist(), pa.list_(pa.float32()))})
        few = make(np.arange(0, 600, 50))
        best = [float(np.sort(q @ q[i])[-6]) for i in range(0, 600, 50)]
        few = few.append_column("least", pa.array(best))
        asked += 12 * len(own)
        list(H.found(few, make(own), 5, True))
    assert 0 < sum(scored) < 0.5 * asked
