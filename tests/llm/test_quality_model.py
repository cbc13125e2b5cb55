import math

import numpy as np
from pyspark.sql import functions as F

from loomstone.llm import quality_model as M

SCHEMA = "doc_id long, text string, score string"


def test_em_recovers_labellers():
    rng = np.random.default_rng(0)
    y = rng.random(40000) < 0.7
    acc = np.linspace(0.6, 0.95, len(M.LABELLERS))
    right = rng.random((len(y), len(acc))) < acc
    votes = np.where(rng.random(right.shape) < 0.2, 0, np.where(right == y[:, None], 1, -1))
    keys, n = np.unique(M.pattern(votes), return_counts=True)
    prior, prob, post = M.fit_labellers(dict(zip(keys.tolist(), n.tolist())))
    assert abs(prior - 0.7) < 0.02
    assert np.abs(prob[1, :, 2] / 0.8 - acc).max() < 0.03 and np.abs(prob[0, :, 0] / 0.8 - acc).max() < 0.03
    assert (np.array([post[k] > 0.5 for k in M.pattern(votes).tolist()]) == y).mean() > 0.93


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in M.op4_quality_model(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}  # not used to train
    good = [got[d].kept for d, q in labels.items() if q == 1]
    bad = [got[d].kept for d, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "Some words that are of no use.", None), (1, "Some words that are of no use.", None), (None, None, "x"), (2, "", None), (3, "w " * 50000, None)]
    out = M.classify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert M.classify(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_em(counts, rounds=200):
    """The same model in plain loops: one document pattern, one labeller, one vote at a time."""
    n = len(M.LABELLERS)
    votes = {k: [k // 3**i % 3 for i in range(n)] for k in counts}
    good = {k: 0.9 if sum(v - 1 for v in votes[k]) >= n // 2 else 0.2 for k in counts}
    for _ in range(rounds):
        total = sum(counts.values())
        prior = min(max(sum(counts[k] * good[k] for k in counts) / total, 1e-3), 1 - 1e-3)
        prob = {}
        for c in (0, 1):
            for i in range(n):
                seen = [0.5, 0.5, 0.5]
                for k in counts:
                    seen[votes[k][i]] += counts[k] * (good[k] if c else 1 - good[k])
                prob[c, i] = [x / sum(seen) for x in seen]
        new = {}
        for k in counts:
            odds = math.log(1 - prior) - math.log(prior) + sum(math.log(prob[0, i][v]) - math.log(prob[1, i][v]) for i, v in enumerate(votes[k]))
            new[k] = 1 / (1 + math.exp(max(-50.0, min(50.0, odds))))
        step = max(abs(new[k] - good[k]) for k in counts)
        if step < 1e-6:
            break
        good = new
    return good


def test_posteriors_and_scores_equal_plain_loops(spark, sf):
    """EM by loops over patterns; the scorer's weights refitted from all rows in another order of arrival; scores by a dict of features."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    votes = {d: int(M.pattern(M.look([(t or "").encode()])[0])[0]) for d, t in texts.items()}
    counts = {}
    for p in votes.values():
        counts[p] = counts.get(p, 0) + 1
    post = plain_em(counts)
    got = {r.doc_id: r for r in M.classify(docs).collect()}
    assert all(abs(got[d].posterior - post[votes[d]]) < 1e-4 for d in texts)

    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}
    fitted = M.fit_labellers(counts)[2]
    rows = []
    for d in sorted(texts, key=keys.get):
        _, features, owner = M.look([(texts[d] or "").encode()])
        rows.append((M._vectors(features, owner, 1)[0], fitted[votes[d]]))
    weights, bias = M.fit_scorer(rows)
    for d, (vector, _) in zip(sorted(texts, key=keys.get), rows):
        z = bias + sum(float(weights[i]) * float(x) for i, x in np.frombuffer(vector, [("i", "<i4"), ("x", "<f4")]))
        assert abs(got[d].score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-4


def test_scores_do_not_depend_on_order_or_partitions_or_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    first = {r.doc_id: r.score for r in M.classify(docs.coalesce(1), train_rows=60).collect()}
    other = {r.doc_id: r.score for r in M.classify(docs.orderBy(F.desc("doc_id")).repartition(7), train_rows=60).collect()}
    assert first == other
