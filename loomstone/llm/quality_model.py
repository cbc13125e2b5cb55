"""Quality classifier: weak labels, their posterior by expectation-maximisation, a hashed linear scorer.

1. Overlapping heuristic labellers vote good, bad or nothing on every document.  Only the counts of
   vote patterns (at most 3**8) leave Spark.
2. Expectation-maximisation fits, for either hidden class, how often each labeller gives each vote
   (its accuracy), from the patterns of all documents, and so a posterior for each pattern.
3. A logistic scorer over hashed words and word shapes is fitted to the posteriors of a bounded
   sample of about ``train_rows`` documents, those with the smallest hashes of their ids and texts.  Equal
   rows count once in it, and it is ordered by hash, so every run gives the same weights.
4. Every document gets the scorer's probability.  ``kept`` is true from ``threshold`` on.

Null text is empty: no words, so all labellers that need words abstain or vote bad.  Null and
repeated doc_ids are kept: one row out for one row in.  An empty table gives an empty result.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .html_text import STOP_WORDS
from .tokens import groups, mix, words

LABELLERS = ("length", "symbols", "capitals", "stop_words", "dup_lines", "word_length", "repeats", "sentences")
BITS = 16
TRAIN_ROWS = 6000
_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 small or beyond ASCII, 3 digit, 4 symbol
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[list(b"#*$%&|<>@^~=+{}[]\\/_!?")] = 4
_STOP = np.sort(words([" ".join(sorted(STOP_WORDS)).encode()])[0])


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def look(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts x labellers, of -1, 0, 1), feature numbers of every word and their texts."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], "i8")
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kinds = _CLASS[data]
    byte_owner = np.repeat(np.arange(n), sizes + 1)
    capitals, small, symbols = (_per_text(kinds == k, byte_owner, n) for k in (1, 2, 4))
    h, owner = words(texts, blank_separated=True)
    count = np.bincount(owner, minlength=n).astype("f8")
    per_word = np.maximum(count, 1)
    low, low_owner = words([t.lower() for t in texts])
    stop = _per_text(_STOP[np.minimum(np.searchsorted(_STOP, low), len(_STOP) - 1)] == low, low_owner, n) / np.maximum(np.bincount(low_owner, minlength=n), 1)

    again = np.zeros(n)
    if len(h) >= 8:
        w = sum((h[i : len(h) - 7 + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15) for i in range(8)), np.uint64(0))
        at = np.flatnonzero(owner[: len(w)] == owner[7:])
        o, w = owner[at], mix(w[at])
        order = np.lexsort((w, o))
        same = (w[order][1:] == w[order][:-1]) & (o[order][1:] == o[order][:-1])
        again = _per_text(same, o[order][1:], n) / per_word
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([max(1, len(x)) for x in lines])
    dup = np.array([len(x) - len(set(x)) for x in lines]) / n_lines
    ends = np.array([sum(y.rstrip()[-1:] in b".!?:;\"')" for y in x) for x in lines]) / n_lines

    letters = np.maximum(capitals + small, 1)
    mean_length = (sizes - count) / per_word

    def vote(bad, good):
        return np.where(bad, -1, np.where(good, 1, 0))

    some = count > 0
    many = count >= 10  # shares of fewer words say little
    votes = np.stack(
        [
            vote(count < 1, count >= 50),
            vote(symbols > 0.4 * per_word, some & (symbols < 0.05 * per_word)),
            vote(many & (capitals > 0.5 * letters), some & (capitals < 0.15 * letters)),
            vote(many & (stop < 0.06), stop > 0.15),
            vote(dup > 0.3, some & (dup < 0.05)),
            vote(many & ((mean_length < 2.5) | (mean_length > 11)), (mean_length >= 3) & (mean_length <= 8)),
            vote(many & (again > 0.15), some & (again < 0.01)),
            vote(some & (ends < 0.2), some & (ends > 0.7)),
        ],
        1,
    )
    # a word's shape: the kinds of characters it has, its length, and whether it repeats the one before
    edge = np.flatnonzero(np.diff((~((data == 32) | ((data >= 9) & (data <= 13)))).view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    flags = np.zeros(len(start), "u8")
    flags[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    for k in (1, 3, 4):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        flags = flags * np.uint64(3) + np.minimum(total[end] - total[start], 2).astype("u8")
    shape = mix(flags * np.uint64(64) + np.minimum(end - start, 20).astype("u8") + np.uint64(7))
    top = np.uint64(64 - BITS)
    return votes, np.stack([(h >> top).astype("i4"), (shape >> top).astype("i4")]), owner


def _texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def pattern(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(1)


def fit_labellers(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Share of good documents, ``P(vote | class)`` (class, labeller, vote), and each pattern's posterior."""
    k = len(LABELLERS)
    keys = np.array(sorted(counts))
    weight = np.array([counts[x] for x in keys], "f8")
    votes = keys[:, None] // 3 ** np.arange(k) % 3
    one = np.eye(3)[votes]  # pattern, labeller, vote
    good = np.where((votes - 1).sum(1) >= k // 2, 0.9, 0.2)  # start: an agreement well beyond a draw
    for _ in range(rounds):
        prior = np.clip((weight * good).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        prob = np.stack([np.einsum("p,plv->lv", weight * c, one) + 0.5 for c in (1 - good, good)])
        prob /= prob.sum(2, keepdims=True)
        log = np.einsum("plv,clv->pc", one, np.log(prob)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return prior, prob, dict(zip(keys.tolist(), good.tolist()))


def fit_scorer(rows: list[tuple[bytes, float]], rounds: int = 300, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the hashed features and a bias, by Adagrad on the mean logistic loss."""
    size = 1 << BITS
    w, grad2, bias, bias2 = np.zeros(2 * size, "f4"), np.full(2 * size, 1e-8, "f4"), 0.0, 1e-8
    if not rows:
        return w, bias
    parts = [np.frombuffer(f, [("i", "<i4"), ("x", "<f4")]) for f, _ in rows]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    i, x = (np.concatenate([p[c] for p in parts]) for c in ("i", "x"))
    y = np.array([v for _, v in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[i] * x, len(y)) + bias, -30, 30)))
        err = (p - y) / len(y)
        g = np.bincount(i, err[owner] * x, 2 * size).astype("f4") + decay / len(y) * w
        grad2 += g * g
        w -= (rate / 10) * g / np.sqrt(grad2)
        bias2 += err.sum() ** 2
        bias -= 0.1 * err.sum() / np.sqrt(bias2)
    return w, float(bias)


def _vectors(features: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """Feature numbers and values of each text: the square root of a feature's share of the words."""
    out = []
    size = 1 << BITS
    ends = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(ends[:-1], ends[1:]):
        both = np.concatenate([features[0, a:b], features[1, a:b].astype("i8") + size])
        i, c = np.unique(both, return_counts=True)
        v = np.empty(len(i), [("i", "<i4"), ("x", "<f4")])
        v["i"], v["x"] = i, np.sqrt(c / max(1, b - a))
        out.append(v.tobytes())
    return out


def classify(documents: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """``doc_id, posterior`` (of its votes), ``score`` (of the scorer) and ``kept`` for every document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            got = [pattern(look(texts[a:b])[0]) for a, b in groups(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(got) if got else [], pa.int32())], names=["doc_id", "k", "pattern"])

    keyed = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    labelled = cut(keyed.mapInArrow(label, "doc_id long, k long, pattern int"))
    counts = {r["pattern"]: r["count"] for r in labelled.groupBy("pattern").count().collect()}  # at most 3**8 rows
    if not counts:
        return labelled.select("doc_id", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(True).alias("kept"))
    posterior = fit_labellers(counts)[2]

    # the smallest hashes, about train_rows of them, found by a bound on the hash
    share = min(1.0, train_rows / sum(counts.values()))
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            for a, b in groups(texts):
                votes, features, owner = look(texts[a:b])
                good = [posterior.get(p, 0.5) for p in pattern(votes).tolist()]
                vectors_ = pa.array(_vectors(features, owner, b - a), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), vectors_, pa.array(good)], names=["k", "f", "y"])

    # different rows have hashes of their own, so about train_rows of them or fewer are under the bound, however often rows repeat
    sample = keyed.where(F.col("k") <= bound).dropDuplicates(["k", "doc_id", "text"]).mapInArrow(vectors, "k long, f binary, y double")
    rows = sorted((r.k, bytes(r.f), r.y) for r in sample.collect())
    weights, bias = fit_scorer([(f, y) for _, f, y in rows])
    shared = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, size = shared.value, 1 << BITS
        for batch in batches:
            texts = _texts(batch.column(1))
            post, out = [], []
            for a, b in groups(texts):
                votes, features, owner = look(texts[a:b])
                post += [posterior.get(p, 0.5) for p in pattern(votes).tolist()]
                both = np.concatenate([features[0], features[1].astype("i8") + size])
                key = np.concatenate([owner, owner]) * np.int64(2 * size) + both
                key, c = np.unique(key, return_counts=True)
                doc, i = key // (2 * size), key % (2 * size)
                x = np.sqrt(c / np.bincount(owner, minlength=b - a)[doc])
                z = np.bincount(doc, w[i] * x, b - a) + bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            s = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post, pa.float64()), pa.array(s), pa.array(s >= threshold)], names=["doc_id", "posterior", "score", "kept"])

    return docs.mapInArrow(score, "doc_id long, posterior double, score double, kept boolean")


def op4_quality_model(spark, sf_dir) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
