"""N-gram Jaccard join: MinHash with Bayesian pruning of candidates, then exact verification.

1. Each text becomes its set of hashed five-word shingles (a shorter text: one shingle of all its
   words) and a MinHash signature.  Texts with equal sets form one class; its smallest doc_id
   stands for it from here on.
2. Bands of the signature propose candidates: 40 bands of 5 values, so a pair of similarity 0.8 is
   missed with probability 1.3e-7.
3. Within each bucket pairs are compared a few MinHash values at a time.  With a uniform prior, the
   posterior probability that the similarity reaches the threshold is a tail of a Beta distribution;
   a pair goes when it falls below ``tolerance``.  What is left links classes into candidate groups.
4. Within each candidate group the similarity of every pair is computed from the whole shingle sets.
   Links are counted, and linked classes are joined into groups.

Buckets and groups of any size are split into blocks of documents, and every pair of blocks is one
unit of work of bounded size, so that all pairs are compared but none are emitted: a unit returns one
row per document.  The output of a unit is sorted out by its documents' ids, so running it again
gives the same rows.

White space of ASCII separates words; case and punctuation count.  Null, empty and blank texts have
no shingles and are groups of their own.  Rows without doc_id are not compared: the join leaves them
out, ``keep_one`` passes them through.  Rows that share a doc_id have one row in the result, their
texts are in one group, and each counts as a copy in ``n_links`` of others.  Empty tables give empty results.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_keys, spread_join, table
from .graph import components
from .tokens import mix, parts, words

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
COMPARED = 100  # MinHash values that are compared one step after the other
STEP, TOLERANCE = 20, 1e-5
BLOCK = 512
BROADCAST_ROWS = 1_000_000  # up to so many ids (some 60 MB) the documents to verify are found by broadcast, beyond by shuffle
TEXT_AT_ONCE = 1 << 18
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, "u4") * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, "u4", endpoint=False)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and the number of their text, in that order."""
    h, text = words(texts, blank_separated=True)
    n = len(h) - WORDS + 1
    sizes = np.bincount(text, minlength=len(texts)) if len(h) else np.zeros(len(texts), "i8")
    parts, owner = [], []
    if n > 0:
        at = np.flatnonzero(text[:n] == text[WORDS - 1 :])
        s = np.zeros(len(at), "u8")
        for i in range(WORDS):
            s += h[at + i] * _C[i]
        parts.append(mix(s))
        owner.append(text[at])
    first = np.cumsum(sizes) - sizes
    for t in np.flatnonzero((sizes > 0) & (sizes < WORDS)):
        own = h[first[t] : first[t] + sizes[t]]
        parts.append(mix((own * _C[: len(own)]).sum(dtype="u8", keepdims=True) + np.uint64(len(own))))
        owner.append(np.array([t]))
    if not parts:
        return np.empty(0, "u8"), np.empty(0, "i8")
    s, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    return s[new], owner[new]


def _texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, 1, TEXT_AT_ONCE):
            s, owner = shingles(_texts(part.column(1)))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            if not len(s):
                continue
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            x = (s >> np.uint64(32)).astype("u4")
            sig = np.empty((len(start), BANDS * ROWS), "u4")
            for i in range(BANDS * ROWS):
                sig[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], start)
            sig = (sig * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[owner[start]], pa.int64()),
                    pa.array(np.diff(np.append(start, len(s))), pa.int64()),
                    pa.array(np.add.reduceat(s, start).view("i8")),
                    pa.array(np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), start).view("i8")),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ],
                names=["doc_id", "n", "set1", "set2", "sig"],
            )


@cache
def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of values compared (a multiple of STEP) the fewest matches that keep a pair.

    P(s >= t | m of n agree), uniform prior, is the chance that Beta(m + 1, n - m + 1) exceeds t,
    which is P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        below, m, term = 0.0, 0, (1 - threshold) ** (n + 1)
        while True:
            below += term
            if below >= tolerance:
                break
            term *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append(m)
    return tuple(out)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _units(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with whole units, from rows that are sorted by unit."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[columns].to_numpy()
        last = np.flatnonzero((key != key[-1]).any(1))
        if not len(last) and (not held or (held[-1][columns].to_numpy()[-1] == key[-1]).all()):
            held.append(batch)
            continue
        cut_at = last[-1] + 1 if len(last) else 0
        held.append(batch.iloc[:cut_at])
        yield pd.concat(held, ignore_index=True)
        held = [batch.iloc[cut_at:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _bounds(frame: pd.DataFrame, columns: list[str]) -> np.ndarray:
    key = frame[columns].to_numpy()
    return np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])), len(key))


@cache
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _pairs(block: np.ndarray, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a unit: all, or those between its two blocks."""
    if not crossed:
        return _all_pairs(len(block)) if len(block) <= 64 else np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    least = fewest_matches()
    columns = ["key", "i", "j"]
    for frame in _units(batches, columns):
        ids = frame["rep"].to_numpy()
        sig = np.frombuffer(b"".join(frame["sig"]), "<u2").reshape(len(frame), COMPARED)
        block, i_, j_ = (frame[c].to_numpy() for c in ("block", "i", "j"))
        bounds = _bounds(frame, columns)
        out, left, right, size = [], [], [], 0
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                x, y = _pairs(block[a:b], i_[a] != j_[a])
                left.append(x + a)
                right.append(y + a)
                size += len(x)
            if size > 200_000 or (b == bounds[-1] and size):
                x, y = np.concatenate(left), np.concatenate(right)
                agree = np.zeros(len(x), "i4")
                for k, low in enumerate(least):  # a few values at a time; what is hopeless goes
                    part = slice(k * STEP, (k + 1) * STEP)
                    agree += (sig[x, part] == sig[y, part]).sum(1, dtype="i4")
                    keep = agree >= low
                    x, y, agree = x[keep], y[keep], agree[keep]
                if len(x):
                    root = _local_roots(len(ids), x, y)
                    tied = np.flatnonzero(root != np.arange(len(ids)))
                    out.append(np.unique(np.stack([ids[tied], ids[root[tied]]], 1), axis=0))
                left, right, size = [], [], 0
        if out:
            rows = np.unique(np.concatenate(out), axis=0)
            yield pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1]})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, 1, TEXT_AT_ONCE):
            s, owner = shingles(_texts(part.column(1)))
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            own = [s[ends[k] : ends[k + 1]] for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *part.columns[2:],
                    pa.array([int(x.sum(dtype="u8").view("i8")) for x in own], pa.int64()),
                    pa.array([x.tobytes() for x in own], pa.binary()),
                ],
                names=["rep", *part.schema.names[2:], "set1_", "shingles"],
            )


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    every = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.empty(0, bool)
    kind = np.cumsum(new) - 1
    shared = np.bincount(kind, minlength=1)[kind] > 1 if len(kind) else new
    kind, who = kind[shared], who[shared]
    out = np.zeros((len(sets), len(sets)), "f4")
    if len(kind):
        kind = np.cumsum(np.concatenate([[False], kind[1:] != kind[:-1]]))
        for a in range(0, int(kind[-1]) + 1, 4096):
            lo, hi = np.searchsorted(kind, [a, a + 4096])
            m = np.zeros((len(sets), 4096), "f4")
            m[who[lo:hi], kind[lo:hi] - a] = 1
            out += m @ m.T
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["component", "i", "j"]
    for frame in _units(batches, columns):
        key = frame[[*columns, "rep"]].to_numpy()
        again = np.concatenate([[False], (key[1:] == key[:-1]).all(1) & (frame["shingles"].to_numpy()[1:] == frame["shingles"].to_numpy()[:-1])])
        frame = frame[~again].reset_index(drop=True)  # a row that is repeated in the table
        bounds = _bounds(frame, columns)
        ids, block, weight = (frame[c].to_numpy() for c in ("rep", "block", "weight"))
        i_, j_ = frame["i"].to_numpy(), frame["j"].to_numpy()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            sets = [np.frombuffer(s, "u8") for s in frame["shingles"].iloc[a:b]]
            n = np.array([len(s) for s in sets], "f8")
            both = common_counts(sets).astype("f8")
            linked = both >= THRESHOLD * (n[:, None] + n[None, :] - both) - 1e-9
            linked &= ids[a:b][:, None] != ids[a:b][None, :]
            if i_[a] != j_[a]:
                linked &= block[a:b][:, None] != block[a:b][None, :]
            x, y = np.nonzero(linked)
            if len(x):
                order = np.argsort(ids[a:b], kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                root = order[_local_roots(b - a, rank[x], rank[y])][rank]
                some = np.unique(x)
                out.append(np.stack([ids[a + some], linked[some] @ weight[a:b], ids[a + root[some]]], 1))
        if out:
            rows = np.concatenate(out)
            yield pd.DataFrame({"rep": rows[:, 0], "links": rows[:, 1], "root": rows[:, 2]})


def _blocks(rows: DataFrame, size: str, of: str) -> DataFrame:
    """Each row once for every pair of blocks that its block is in: columns ``block, i, j``."""
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(of), n).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_o", size)


def join_near(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links``: the smallest doc_id of its group of linked documents, and its links."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    signed = cut(docs.mapInArrow(_signatures, "doc_id long, n long, set1 long, set2 long, sig binary"))
    nodes = cut(signed.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig")))
    bands = F.array(*(F.xxhash64(F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS), F.lit(b)) for b in range(BANDS)))
    keys = nodes.select("rep", F.explode(bands).alias("key"))
    full = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    heavy = heavy_keys(full, ["key"], "size", BANDS * nodes.count())
    found = spread_join(keys, full, ["key"], heavy).join(nodes.select("rep", F.substring("sig", 1, 2 * COMPARED).alias("sig")), "rep")
    units = _blocks(found, "size", "rep")
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(shuffle, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    group = components(units.mapInPandas(_prune, "a long, b long"))
    group = cut(group)

    sizes = cut(group.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    to_check = spread_join(group, sizes, ["component"], heavy_keys(sizes, ["component"], "size", group.count())).withColumnRenamed("node", "rep").join(nodes.select("rep", "set1", "weight"), "rep")
    to_check = cut(to_check)
    side = F.broadcast(to_check) if to_check.count() <= BROADCAST_ROWS else to_check
    texts = docs.withColumnRenamed("doc_id", "rep").join(side, "rep").select("rep", "text", "component", "size", "set1", "weight")
    sets = texts.mapInArrow(_sets, "rep long, component long, size long, set1 long, weight long, set1_ long, shingles binary")
    sets = sets.where("set1 = set1_").select("rep", "component", "size", "weight", "shingles")
    units = _blocks(sets, "size", "rep").repartition(shuffle, "component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
    verified = cut(units.mapInPandas(_verify, "rep long, links long, root long"))
    final = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))

    classes = nodes.select("set1", "set2", "rep", "weight").join(final, "rep", "left").join(links, "rep", "left")
    # a class of one document with no links needs no row: what is joined to the documents is short
    classes = classes.where("weight > 1 or component is not null")
    heavy = heavy_keys(nodes, ["set1", "set2"], "weight", signed.count())
    out = docs.select("doc_id").join(
        spread_join(signed.select("doc_id", "set1", "set2"), classes, ["set1", "set2"], heavy).select("doc_id", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
        "doc_id",
        "left",
    )
    return out.groupBy("doc_id").agg(F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"), F.coalesce(F.max("n_links"), F.lit(0)).cast("long").alias("n_links"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stand for their group: those with its smallest doc_id."""
    lost = join_near(documents).where("class_id <> doc_id").select("doc_id")
    lost = cut(lost)
    side = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    return documents.join(side, "doc_id", "left_anti").select(*documents.columns)


def op2_near_duplicates(spark, sf_dir) -> DataFrame:
    return join_near(table(spark, sf_dir, "documents").select("doc_id", "text"))
