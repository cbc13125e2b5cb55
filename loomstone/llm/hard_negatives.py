"""Hard negatives of anchors, found through stored angles to reference directions.

For unit directions the angle is a metric, so the angle between an anchor and a row lies between the
difference and the sum of their angles to any third direction.  The cosines of both ends, times the two
norms, bound the score; bounds are widened by more than all rounding can amount to, so a row that they
exclude can't be in a window.  Scores are counted in integers for the others only.

1. Rows that take part are quantised and numbered; REFERENCES directions are fitted to a sample of
   SAMPLE rows (by hash of the row).  Every row gets its angles to all of them, and is written once,
   sorted by its nearest direction and the angle to it, in blocks of at most BLOCK rows of one direction
   and width.  So a block is a range of angles, and ``blocks`` keeps the least and greatest of each angle
   and norm.  Anchors are written likewise in groups of at most GROUP.
2. Positives: in its own block each anchor finds its best rows of the same label; the last of these
   scores is the least that rows of other blocks must reach.
3. Pairs of a block and a group whose bounds reach it meet in one task, which finds for each anchor the
   stretch of angles that may reach it, and scores these rows.  A window by anchor keeps the best.
4. Negatives: the same with the ranges that the positives' scores define, for rows of other labels.

Blocks and groups are bounded, so copies of one vector and a label with most rows fill many of them.
A row is sent once for each group of anchors that its block may answer, and an anchor once for each such
block: 1 / GROUP + 1 / BLOCK of the pairs.  No pair of rows is emitted but the best of each task.

Rows of one id are different rows; each such anchor is answered.  A null id is no anchor, comes last
among ties and can be a positive or negative.  Vectors of another width than the anchor's take no part
for it; a vector without components scores 0.  Scores that don't fit a long are ordered exactly and
reported as the nearest long; of more than 38 digits, a positive's counts as 38 nines.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

REFERENCES, SAMPLE = 24, 2048
BLOCK, GROUP = 4096, 1024
POSITIVES, NEGATIVES = 5, 3
SLACK = 1e-4  # radians by which an angle may be off: single precision and the errors of cosines near one
STRIP = 64  # anchors scored at once against the union of their stretches
EXACT = 1 << 53
LONG = 2**63 - 1
ROW = "row long, vec_id long, label int, width int, q array<double>, norm double, home int, angles array<float>"


def scale(x) -> np.ndarray:
    """floor(256 * x) as doubles, which hold it exactly while 256 * x is finite."""
    return np.floor(np.asarray(x, "f8") * 256.0)


def fit_references(sample: list[np.ndarray], n: int, rounds: int = 8) -> np.ndarray:
    """Unit directions by spherical k-means from the sample's first rows."""
    x = np.array(sample, "f8")
    x = x[np.isfinite(x).all(1)]
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    x = x[(norms > 0) & np.isfinite(norms)]
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x = np.unique(x, axis=0)
    if not len(x):
        return x
    centres = x[:: max(1, len(x) // n)][:n]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.array([x[nearest == k].sum(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centres)
    return centres


def prepared(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part, labels moved."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("int").alias("label"), v.alias("embedding"))


def measured(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """ROW of each row: its number, quantised vector, norm, nearest direction and angles."""
    width = references.shape[1] if len(references) else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for vec_id, label, x in zip(*(c.to_pylist() for c in batch.columns)):
                q = scale(x)
                top = np.abs(q).max(initial=0.0)
                norm = float(np.linalg.norm(q / top) * top) if top else 0.0
                home, angles = -1, []
                if len(q) == width:
                    angles = np.full(len(references), math.pi / 2)
                    if 0 < norm < math.inf:
                        angles = np.arccos(np.clip(references @ (q / top / (norm / top)), -1.0, 1.0))
                    home = int(angles.argmin())
                out.append((nth, vec_id, label, len(q), q, norm, home, angles))
                nth += 1
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in ROW.split(", ")])

    return rows.mapInArrow(run, ROW)


def in_blocks(rows: DataFrame, most: int, name: str, total: int) -> DataFrame:
    """``rows`` with a number of their block in column ``name``: consecutive in (width, direction, angle), at most ``most`` rows."""
    parts = max(1, min(total // most, 1 << 15))
    order = [F.col("width"), F.col("home"), F.col("angle"), F.col("row")]
    rows = rows.withColumn("angle", F.coalesce(F.get("angles", F.col("home")), F.lit(0.0).cast("float")))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, count, now = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            own = []
            for key in zip(batch.column("width").to_pylist(), batch.column("home").to_pylist()):
                if key != now or count == most:
                    block, count, now = block + 1, 0, key
                count += 1
                own.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return written(ordered.mapInArrow(run, f"{kinds}, {name} long"))


def extents(rows: DataFrame, name: str, references: int, *more: Column) -> DataFrame:
    """Of each block: width, least and greatest angle to each direction, least and greatest norm, and what else is asked for."""
    at = lambda f, k: f(F.get("angles", F.lit(k)))
    return rows.groupBy(name).agg(
        F.first("width").alias(f"{name}_width"),
        F.min("norm").alias(f"{name}_least"),
        F.max("norm").alias(f"{name}_most"),
        F.array(*(F.struct(at(F.min, k).alias("a"), at(F.max, k).alias("b")) for k in range(references))).cast("array<struct<a:float,b:float>>").alias(f"{name}_angles"),
        *more,
    )


def nearest_and_farthest(x: Column, y: Column) -> tuple[Column, Column]:
    """Least and greatest angle between a row of one block and a row of another, by all directions."""
    both = F.arrays_zip(x.alias("x"), y.alias("y"))
    gap = F.transform(both, lambda z: F.greatest(z["x"]["a"] - z["y"]["b"], z["y"]["a"] - z["x"]["b"], F.lit(0.0)))
    far = F.transform(both, lambda z: F.least(z["x"]["b"] + z["y"]["b"], 2 * math.pi - z["x"]["a"] - z["y"]["a"], F.lit(math.pi)))
    gap = F.greatest(F.coalesce(F.array_max(gap), F.lit(0.0)) - SLACK, F.lit(0.0))
    return gap, F.least(F.coalesce(F.array_min(far), F.lit(math.pi)) + SLACK, F.lit(math.pi))


def widened(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """Score bounds that rounding can't have moved: 1e-9 of the norms' product covers the cosines' and products' errors."""
    return low - size * 1e-9 - 1, high + size * 1e-9 + 1


def bounds(gap: Column, far: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """Least and greatest score of two rows with such angles and such products of norms."""
    high = F.when(F.cos(gap) >= 0, most * F.cos(gap)).otherwise(least * F.cos(gap))
    low = F.when(F.cos(far) >= 0, least * F.cos(far)).otherwise(most * F.cos(far))
    return widened(low, high, most)


def stretches(alpha, norm, low, high, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """For anchors at ``alpha`` from a direction: between which angles to it rows may score from ``low`` to ``high``.

    ``least`` and ``most`` are the rows' norms.  A row at theta scores at most |a||v| cos(alpha - theta) and at
    least |a||v| cos(alpha + theta); either excludes it only where the norms can't make up for it.
    """
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        big, small = norm * most, norm * least
        edge = 1.0 + big * 1e-9
        reach = np.where(low - edge > 0, (low - edge) / big, np.where(small > 0, (low - edge) / small, -2.0))
        wide = np.where(reach <= -1, math.pi, np.where(reach > 1, -1.0, np.arccos(np.clip(reach, -1, 1)) + 2 * SLACK))
        top = np.where(high + edge > 0, np.where(small > 0, (high + edge) / small, 2.0), (high + edge) / big)
        close = np.where(top >= 1, 0.0, np.where(top < -1, math.pi + 1, np.arccos(np.clip(top, -1, 1)) - 2 * SLACK))
    # NaN comes of norms beyond doubles: nothing is excluded then
    wide, close = np.where(np.isnan(wide), math.pi, wide), np.where(np.isnan(close), 0.0, close)
    none = (wide < 0) | (close > math.pi)
    first = np.maximum(alpha - wide, close - alpha)
    return np.where(none, 9.0, first), np.where(none, -9.0, alpha + wide)


def scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles where each partial sum is below 2**53, else Python's integers."""
    width = max(1, a.shape[1])
    if not a.size or not v.size:
        return np.zeros((len(a), len(v)))
    if float(np.abs(a).max()) * float(np.abs(v).max()) * width < EXACT:
        return a @ v.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object)
    return whole(a) @ whole(v).T


def vectors(table_: pa.Table, column: str) -> np.ndarray:
    n = table_.num_rows
    flat = table_.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def ids_for_order(table_: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and 1 where they are null, which come last."""
    ids = table_.column("vec_id")
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype("i1")


def ranges(anchors: pa.Table) -> tuple[list, list]:
    """Least and greatest scores asked for, by anchor: from 50 p <= 100 n <= 95 p for each positive, or what ``least`` says."""
    if "positives" in anchors.column_names:
        positives = [[int(p) for p in ps] for ps in anchors.column("positives").to_pylist()]
        return [[-(-p // 2) for p in ps] for ps in positives], [[19 * p // 20 for p in ps] for ps in positives]
    return [[x] for x in anchors.column("least").to_pylist()], [[math.inf]] * anchors.num_rows


def found(anchors: pa.Table, rows: pa.Table, n: int, same_label: bool) -> Iterator[tuple]:
    """(anchor's place, range's place, row's place, score) of each anchor's first ``n`` rows within each range.

    ``anchors`` and ``rows`` are of one width, rows of one direction in the order of their angle to it.
    """
    q, v = vectors(anchors, "q"), vectors(rows, "q")
    lows, highs = ranges(anchors)
    ids, nulls = ids_for_order(rows)
    numbers = rows.column("row").to_numpy()
    own, labels = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    home = rows.column("home")[0].as_py()
    theta = rows.column("angle").to_numpy().astype("f8")
    norms = rows.column("norm").to_numpy()
    if home >= 0:
        alpha = vectors(anchors, "angles")[:, home].astype("f8")
        low, high = np.array([min(x) for x in lows], "f8"), np.array([max(x) for x in highs], "f8")
        first, last = stretches(alpha, anchors.column("norm").to_numpy(), low, high, norms.min(), norms.max())
        begin, end = np.searchsorted(theta, first, "left"), np.searchsorted(theta, last, "right")
    else:
        begin, end = np.zeros(len(q), int), np.full(len(q), len(v))
    order = np.lexsort((end, begin))
    numbers_of = anchors.column("row").to_numpy()
    for at in range(0, len(order), STRIP):
        strip = order[at : at + STRIP]
        strip = strip[begin[strip] < end[strip]]
        if not len(strip):
            continue
        left, right = begin[strip].min(), end[strip].max()
        all_scores = scores(q[strip], v[left:right])
        for i, line in zip(strip, all_scores):
            b, e = begin[i], end[i]
            line = line[b - left : e - left]
            fit = (labels[b:e] == own[i]) & (numbers[b:e] != numbers_of[i]) if same_label else labels[b:e] != own[i]
            fit &= (line >= min(lows[i])) & (line <= max(highs[i]))
            some = np.flatnonzero(fit)
            for k, (lo, hi) in enumerate(zip(lows[i], highs[i])):
                have = some[(line[some] >= lo) & (line[some] <= hi)]
                if len(have) > 4 * n and line.dtype != object:  # the n-th best first, so that only its equals are sorted
                    have = have[line[have] >= np.partition(line[have], len(have) - n)[len(have) - n]]
                keys = (numbers[b:e][have], ids[b:e][have], nulls[b:e][have], -line[have])
                if line.dtype == object:
                    rank = {s: r for r, s in enumerate(sorted(set(line[have]), reverse=True))}
                    keys = (*keys[:3], np.array([rank[s] for s in line[have]], "i8"))
                for j in have[np.lexsort(keys)[:n]]:
                    yield int(i), k, int(b + j), int(line[j])


FOUND = "anchor long, slot int, row long, vec_id long, score decimal(38,0)"
WIDEST = 10**38 - 1


def answered(anchors: pa.Table, rows: pa.Table, n: int, same_label: bool) -> pa.Table:
    got = list(found(anchors, rows, n, same_label)) if anchors.num_rows and rows.num_rows else []
    i, k, j, s = ([x[c] for x in got] for c in range(4))
    # decimals order what longs can't hold; sums of squares beyond 38 digits are taken as the widest
    s = pa.array([max(-WIDEST, min(WIDEST, x)) for x in s], pa.decimal128(38, 0))
    return pa.table({
        "anchor": anchors.column("row").take(pa.array(i, pa.int64())), "slot": pa.array(k, pa.int32()),
        "row": rows.column("row").take(pa.array(j, pa.int64())), "vec_id": rows.column("vec_id").take(pa.array(j, pa.int64())), "score": s,
    })


def met(rows: DataFrame, blocks: DataFrame, anchors: DataFrame, references: int, n: int, same_label: bool, skip_own: bool) -> DataFrame:
    """FOUND: the first ``n`` rows of each block for each anchor and limit, of blocks that may have some.

    ``anchors`` has what ``ranges`` reads, and ``low`` and ``high``, the ends of all its ranges.
    """
    groups = extents(anchors, "group", references, F.min("low").alias("low"), F.max("high").alias("high"))
    gap, far = nearest_and_farthest(F.col("block_angles"), F.col("group_angles"))
    low, high = bounds(gap, far, F.col("block_least") * F.col("group_least"), F.col("block_most") * F.col("group_most"))
    # extents of blocks and of groups: one row for thousands of rows each
    pairs = written(blocks.join(groups, (F.col("block_width") == F.col("group_width")) & (high >= F.col("low")) & (low <= F.col("high"))).select("block", "group"))
    left = rows.join(pairs, "block").select("block", "group", "row", "vec_id", "label", "q", "norm", "home", "angle")
    keep = ["row", "label", "q", "norm", "angles", "least" if same_label else "positives"]
    right = anchors.select("group", F.col("block").alias("own"), *keep).join(pairs, "group")
    if skip_own:
        right = right.where("own <> block")
    right = right.select("block", "group", *keep)

    def run(own: pa.Table, few: pa.Table) -> pa.Table:
        own = own.combine_chunks().sort_by([("angle", "ascending"), ("row", "ascending")])
        return answered(few.combine_chunks(), own, n, same_label)

    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, FOUND)


def firsts(found_: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each anchor and slot, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def as_long(score: Column) -> Column:
    top = F.lit(LONG).cast("decimal(38,0)")
    return F.greatest(F.least(score, top), -top - 1).cast("long")


def mine(embeddings: DataFrame, every: int = 50, references: int = REFERENCES, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = prepared(embeddings)
    key = F.xxhash64("vec_id", "embedding")
    widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = widths.orderBy(F.desc("n"), "width").first()  # the width that most rows have
    sample = [r.embedding for r in rows.where(F.size("embedding") == common.width).orderBy(key).select("embedding").limit(SAMPLE).collect()] if common else []
    directions = fit_references(sample, references) if common and common.width else np.zeros((0, 0))
    total = rows.count()
    rows = in_blocks(measured(rows, directions), block, "block", total)
    few = rows.where(F.col("vec_id") % every == 0)
    anchors = in_blocks(few.drop("angle"), group, "group", few.count())
    blocks = written(extents(rows, "block", len(directions)))

    # positives: within the own block first
    def own_block(own: pa.Table, few_: pa.Table) -> pa.Table:
        own = own.combine_chunks().sort_by([("angle", "ascending"), ("row", "ascending")])
        few_ = few_.combine_chunks().append_column("least", pa.array([-math.inf] * few_.num_rows))
        return answered(few_, own, POSITIVES, True)

    seeds = written(rows.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(own_block, FOUND))
    least = seeds.groupBy(F.col("anchor").alias("row")).agg(F.min("score").cast("double").alias("least"), F.count(F.lit(1)).alias("have"))
    floor = F.lit(-math.inf)
    reach = F.coalesce(F.when(F.col("have") >= POSITIVES, F.col("least") - F.abs("least") * 1e-15), floor)
    asking = anchors.join(least, "row", "left").withColumn("least", reach).withColumn("low", F.col("least")).withColumn("high", F.lit(math.inf))
    others = met(rows, blocks, asking, len(directions), POSITIVES, True, True)
    positives = written(firsts(seeds.union(others), POSITIVES).select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")))

    # negatives: between a half and 19 twentieths of the positive's score; below 0 that is no range
    listed = F.sort_array(F.collect_list(F.struct("place", F.col("positive_score").alias("p"))))  # POSITIVES at most
    wanted = positives.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.transform(listed, lambda x: x["p"]).alias("positives"))
    of = lambda f, x: f("positives").cast("double") * x
    asking = anchors.join(wanted, "row").withColumn("low", of(F.array_min, 0.4999999)).withColumn("high", of(F.array_max, 0.9500001))
    negatives = firsts(met(rows, blocks, asking, len(directions), NEGATIVES, False, False), NEGATIVES)
    chosen = negatives.select("anchor", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = chosen.join(positives, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", as_long(F.col("positive_score")).alias("positive_score"), as_long(F.col("negative_score")).alias("negative_score"))


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = """WITH clean AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM clean a JOIN clean b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3"""
