"""Scans over blocks against plain loops, with a key that holds most rows."""

import random

from pyspark.sql import functions as F

from loomstone.operators.scans import Ordered

SCHEMA = "k string, i long, v long"


def data(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choices(["hot", "a", "b", None], [70, 10, 10, 10])[0], i, rnd.choice([None, *range(9)])) for i in rnd.sample(range(10 * n), n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sums_previous_and_budgets(spark):
    rows = data(1500, 1)
    o = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["k"], ["i"], 60)
    sums, before, taken = {}, {}, {}
    for k, own in by_key(rows).items():
        total, last = 0, None
        for _, i, v in own:
            if total < 900:
                taken[k, i] = min(v or 0, 900 - total)
            total += v or 0
            sums[k, i], before[k, i] = total, last
            last = i
    got = o.running(F.col("v"), "s").collect()
    assert {(r.k, r.i): r.s for r in got} == sums and len(got) == len(rows)
    assert {(r.k, r.i): r.s - (r.v or 0) for r in got} == {(r.k, r.i): r.s for r in o.running(F.col("v"), "s", inclusive=False).collect()}
    assert {(r.k, r.i): r.prev_i for r in o.previous(["i", "v"]).collect()} == before
    assert {(r.k, r.i): r.taken for r in o.within_budget("v", 900).collect()} == taken


def test_no_block_is_large(spark):
    o = Ordered.of(spark.createDataFrame(data(3000, 2), SCHEMA), ["k"], ["i"], 100)
    sizes = [r["count"] for r in o.rows.groupBy("k", "_block").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400


def test_many_blocks_of_a_key_go_up_a_level(spark):
    rows = data(400, 3)
    o = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["k"], ["i"], 8)  # the hot key has more than 8 blocks
    sums = {}
    for k, own in by_key(rows).items():
        total = 0
        for _, i, v in own:
            total += v or 0
            sums[k, i] = total
    assert {(r.k, r.i): r.s for r in o.running(F.col("v"), "s").collect()} == sums


def test_empty(spark):
    o = Ordered.of(spark.createDataFrame([], SCHEMA), ["k"], ["i"])
    assert o.running(F.col("v"), "s").count() == o.previous(["v"]).count() == o.within_budget("v", 5).count() == 0
