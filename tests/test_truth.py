"""Retraction by remaining supports against a naive recursion, and walks over stored adjacency."""

import random
import time

from loomstone.operators import truth as T

SCHEMA = "belief string, support string, kind string, rule string, real string"


def naive(rows, seeds):
    """Sweep over all beliefs until nothing changes."""
    supports, derived = {}, set()
    for belief, support, kind, rule in rows:
        if belief is None or support is None or belief == support:
            continue
        own = supports.setdefault(belief, {})
        own[support] = own.get(support, False) or kind != "assumption"
        if (rule or "") not in ("", "extraction", "confirmation"):
            derived.add(belief)
    gone = dict.fromkeys((s for s in seeds if s is not None), 0)
    for round_ in range(1, 1000):
        new = [
            b
            for b, own in supports.items()
            if b not in gone and any(s in gone for s in own) and (b in derived or not any(real and s not in gone for s, real in own.items()))
        ]
        if not new:
            break
        gone |= dict.fromkeys(new, round_)
    left = {b: sum(real and s not in gone for s, real in own.items()) for b, own in supports.items() if b not in gone and any(s in gone for s in own)}
    return gone, left


def outcome(spark, rows, seeds):
    adjacency = T.justifications(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    done = T.retract(adjacency, spark.createDataFrame([(s,) for s in seeds], "node string"))
    fallen = done.fallen().collect()
    weakened = done.weakened().collect()
    assert len(fallen) == len({r.node for r in fallen})
    return {r.node: r.round for r in fallen}, {r.belief: r.remaining for r in weakened}


def test_random_graphs_with_circles(spark):
    rnd = random.Random(7)
    for _ in range(4):
        names = [f"b{i}" for i in range(60)] + [f"e{i}" for i in range(20)]
        rows = [
            (f"b{rnd.randrange(60)}", rnd.choice(names), rnd.choice(["event", "belief", "assumption", None]), rnd.choice(["", "", "extraction", "confirmation", "r_rule", None]))
            for _ in range(170)
        ]
        rows += rows[:10] + [(None, "e1", "event", ""), ("b1", None, "event", "")]
        seeds = [*rnd.sample(names, 12), "unknown", None]
        assert outcome(spark, rows, seeds) == naive(rows, seeds)


def test_the_rules_by_name(spark):
    rows = [
        ("two", "a", "event", ""), ("two", "b", "event", ""),  # stays: b is left
        ("one", "a", "event", "extraction"),  # falls
        ("rule", "a", "belief", "r1"), ("rule", "b", "belief", "r1"),  # falls with any premise
        ("guess", "a", "event", ""), ("guess", "x", "assumption", ""),  # falls: an assumption doesn't hold it
        ("left", "right", "belief", ""), ("right", "left", "belief", ""), ("left", "a", "event", ""),  # hold each other
        ("next", "one", "belief", ""), ("own", "own", "belief", ""), ("own", "a", "event", ""),
    ]
    fallen, left = outcome(spark, rows, ["a"])
    assert fallen == {"a": 0, "one": 1, "rule": 1, "guess": 1, "own": 1, "next": 2}
    assert left == {"two": 1, "left": 1}


def test_a_hot_support_and_a_long_chain(spark):
    rows = [(f"c{i + 1}", f"c{i}", "belief", "") for i in range(12)] + [(f"h{i}", "c3", "event", "") for i in range(3000)]
    fallen, left = outcome(spark, rows, ["c0"])
    assert (fallen, left) == naive(rows, ["c0"]) and len(fallen) == 3013


def test_nothing_to_retract(spark):
    assert outcome(spark, [("a", "b", "event", "")], ["z"]) == ({"z": 0}, {})
    adjacency = T.justifications(spark.createDataFrame([], SCHEMA))
    assert T.retract(adjacency, spark.createDataFrame([], "node string")).fallen().count() == 0


def test_only_the_frontier_is_shuffled(spark):
    """The plan of a round reads the edges without an exchange."""
    edges = spark.createDataFrame([(f"b{i}", f"s{i % 50}", "event", "") for i in range(500)], "belief string, support string, kind string, rule string")
    adjacency = T.justifications(edges)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        step = adjacency.of(spark.createDataFrame([("s1",)], "node string").repartition(3))
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(i for i, line in enumerate(plan.splitlines()) if adjacency.table in line)
    above = plan.splitlines()[:scan]
    branch = [x for x in above if "Exchange" in x]
    assert len(branch) <= 2 and all("s1" not in x for x in branch)
    assert "Bucketed: true" in plan and sum("hashpartitioning" in x for x in plan.splitlines()) == 1


def test_walks(spark):
    rnd = random.Random(2)
    pairs = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(90)] + [("hub", f"n{i}") for i in range(80)]
    adjacency = T.undirected(spark.createDataFrame(pairs, "a string, b string"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for depth, most in ((5, None), (7, 3), (0, None)):
        hops, frontier = {"n1": 0}, ["n1"]
        for h in range(1, depth + 1):
            new = {b for a in frontier for b in sorted(near.get(a, ()))[:most]} - hops.keys()
            hops |= dict.fromkeys(new, h)
            frontier = list(new)
        got = T.neighbours(adjacency, spark.createDataFrame([("n1",)], "node string"), depth, most).collect()
        assert {r.node: r.hops for r in got} == hops and len(got) == len(hops)


def test_storing_leaves_no_shuffle_files(spark):
    def files():
        kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(kept.size()) if (n := kept.apply(i).getName()).startswith("shuffle_")}

    before = files()
    adjacency = T.justifications(spark.createDataFrame([(f"b{i % 50}", f"s{i}", "event", "", "x") for i in range(500)], SCHEMA))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left
    assert {(r.belief, r.reals) for r in adjacency.edges().collect()} == {(f"b{i}", 10) for i in range(50)}
