"""Operators on small inputs with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import curation, eventlog, retrieval
from loomstone.sources import mirror


def test_sessions_split_at_more_than_the_gap(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", m) for m in (0, 19, 39, 59)] + [(1, "2024-01-01 01:19:01", 99)]
    df = spark.createDataFrame(rows, "u int, t string, i int").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.i: r.session for r in eventlog.sessionize(df, "u", "t", 1200, "i").collect()}
    assert got == {0: 0, 19: 0, 39: 0, 59: 0, 99: 1}


def test_append_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "event_id int, x string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "event_id int, x string")
    assert [tuple(r) for r in eventlog.append(old, new).collect()] == [(3, "c")]


def test_replay_of_a_prefix_is_the_state_then(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    t = "2024-01-10 00:00:00"
    got = {(r.entity_id, r.predicate): r.seq for r in eventlog.as_of(events, t).collect()}
    want = {}
    for r in sorted(events.where(F.col("ts") <= F.lit(t).cast("timestamp_ntz")).collect(), key=lambda r: (r.ts, r.event_id)):
        want[r.user_id, r.event_type] = r.event_id
    assert got == want


def test_trust_ceiling(spark):
    row = spark.range(1).select(
        eventlog.clamp_to_ceiling(F.lit(0.99), F.lit(1), F.lit(False)).alias("a"),
        eventlog.clamp_to_ceiling(F.lit(0.99), F.lit(4), F.lit(True)).alias("b"),
        eventlog.raw_confidence(F.lit(0.5), F.lit(9), F.lit(1)).alias("c"),
        eventlog.raw_confidence(F.lit(0.1), F.lit(0), F.lit(5)).alias("d"),
    ).first()
    assert (row.a, row.b, row.d) == (0.6, 0.99, 0.0) and row.c == pytest.approx(0.65)


def test_mmr_matches_greedy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 8))
    rel = rng.random(30)
    rows = [(0, i, float(rel[i]), v[i].tolist()) for i in range(30)]
    got = [r.id for r in retrieval.mmr(spark.createDataFrame(rows, "group long, id long, rel double, embedding array<double>"), 8).orderBy("pick").collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    scaled = (rel - rel.min()) / (rel.max() - rel.min())
    want = []
    while len(want) < 8:
        score = [-np.inf if i in want else 0.7 * scaled[i] - 0.3 * max([u[i] @ u[j] for j in want], default=0) for i in range(30)]
        want.append(int(np.argmax(score)))
    assert got == want


def test_access_truth_table(spark):
    rows = [("u1:a", "u1:a", "private", [], [], True, True), ("u1:b", "u1:a", "private", [], [], False, False), ("u1:b", "u1:a", "user_agents", [], [], False, True),
            ("u1:b", "u1:a", "private", ["u1:a"], [], False, True), ("u1:b", "u1:a", "user_agents", [], ["u1:a"], False, False), ("u1:b", "u1:a", "user_agents", [], [], True, False),
            ("u2:b", "u1:a", "user_agents", ["u1:a"], [], False, False)]
    df = spark.createDataFrame(rows, "o string, p string, m string, allow array<string>, deny array<string>, boxed boolean, want boolean")
    got = df.select("want", curation.can_read(*(F.col(c) for c in ("o", "p", "m", "allow", "deny", "boxed"))).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_cascade_and_roots(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "belief long, support long")
    assert {r.node for r in curation.cascade(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {1, 2, 3, 4}
    rnd = random.Random(1)
    links = {i: rnd.randrange(i) for i in range(1, 60) if rnd.random() < 0.8}
    want = {}
    for n in links:
        x = n
        while x in links:
            x = links[x]
        want[n] = x
    got = curation.roots(spark.createDataFrame(list(links.items()), "node long, to long"))
    assert {r.node: r.root for r in got.collect()} == want


def test_cascade_of_long_chains_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], curation.checkpointed
    monkeypatch.setattr(curation, "checkpointed", lambda df: rounds.append(0) or plain(df))
    rows = [(i + 1, i) for i in range(300)] + [(1001, 1000), (1000, 1001), (1002, 1001), (None, 5), (None, 1000), (7, None)]
    got = [r.node for r in curation.cascade(spark.createDataFrame(rows, "belief long, support long"), spark.createDataFrame([(0,), (2000,)], "node long")).collect()]
    assert len(got) == 303 and set(got) == {*range(301), 2000, None}
    assert len(rounds) < 20


def test_cascade_of_several_supports(spark):
    rnd = random.Random(5)
    for size in (60, 90):
        rows = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(size)] + [(100 + i, 99 + i) for i in range(20)] + [(110, 3), (100, 4), (105, 105)]
        want = seeds = set(rnd.sample(range(80), 4))
        while new := {b for b, s in rows if s in want} - want:
            want = want | new
        got = [r.node for r in curation.cascade(spark.createDataFrame(rows, "belief long, support long"), spark.createDataFrame([(x,) for x in seeds], "node long")).collect()]
        assert len(got) == len(want) and set(got) == want


def test_guarded_sql(spark):
    assert mirror.read_only_sql(spark, "SELECT 1 AS x").first().x == 1
    assert mirror.read_only_sql(spark, "WITH t AS (SELECT 'Drop' AS x UNION ALL SELECT 'b') SELECT x FROM t WHERE x IN (SELECT x FROM t WHERE x = 'Drop')").first().x == "Drop"
    path = "SELECT * FROM parquet.`/etc/x`"
    deep = "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.System', 'exit'))"
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE TABLE y AS SELECT 1", path, f"SELECT 1 WHERE 1 IN ({path})", "SELECT reflect('java.lang.System', 'getenv')", deep):
        with pytest.raises(ValueError):
            mirror.read_only_sql(spark, bad)


def test_read_and_answer_matches_brute_force(spark, sf):
    import math
    import re

    from loomstone.operators.answering import t8

    words = ["with", "for", "that"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = {d: re.findall(retrieval.WORD, t.lower()) for d, t in docs.items()}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    df = {w: sum(w in x for x in tok.values()) for w in words}
    score = {
        d: round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / avg)) for w in words), 6)
        for d, x in tok.items()
    }
    best = sorted((d for d in score if score[d] > 0), key=lambda d: (-score[d], d))[:10]
    want = []
    for k, d in enumerate(best):
        hit = [s for s in re.split(r"(?<=[.!?])\s+", docs[d]) if re.search("|".join(words), s.lower())]
        want.append((d, k + 1, (hit[0] if hit else docs[d].split("\n")[0])[:200]))
    assert sorted((r.doc_id, r.rank, r.answer) for r in t8(spark, sf).collect()) == sorted(want)
