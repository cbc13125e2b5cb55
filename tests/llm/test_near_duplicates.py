import random

from loomstone.llm import near_duplicates as N
from loomstone.llm.graph import components

SCHEMA = "doc_id long, text string, class_id string"


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {d: 0 for d, _ in docs}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, find(d), links[d]) for d in root)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    return sorted((r.doc_id, r.class_id, r.n_links) for r in N.join_near(df).collect())


def make(seed, groups=12):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    line = " ".join(rnd.choice(vocab) for _ in range(12))
    docs, i = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice((4, 9, 60, 150)))]
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append((i * 7 % 1009, line + " " + "  ".join(w) if rnd.random() < 0.3 else " ".join(w)))
            i += 1
    return docs + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "one\ttwo"), (2005, "x " * 20000)]


def test_matches_brute_force(spark):
    docs = make(1) + [(d + 3000, t) for d, t in make(2)]
    assert run(spark, docs) == brute(docs)


def test_blocks_of_large_groups(spark):
    docs = [(d, t) for d, t in make(3, 30)]
    whole = brute(docs)
    old, N.BLOCK = N.BLOCK, 3
    try:
        assert run(spark, docs) == whole
    finally:
        N.BLOCK = old


def test_one_group_of_most_documents(spark):
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*base[: 10 + k % 40], f"x{k % 90}", *base[11 + k % 40 :]])) for k in range(240)] + [(1000 + k, " ".join(rnd.choices(base, k=30))) for k in range(20)]
    assert run(spark, docs) == brute(docs)


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in N.op2_near_duplicates(spark, sf).collect()) == brute(docs)


def test_keep_one_nulls_and_repeats(spark):
    t = "a b c d e f g h"
    docs = [(5, t), (3, t), (3, t), (None, t), (9, "other words that are here"), (9, "and yet another text of it")]
    df = spark.createDataFrame([(d, x, "x") for d, x in docs], SCHEMA)
    out = N.keep_one(df)
    assert out.columns == ["doc_id", "text", "class_id"]
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 3, 3, 9, 9]
    assert N.join_near(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_pruning_bounds():
    from math import comb

    for k, m in enumerate(N.fewest_matches()):
        n = (k + 1) * N.STEP
        tail = lambda m: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))  # noqa: E731,B023
        assert tail(m) >= N.TOLERANCE > tail(m - 1)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    star = [(5000, x) for x in range(5001, 9000)] + [(9000 + x, 9001 + x) for x in range(9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {x: 5000 if x < 9000 else 9000 for e in star for x in e}
