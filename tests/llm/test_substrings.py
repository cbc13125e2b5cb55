import hashlib
import random

from loomstone.llm import substrings as S

SCHEMA = "doc_id long, text string, g string"


def brute(docs, n=50):
    low = {}
    rows = [(d, (t or "").encode()) for d, t in docs]
    for d, b in rows:
        if d is not None:
            for p in range(len(b) - n + 1):
                s = b[p : p + n]
                low[s] = min(d, low.get(s, d))
    out = []
    for d, b in rows:
        gone = [False] * len(b)
        if d is not None:
            for p in range(len(b) - n + 1):
                if low[b[p : p + n]] < d:
                    gone[p : p + n] = [True] * n
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, crowd=S.CROWD):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    return sorted((tuple(r)[:5] for r in S.remove_repeats(df, crowd=crowd).collect()), key=str)


def make(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "of", "né", "ta", "in", "ou", "er", "x"]
    say = lambda k: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(k))
    passages = [say(rnd.randint(5, 30)) for _ in range(6)]
    docs = []
    for i in rnd.sample(range(1000), n):
        t = say(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice(passages) + say(rnd.randint(0, 4))
        docs.append((i, t))
    docs += [(2000, docs[0][1]), (1, docs[3][1]), (2001, docs[5][1][3:]), (2002, docs[5][1][:-2] + "zz")]
    return docs


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs = make(seed)
        assert run(spark, docs) == brute(docs)


def test_crowded_seeds(spark):
    rnd = random.Random(7)
    say = lambda k: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(k))
    line = " -- one line of forty-odd bytes that stands -- "
    docs = [(i, say(9) + line + rnd.choice(["", "which is it? ", "so it was said "]) + say(9)) for i in rnd.sample(range(9000), 600)]
    want = brute(docs)
    assert run(spark, docs, crowd=3) == want and run(spark, docs, crowd=10**6) == want and sum(r[2] for r in want) > 0
    for crowd in (0, 1, 2):
        docs = make(9 + crowd)
        assert run(spark, docs, crowd) == brute(docs)


def test_edges(spark):
    same = "0123456789" * 5
    docs = [(3, same), (2, same), (9, same[1:]), (4, "a" * 700), (5, "a" * 300 + "b"), (6, "ab" * 200), (7, "b" + "ab" * 90), (8, None), (10, ""), (None, same), (None, None), (2, same), (11, "é" * 25), (12, "é" * 26), (12, "other " * 20), (12, "other " * 19)]
    assert run(spark, docs) == run(spark, docs, crowd=0) == brute(docs)
    assert run(spark, []) == []


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in S.op9_substrings(spark, sf).collect()), key=str)
    assert got == brute(docs)
    assert sum(r[2] for r in got) > 0


def test_kept_bytes(spark):
    docs = make(5)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    for r in S.remove_repeats(df, keep_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
