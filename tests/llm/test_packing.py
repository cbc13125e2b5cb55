import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import packing as P

SCHEMA = "doc_id long, text string, start string"


def ids_of(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.tokenizer_file())
    return [np.array(e.ids + [0], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, docs, seq_len=2048):
    want = {}
    for (doc, _), ids in zip(docs, ids_of([t for _, t in docs])):
        for k, at in enumerate(range(0, len(ids), seq_len)):
            part = ids[at : at + seq_len].tobytes()
            want.setdefault((doc, k, at, len(part) // 4, zlib.crc32(part)), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= seq_len
    return len(by)


def test_round_trip_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = P.op5_packing(spark, sf).collect()
    n = check(rows, docs)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048)


CASES = [None, "", "A<|endoftext|>B <|STARTOFTEXT|>", "don't I'LL x,y, z,, . .. a. B, é, É. ÀB,\tq\x1cr s t", "İstanbul ΑΣ ﬁ é, 12,5. 3,", "word " * 9000, "😀,. \n\n,\n.", "it's, THE'S. 's"]


def test_edges(spark):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(1, "again"), (1, "again"), (None, "no id"), (2**53 + 1, "large id")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    check(P.pack(df).collect(), docs)
    check(P.pack(df, seq_len=7).collect(), docs, 7)
    assert P.pack(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30), st.integers(1, 9))
def test_plans_use_each_rank_once_and_overlap_nowhere(hist, groups):
    plan = P.make_plan(hist, 50, groups, 8)
    used = {}
    total = 0
    for length, (r, s, o) in plan.arrays().items():
        ends = np.append(r[1:], hist[length])
        assert r[0] == 0
        for a, b, first, off in zip(r, ends, s, o):
            for k in range(b - a):
                used.setdefault(first + k, []).append((off, length))
                total += 1
    assert total == sum(hist.values()) and len(used) == plan.sequences
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 50


def test_plan_size_does_not_grow_with_the_corpus():
    rnd = random.Random(1)
    hist = {x: rnd.randint(1, 30) for x in range(1, 2049)}
    runs = [sum(map(len, P.best_plan({x: n * k for x, n in hist.items()}, 2048).runs.values())) for k in (1, 1000)]
    assert runs[1] < 3 * runs[0]
    plan = P.best_plan({x: n * 1000 for x, n in hist.items()}, 2048)
    assert plan.sequences <= 1.02 * sum(x * n * 1000 for x, n in hist.items()) / 2048
