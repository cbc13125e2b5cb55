import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import balanced_packing as B
from loomstone.llm.packing import tokenizer_file

SCHEMA = "doc_id long, text string, start string, offset int"


def ids_of(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    return [np.array(e.ids + [B.END_ID], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, docs, seq_len=B.SEQ_LEN):
    """Each id lies in one piece, sequences have no gaps; gives padding and the number of pieces beyond one a document."""
    ids = {}
    for (doc, _), x in zip(docs, ids_of([t for _, t in docs])):
        ids.setdefault((doc, len(x)), []).append(x)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert by_doc.keys() == ids.keys()
    for key, pieces in by_doc.items():
        covered = np.zeros(key[1], int)
        for r in pieces:
            assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[key])
            covered[r.start : r.start + r.length] += 1
        assert (covered == len(ids[key])).all()
    padding = 0
    by = {}
    for r in rows:
        assert r.length > 0
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= seq_len
        padding += 0 if at & (at - 1) == 0 else seq_len - at
    return padding, len(rows) - len(docs)


def test_round_trip_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = B.op13_balanced_packing(spark, sf).collect()
    padding, cuts = check(rows, docs)
    assert padding == 0
    assert cuts < 1.3 * len({r.sequence_id for r in rows})


CASES = [None, "", "A<|endoftext|>B", "x " * 30_000, "😀 é, 12,5.", "word " * 9000, "same text", "same text"]


def test_edges(spark):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(1, "again"), (1, "again"), (None, "no id"), (None, None), (2**53 + 1, "large id")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    assert check(B.pack(df).collect(), docs)[0] == 0
    for seq_len, windows in ((8, 3), (64, 1), (100, 48)):
        padding, _ = check(B.pack(df, seq_len=seq_len, bucket_windows_=windows).collect(), docs, seq_len)
        assert padding == 0
    assert B.pack(df.limit(0)).count() == 0


def test_no_bucket_grows_with_repeated_rows(spark):
    docs = [(7, "the same row")] * 3000
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    rows = B.pack(df, seq_len=64, bucket_windows_=8).collect()
    assert check(rows, docs, 64)[0] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 12))
def test_differencing_uses_each_once(sizes, k):
    sets = B.differencing(sizes, k)
    assert sorted(itertools.chain(*sets)) == list(range(len(sizes))) and len(sets) <= k


def test_differencing_is_the_published_one():
    # two sets of 4, 5, 6, 7, 8: differences 8-7, 6-5, then 4-1, then 3-1: the sums differ by 2
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in s) for s in B.differencing([4, 5, 6, 7, 8], 2)) == [14, 16]
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 1000) for _ in range(600)]
    sums = [sum(sizes[i] for i in s) for s in B.differencing(sizes, 48)]
    assert max(sums) - min(sums) < 0.02 * sum(sizes) / 48


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40), st.integers(0, 300), st.sampled_from([1, 2, 7, 64]))
def test_buckets_fill_their_stretch(lengths, before, capacity):
    got = B.bucket_windows(lengths, before, capacity)
    covered = [np.zeros(n, int) for n in lengths]
    places = []
    for window, offset, parts in got:
        for row, at, n in parts:
            covered[row][at : at + n] += 1
            places.append((window * capacity + offset, n))
            offset += n
        assert offset <= capacity
    assert all((c == 1).all() for c in covered)
    at = before
    for p, n in sorted(places):
        assert p == at
        at += n
    assert at == before + sum(lengths)
