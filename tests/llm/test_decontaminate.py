import itertools
import math
import random
import re

import numpy as np
import pytest

from loomstone.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def tokens(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(docs, items, least=12, share=0.75):
    """Every alignment of every item, without seeds; stretches as the operator defines them."""
    out = set()
    for d, t in docs:
        w = tokens(t)
        for i, x in items:
            v = tokens(x)
            for shift in range(-len(v) + 1, len(w)):
                pairs = [(w[shift + k], v[k]) for k in range(len(v)) if 0 <= shift + k < len(w)]
                same = [a == b for a, b in pairs]
                if sum(same) < 5 and len(v) >= 9:
                    continue
                best, cur, s0, span = 0, 0, 0, (0, 0)
                for k, m in enumerate(same):
                    cur += 1 if m else -2
                    if cur <= 0:
                        cur, s0 = 0, k + 1
                    elif cur > best:
                        best, span = cur, (s0, k + 1)
                if sum(same) >= share * len(same):
                    span = (0, len(same))
                n = span[1] - span[0]
                if n and n >= min(least, len(v)) and sum(same[span[0] : span[1]]) >= share * n:
                    out.add((d, i))
    return out


def make(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, say(rnd.randint(10, 40))) for k in range(20)] + [(50, "only three words"), (51, None), (52, ""), (53, "Seven little words in one short item")]
    docs = []
    for k in range(120):
        body = say(60)
        if k % 3 == 0:
            w = items[k % 20][1].split()
            for _ in range(k % 4):
                w[rnd.randrange(len(w))] = "changed"
            body += ". " + " ".join(w).title() + ", " + say(20)
        docs.append((k, body))
    docs += [(200, "and Only three, WORDS here"), (201, None), (202, ""), (203, "x " * 50000), (204, items[0][1] + " " + items[1][1]), (205, "seven little words in one short item")]
    return docs, items


def test_finds_what_brute_force_finds(spark):
    docs, items = make()
    d = spark.createDataFrame([(*x, "y") for x in docs], DOCS)
    b = spark.createDataFrame([(*x, "y") for x in items], ITEMS)
    got = {(r.doc_id, r.item_id) for r in D.find(d, b).collect()}
    want = brute([x for x in docs if x[0] != 203], items)
    assert got <= want
    assert len(want - got) <= 0.01 * len(want)
    assert (200, 50) in got and (204, 0) in got and (204, 1) in got and (205, 53) in got
    left = {r.doc_id for r in D.drop(d, b).collect()}
    assert left == {x for x, _ in docs} - {x for x, _ in got}


@pytest.mark.parametrize("n, least", [(9, 0.85), (10, 1), (11, 1), (12, 1), (13, 1), (14, 1), (15, 1), (16, 0.99), (20, 0.99), (30, 0.99), (60, 0.99)])
def test_share_of_placements_that_the_masks_hit(n, least):
    """Changes of a quarter of ``n`` words between agreeing ends: all placements, or 5,000 of them."""
    rnd, inner, changes = random.Random(n), range(1, n - 1), n // 4
    few = math.comb(n - 2, changes) <= 5000
    placements = list(itertools.combinations(inner, changes)) if few else [rnd.sample(inner, changes) for _ in range(5000)]
    hit = 0
    for changed in placements:
        same = [k not in changed for k in range(n)]
        hit += any(all(same[s + k] for k, c in enumerate(m) if c == "1") for m in D.MASKS for s in range(n - len(m) + 1))
    assert hit >= least * len(placements)


def test_every_document_at_the_bound_is_found(spark):
    item = [f"word{k}" for k in range(12)]
    docs = []
    for k, changed in enumerate(itertools.combinations(range(1, 11), 3)):
        docs.append((k, " ".join(["before", *("other" if j in changed else w for j, w in enumerate(item)), "after"]), None))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(item), None)], ITEMS)
    assert {(r.doc_id, r.n_words, r.n_same) for r in D.find(d, b).collect()} == {(k, 12, 9) for k in range(len(docs))}
    assert D.drop(d, b).count() == 0


def every_stretch(same, share):
    """The greatest length of a stretch between agreeing words of which the share agrees."""
    at = [k for k, x in enumerate(same) if x]
    return max((e - s + 1 for s in at for e in at if e >= s and sum(same[s : e + 1]) >= share * (e - s + 1)), default=0)


def test_longest_stretch_is_the_brute_force_one():
    rnd = random.Random(8)
    for _ in range(500):
        same = [rnd.random() < rnd.choice([0.5, 0.7, 0.8]) for _ in range(rnd.randint(1, 40))]
        s, e = D.longest(np.array(same), 0.75)
        assert e - s == every_stretch(same, 0.75) and (s == e or same[s] and same[e - 1])


def test_finds_partial_quotations_with_clustered_changes(spark):
    rnd = random.Random(9)
    items = [(k, " ".join(f"v{k}x{n}" for n in range(40)), None) for k in range(30)]
    docs, want = [], set()
    for k, text, _ in items:
        w = text.split()[k % 20 : k % 20 + 20]
        c = rnd.randint(8, 9)
        w[c : c + 4] = ["changed"] * 4  # 16 of 20 agree
        docs.append((k, "some words before it " + " ".join(w) + " and some after it", None))
        want.add((k, k))
        docs.append((100 + k, "only nine words " + " ".join(text.split()[5:14]) + " of the item", None))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = D.find(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all((r.first_word, r.n_words, r.n_same) == (4, 20, 16) for r in found)
    assert {r.doc_id for r in D.drop(d, b).collect()} == {100 + k for k in range(30)}


def test_a_full_bitmap_gives_the_same(spark):
    docs, items = make(4)
    d, b = spark.createDataFrame([(*x, "y") for x in docs], DOCS), spark.createDataFrame([(*x, "y") for x in items], ITEMS)
    whole = sorted(map(tuple, D.find(d, b).collect()))
    old, D.FILTER_BITS = D.FILTER_BITS, 8  # most windows pass, so the join decides
    try:
        assert sorted(map(tuple, D.find(d, b).collect())) == whole
    finally:
        D.FILTER_BITS = old


def test_seeds_that_most_documents_and_items_share(spark):
    line = " ".join(f"licence{n}" for n in range(14))
    docs = [(k, f"{line} and then document {k}", None) for k in range(300)] + [(999, "something else", None)]
    items = [(k, f"question {k} {line}", None) for k in range(20)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert {(r.doc_id, r.item_id) for r in D.find(d, b).collect()} == {(x, y) for x in range(300) for y in range(20)}
    assert [r.doc_id for r in D.drop(d, b).collect()] == [999]


def test_items_of_a_word_or_two_match_nothing(spark):
    d = spark.createDataFrame([(1, "Paris is large", None), (2, "three little words here", None)], DOCS)
    b = spark.createDataFrame([(1, "Paris", None), (2, "is large", None), (3, "Three little words", None)], ITEMS)
    assert [(r.doc_id, r.item_id) for r in D.find(d, b).collect()] == [(2, 3)]


def test_clashing_columns(spark):
    names = ["row", "key", "h", "at", "n", "words", "item", "shift"]
    d = spark.createDataFrame([(2**53 + 1, "one two three four", *names), (2, "clean", *names)], f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    b = spark.createDataFrame([(1, "one two three four", None)], ITEMS)
    out = D.drop(d, b)
    assert out.columns == d.columns and [tuple(r) for r in out.collect()] == [(2, "clean", *names)]
    assert D.find(d, b).first().doc_id == 2**53 + 1


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in D.op7_decontaminate(spark, sf).collect()}
    whole = {(d, i) for d, t in docs for i, x in items if " ".join(tokens(x)) in " ".join(tokens(t))}
    assert whole <= got


def test_nulls_repeats_and_empty(spark):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", None), (None, None, None)], ITEMS)
    d = spark.createDataFrame([(None, "one two three four five six seven eight nine ten", None)] * 2 + [(1, "clean", "z")], DOCS)
    assert [r.doc_id for r in D.find(d, b).collect()] == [None, None]
    assert [tuple(r) for r in D.drop(d, b).collect()] == [(1, "clean", "z")]
    assert D.find(d.limit(0), b).count() == 0 and D.find(d, b.limit(0)).count() == 0 and D.drop(d, b.limit(0)).count() == 3
