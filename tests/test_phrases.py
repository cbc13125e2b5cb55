"""Many phrases in one pass equal a search for each."""

import random
import re

import pytest

from loomstone.functions import phrases as P


def brute(texts, phrases, whole, fold):
    out = []
    for k, t in texts:
        t = "" if t is None else P.folded(t) if fold else t
        for c, p in set(phrases):
            p = P.folded(p) if fold else p
            for m in re.finditer(f"(?={re.escape(p)})", t) if p else ():
                s, e = m.start(), m.start() + len(p)
                if not whole or not (re.match(r"[\w']", t[s - 1 : s]) or re.match(r"[\w']", t[e : e + 1])):
                    out.append((k, c, p, s))
    return sorted(set(out))


@pytest.mark.parametrize("whole, fold", [(True, True), (False, True), (True, False), (False, False)])
def test_thousands_of_overlapping_phrases(spark, whole, fold):
    rnd = random.Random(4)
    vocab = ["a", "b", "ab", "ba", "aab", "don't", "don", "Über", "日本", "c_d", "x-y"]
    say = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "", ", "]) for _ in range(n))
    phrases = [(rnd.choice("xyz"), say(rnd.randint(1, 4)).strip()) for _ in range(3000)] + [("x", ""), ("y", "ab"), ("x", "ab")]
    texts = [(k, say(rnd.randint(0, 60))) for k in range(60)] + [(100, None), (101, ""), (102, "ab")]
    got = P.find_phrases(spark.createDataFrame(texts, "id long, text string"), "text", phrases, whole=whole, fold=fold)
    assert sorted(map(tuple, got.collect())) == brute(texts, phrases, whole, fold)


def test_support_counts_a_turn_once(spark):
    phrases = [("thanks", "thank you"), ("thanks", "thanks"), ("rule", "from now on")]
    turns = [("s1", 1, "Thank you, thanks!"), ("s1", 1, "thanks again"), ("s2", 4, "THANK  YOU"), ("s2", 5, "from now on"), ("s3", 1, "thanksgiving"), (None, None, None)]
    out = P.mined(spark.createDataFrame(turns, "session string, turn long, text string"), phrases).collect()
    assert [tuple(r) for r in out] == [("thanks", 2, 2, 0.72)]
    with pytest.raises(ValueError):
        P.mined(spark.createDataFrame(turns, "session string, turn long, text string"), phrases, 0)


def test_no_phrases_no_rows_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert P.find_phrases(d, "text", []).count() == 0
    assert P.find_phrases(d.limit(0), "text", [("x", "a")]).count() == 0
    with pytest.raises(ValueError):
        P.find_phrases(d.withColumnRenamed("id", "_start"), "text", [("x", "a")])
