"""Values against their sources: equal to an alignment with the whole text."""

import random

import pytest

from loomstone.functions import grounding as G


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(value, text, k):
    spans = [(distance(value, text[s:e]), e, -s) for s in range(len(text) + 1) for e in range(s, len(text) + 1)]
    cost, e, s = min(spans)
    return (cost, -s, e) if cost <= k else None


@pytest.mark.parametrize("share", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_anchors_lose_no_span(share):
    rnd = random.Random(int(100 * share))
    for _ in range(120):
        letters = rnd.choice(["ab", "abcdef "])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 26)))
        a = rnd.randrange(len(text))
        value = list(text[a : a + rnd.randint(1, 10)])
        for _ in range(rnd.randint(0, 3)):
            p = rnd.randrange(len(value))
            value[p] = rnd.choice(["", "z", value[p] + "a"])
        value = "".join(value)
        if value:
            k = int((1 - share) * len(value) + 1e-9)
            assert G.align(value, text, k) == brute(value, text, k), (value, text, k)


@pytest.mark.parametrize("share", [0.6, 0.8, 0.9])
def test_counted_anchors_in_long_texts(share):
    """Equal to an alignment with the whole text, without any choice of stretches."""
    rnd = random.Random(int(1000 * share))
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    seen = 0
    for n in range(60):
        text = " ".join(rnd.choice(words) for _ in range(300))
        a = rnd.randrange(len(text) - 60)
        value = list(text[a : a + rnd.randint(20, 60)])
        for _ in range(rnd.randint(0, 12)):
            value[rnd.randrange(len(value))] = rnd.choice(["", "z", "ab"])
        value = "".join(value)
        if n % 4 == 0:
            value = " ".join(rnd.choice(words) for _ in range(6))
        k = int((1 - share) * len(value) + 1e-9)
        v, t = G.codes(value), G.codes(text)
        row = G.ends(v, t)
        e = int(row.argmin())
        want = (int(row[e]), G.start_of(v, t[:e], int(row[e])), e) if row[e] <= k else None
        assert G.align(value, text, k) == want
        seen += want is not None
    assert 5 < seen < 60


def test_folding_letter_by_letter():
    rnd = random.Random(3)
    letters = "aZ9 _-.'éÉßẞΣσİı中٣²\n"
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        out, at, gap = [], [], False
        for i, c in enumerate(text):
            if not c.isalnum():
                gap = bool(out)
                continue
            if gap:
                out.append(" "), at.append(i - 1)
            gap = False
            out.append(c.lower() if len(c.lower()) == 1 else c), at.append(i)
        assert G.fold(text) == ("".join(out), at)


def test_kinds(spark):
    text = "Minutes:  Dr. Ana Müller moves to Lisbon on 14 March 2031, with a budget of 25,000 euros."
    claims = [
        (1, "s", "ana müller", "exact"), (2, "s", "LISBON on 14 march", "exact"), (3, "s", "Dr Anna Mueller moves to Lisbon", "reworded"),
        (4, "s", "moves to Lisbon on 15 March 2031", "altered"), (5, "s", "lives in Reykjavik with two cats", "invented"), (6, "s", None, "invented"),
        (7, "s", " - ", "invented"), (8, "gone", "Lisbon", "invented"), (9, None, "Lisbon", "invented"), (10, "empty", "x", "invented"), (11, "long", "needle in it", "exact"),
    ]
    c = spark.createDataFrame([(*x[:3], "more") for x in claims], "claim_id long, source_id string, value string, text string")
    s = spark.createDataFrame([("s", text, "more"), ("empty", None, None), ("long", "word " * 100_000 + "needle in it" + " word" * 100_000, None), (None, "Lisbon", None)], "source_id string, text string, value string")
    got = {r.claim_id: r for r in G.ground(c, s).collect()}
    assert {k: r.kind for k, r in got.items()} == {x[0]: x[3] for x in claims}
    assert text[got[1].start : got[1].end] == "Ana Müller" and text[got[2].start : got[2].end] == "Lisbon on 14 March"
    assert text[got[4].start : got[4].end] == "moves to Lisbon on 14 March 2031" and not got[4].kept and got[3].kept
    assert got[5].start is None and G.ground(c.limit(0), s).count() == 0 and G.ground(c, s.limit(0)).where("kept").count() == 0


def test_repeated_claims_and_sources(spark):
    c = spark.createDataFrame([(1, 1, "red fox")] * 2, "claim_id long, source_id long, value string")
    s = spark.createDataFrame([(1, "a red fox"), (1, "a blue whale")], "source_id long, text string")
    assert sorted(r.kind for r in G.ground(c, s).collect()) == ["exact", "exact", "invented", "invented"]
    with pytest.raises(ValueError):
        G.ground(c, s, 0)


def test_table(spark, sf):
    from loomstone.plans.catalog import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["f50_grounded"](spark, sf).collect()
    assert len(rows) == 3 * len(docs)
    for r in rows:
        d, how = r.claim_id.split(":")
        value = G.fold(" ".join(docs[int(d)].split()[5:13]))[0]
        if how == "same" and value:
            assert r.kind == "exact" and G.fold(docs[int(d)][r.start : r.end])[0] == value
        if how == "less" and len(value) >= 20:
            assert r.kept or any(c.isdigit() for c in value)
