import math
import re

import pytest

from loomstone.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, n_words string"
LABELS = "doc_id long, quality int, toxic int"


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


CASES = [None, "", "   \n\t", "a b c d e f g h " * 5, "x\x1cy z é|é\n\x0b<b>\n<b>\n\n", "q " * 30000, " ".join(map(str, range(100))) + " 5 6 7 8 9 10 11 12 13", "w" * 100000]


def test_measures_match_brute_force(spark, sf):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(CASES)], SCHEMA)
    for r in Q.measure(df).collect():
        q = r._q
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute(CASES[r.row.doc_id]), r.row.doc_id
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op8_quality_rules(spark, sf).collect():
        n = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_binomial(spark):
    from math import comb

    for n, k in ((50, 0), (500, 1), (2000, 7), (300, 2)):
        want = sum(comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1)) if k <= n * 0.005 else 1.0
        got = spark.range(1).select(Q.binomial_below(Q.F.lit(n), Q.F.lit(k), 0.005).alias("p")).first().p
        assert got == pytest.approx(want, rel=1e-9)


def values(t):
    n, chars, symbols, dup, again = brute(t)
    lines = len([x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)])
    caps = sum("A" <= c <= "Z" for c in t or "")
    d = lambda a, b: a / b if b else 0.0
    return {"symbols": d(symbols, chars), "dup_lines": d(dup, lines), "repeats": d(again, n), "capitals": d(caps, chars), "long_words": d(chars, n), "short_words": -d(chars, n)}


def brute_kept(docs, labels, risk, level):
    """``{row: kept}`` by exact sums in Python, and the number of proven steps of each stratum."""
    good = {}
    for d, y, _ in labels:
        if d is not None:
            good[d] = min(y, good.get(d, 1))
    ok = lambda t: not (brute(t)[0] < 20 or 100 * brute(t)[4] > 30 * brute(t)[0])
    held = {}
    for d, t, lang in docs:
        if good.get(d) == 1 and ok(t):
            v = values(t)
            held.setdefault(lang or "", []).append(next((j for j, (r, i) in enumerate(Q.STEPS) if v[r] > Q.RULES[r][i]), len(Q.STEPS)))
    need = lambda m: math.ceil(math.log(level / m) / math.log(1 - risk))
    few = {s for s, x in held.items() if len(x) < need(len(held))}
    paths = {s: x for s, x in held.items() if s not in few}
    pool = [j for s in few for j in held[s]]
    if len(pool) < need(len(paths) + 1):
        pool = [j for x in held.values() for j in x]
    if pool:
        paths[None] = pool

    def p(x, j):
        n, k = len(x), sum(y <= j for y in x)
        return 1.0 if k > n * risk else sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))

    ps = {s: [p(x, j) for j in range(len(Q.STEPS))] for s, x in paths.items()}
    m = len(ps)
    for w in sorted(max(x) for x in ps.values()):
        if w > level / m:
            break
        m -= 1
    share = level / max(m, 1)
    steps = {s: next((j for j, x in enumerate(v) if x > share), len(v)) for s, v in ps.items()}
    out = []
    for d, t, lang in docs:
        v, n = values(t), steps.get(lang or "", steps.get(None, 0))
        out.append((d, ok(t) and not any(v[r] > Q.RULES[r][i] for r, i in Q.STEPS[:n])))
    return out, steps


@pytest.mark.parametrize("risk, level", [(0.02, 0.1), (0.05, 0.1), (0.1, 0.2)])
def test_kept_matches_a_brute_force_chooser(spark, risk, level):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{d}/labels.parquet")
    want, steps = brute_kept(docs, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()], risk, level)
    measured = Q.cut(Q.measure(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id", "lang"]))
    cuts = Q.choose_cutoffs(measured, labels, risk, level)
    assert {r._stratum: r.steps for r in cuts.collect()} == steps
    assert steps[None] > 0  # every language has a verdict
    got = [(r.row.doc_id, r._kept) for r in Q.apply_rules(measured, cuts).collect()]
    assert sorted(got) == sorted(want)


def prose(i):
    return " ".join(f"word{(i * 31 + j * 7) % 997}" for j in range(60))


def test_cutoffs_follow_the_labels(spark):
    good = [(i, prose(i), "en", None) for i in range(3000)]
    bad = [(10000 + i, " ".join(f"{w}$$$" for w in prose(i).split()), "en", None) for i in range(50)]
    rare = [(20000 + i, " ".join(f"{w}$$$" for w in prose(i).split()), "xx", None) for i in range(5)]
    docs = spark.createDataFrame(good + bad + rare, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(20000, 1, 0), (20000, 1, 1), (None, 1, None)], LABELS)
    kept = {r.doc_id for r in Q.filter_documents(docs, labels).collect()}
    assert len([i for i in kept if i < 3000]) >= 2985
    assert not [i for i in kept if 10000 <= i < 20000]
    assert not [i for i in kept if i >= 20000]  # a language without labels takes the pool's cutoffs
    assert Q.filter_documents(docs, labels.limit(0)).count() == 3055


def test_nulls_repeats_and_empty(spark):
    rows = [(1, prose(1), None, None), (1, prose(1), None, None), (None, None, None, None)]
    labels = spark.createDataFrame([], LABELS)
    out = Q.filter_documents(spark.createDataFrame(rows, SCHEMA), labels)
    assert out.count() == 2 and out.columns == ["doc_id", "text", "lang", "n_words"]
    assert Q.filter_documents(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_clashing_columns(spark):
    names = ["row", "_q", "_t", "_w", "_h", "_at", "_l", "_stratum", "_kept", "_cut", "n_words"]
    df = spark.createDataFrame([(i, prose(i), "en", *names) for i in range(300)], f"doc_id long, text string, lang string, {', '.join(f'{c} string' for c in names)}")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], LABELS)
    out = Q.filter_documents(df, labels)
    assert out.columns == df.columns and out.count() == 300
    assert out.first()._q == "_q"
