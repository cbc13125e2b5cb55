"""Rules over texts against brute force and against known readings."""

import re

import pytest
from pyspark.sql import functions as F

from loomstone.functions import language as L


def pieces(text, size, level, sep, out):
    text = text.strip()
    if not text:
        return
    if len(text) <= size:
        out.append((sep, text))
        return
    if level == len(L.LEVELS):
        out.extend((sep if i == 0 else "", text[i : i + size]) for i in range(0, len(text), size))
        return
    rx, own = L.LEVELS[level]
    for i, part in enumerate(p for p in re.split(rx, text, flags=re.A) if p.strip()):
        pieces(part, size, level + 1, sep if i == 0 else own, out)


def brute(text, size):
    found, out = [], []
    pieces(text or "", size, 0, "", found)
    for sep, p in found:
        if out and len(out[-1]) + len(sep) + len(p) <= size:
            out[-1] += sep + p
        else:
            out.append(p)
    return out


def test_passages_match_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()][:80]
    texts += ["", "x" * 2500, "one two. three\nfour\n\nfive six! " * 60, "word " * 700]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for size in (900, 40):
        for r in df.select("i", L.passages(F.col("text"), size).alias("p")).collect():
            assert r.p == brute(texts[r.i], size), (r.i, size)


def test_excerpts_are_lossless(spark):
    texts = ["a. b! c\n" * 500, "x" * 5000, "", "no end here " * 300, "…. \n\n.!?"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", L.excerpts(F.col("text"), 100).alias("c")).collect():
        assert "".join(r.c) == r.text and all(len(x) <= 100 for x in r.c)


@pytest.mark.parametrize(
    "text, lo, hi",
    [
        ("on 2024-02-30", None, None), ("on 2024-02-29", "2024-02-29", "2024-02-29"), ("Sept. 9, 2023", "2023-09-09", "2023-09-09"), ("9 september 2023", "2023-09-09", "2023-09-09"),
        ("February 2024", "2024-02-01", "2024-02-29"), ("in 2019", "2019-01-01", "2019-12-31"), ("yesterday", "2024-03-30", "2024-03-30"), ("one month ago", "2024-02-29", "2024-02-29"),
        ("twelve days ago", "2024-03-19", "2024-03-19"), ("this week", "2024-03-25", "2024-03-31"), ("last week", "2024-03-18", "2024-03-24"), ("last month", "2024-02-01", "2024-02-29"),
        ("this month", "2024-03-01", "2024-03-31"), ("last year", "2023-01-01", "2023-12-31"), ("soon", None, None),
    ],
)
def test_time_windows(spark, text, lo, hi):
    w = spark.range(1).select(L.time_window(F.lit(text), F.lit("2024-03-31").cast("date")).alias("w")).first().w
    assert (w and w.lo and str(w.lo), w and w.hi and str(w.hi)) == (lo, hi)


def test_criticality_and_norms(spark):
    cases = [
        ("She has an allergy and a contract.", "critical", "safety"), ("Sign the contract.", "high", "legal"), ("Never call me at night.", "high", "boundary"),
        ("I don't like cilantro.", "normal", ""), ("Do not ask?", "normal", ""), ("My insulin and my password", "critical", "medical"), (None, "normal", ""),
    ]
    df = spark.createDataFrame(cases, "text string, level string, category string")
    for r in df.select("*", L.criticality(F.col("text")).alias("c")).collect():
        assert (r.c.level, r.c.category) == (r.level, r.category), r.text


def test_facts(spark):
    text = "My name is Ann Lee. I live in Bern. I like tea. Do I like milk? If I moved I would like rain. My dog is called Rex."
    got = L.facts_of(spark.createDataFrame([(1, text)], "c int, text string")).collect()
    assert sorted((r.predicate, r.value) for r in got) == [("lives_in", "Bern"), ("name", "Ann Lee"), ("pet", "Rex"), ("preference", "tea")]
