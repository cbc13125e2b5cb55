"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule compares one measure of a document with a cutoff.  Cutoffs are chosen per stratum (the
language) from the labelled documents.  ``STEPS`` is a fixed path from lax to strict through the grids
of all rules; the hypothesis of a step says that all rules together, with their cutoffs up to it,
falsely reject ``risk`` or more of the good documents that the base rules pass.  The exact binomial
test is made step by step, and the stratum's cutoffs are those of the last step before the first that
it does not reject.  A fixed sequence needs no correction along the path.  Over strata the level is
divided by Holm's rule: the share of a stratum whose whole path is proven goes to the others.  So with
probability 1 - ``level`` the rules together falsely reject less than ``risk`` in every stratum.

A stratum with so few good labels that not even a path without one false rejection proves anything
(at risk 0.02 and four strata: fewer than 183) is pooled with the others of that kind.  If they are too few
together, the pool takes in the labels of all strata.  Its cutoffs hold for documents of pooled strata
and of languages without labels; the guarantee is for the pool as a whole.  Pooling looks at numbers of
labels only, never at outcomes, so it does not touch the level.  Without enough labels at all there is no
cutoff: only the fixed base rules apply.  ``choose_cutoffs`` reports what each stratum got.

Null text has no words (and so fails the base rules); null languages are one stratum; documents
without labels don't take part in the choice.  Repeated doc_ids are kept, a repeated label counts
once (the worse one).  Empty tables give empty results.  All columns of the input pass through
``filter_documents`` unchanged, whatever their names; otherwise they are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table, written

SPACE = r"[\x20\x09-\x0D]"
#: Rules and their grids from lax to strict; a document fails where its measure is above the cutoff.
RULES = {
    "symbols": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeats": (0.28, 0.25, 0.22, 0.2, 0.18, 0.15),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "long_words": (25.0, 20.0, 16.0, 13.0, 11.0, 10.0),
    "short_words": (-1.5, -2.0, -2.5, -3.0),
}
#: The path: every rule's first cutoff, then every rule's second, and so on (rule, place in its grid).
STEPS = tuple((r, i) for i in range(max(map(len, RULES.values()))) for r, grid in RULES.items() if i < len(grid))
WINDOW = 8
MOST_STRATA = 10_000  # up to so many rows the cutoffs are broadcast, beyond they are joined by shuffle


def _words_in_repeats(at: str) -> Column:
    """Words covered by windows that occur twice or more; ``at`` has ``struct<h, i>``, sorted, for each window."""
    same = lambda x, j: F.coalesce(F.get(F.col(at), j)["h"] == x["h"], F.lit(False))
    again = F.filter(at, lambda x, j: same(x, j - 1) | same(x, j + 1))
    return F.aggregate(
        F.array_sort(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n")),
        lambda a: a["n"],
    )


def measure(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row``, a struct of the input's columns (or those to keep), and its measures in ``_q``."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    out = documents.select(F.struct(*(keep or documents.columns)).alias("row"), F.col("text").alias("_t")).withColumn("_w", words)
    n = F.size("_w")
    # hash of the eight words from each start; slices stay within the array
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    out = out.withColumn("_h", windows)
    ranked = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_at", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked).otherwise(none))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_l", lines)
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    measured = F.struct(
        n.cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _words_in_repeats("_at").cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        capitals.cast("long").alias("n_capitals"),
    )
    # explode of one element: a boundary beyond which the optimiser does not copy these expressions
    return out.withColumn("_q", F.explode(F.array(measured))).select("row", "_q")


def base_failed(q: str = "_q") -> Column:
    c = F.col(q)
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def _value(rule: str, q: str = "_q") -> Column:
    c = F.col(q)
    per = lambda a, b: F.coalesce(c[a] / F.when(c[b] > 0, c[b]), F.lit(0.0))
    return {
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "long_words": per("word_chars", "n_words"),
        "short_words": -per("word_chars", "n_words"),
    }[rule]


def binomial_below(n: Column, k: Column, risk: float) -> Column:
    """Exact P(Bin(n, risk) <= k), summed in logarithms; 1 where k is above the mean."""
    first = n * math.log1p(-risk)
    odds = math.log(risk) - math.log1p(-risk)

    def step(a, i):
        term = a["t"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(a["s"], term)
        return F.struct(term.alias("t"), (high + F.log(F.exp(a["s"] - high) + F.exp(term - high))).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), step, lambda a: F.exp(a["s"]))
    return F.when(k > n * risk, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.1) -> DataFrame:
    """One row per labelled stratum and one (``pool``) for all others.

    ``_stratum`` (null for the pool), ``n`` good labels, ``pooled`` (whether its own were too few),
    ``steps`` proven, and ``_cut``, a struct with a cutoff (or null) for each rule.  ``measured`` comes
    from ``measure`` and keeps ``doc_id`` and ``lang``.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_y")).where("_y = 1").select("doc_id")
    failed = F.coalesce(*(F.when(_value(r) > RULES[r][i], F.lit(j)) for j, (r, i) in enumerate(STEPS)), F.lit(len(STEPS)))  # first step that rejects it
    held = measured.where(~base_failed()).select("row.doc_id", F.coalesce("row.lang", F.lit("")).alias("s"), failed.alias("at")).join(good, "doc_id")
    by = cut(held.groupBy("s", "at").agg(F.count(F.lit(1)).alias("n")))  # at most len(STEPS) + 1 rows a stratum
    sizes = by.groupBy("s").agg(F.sum("n").alias("n"))

    need = lambda m: F.ceil(F.log(F.lit(level) / m) / math.log1p(-risk))  # noqa: E731  fewest labels that prove anything
    strata = sizes.agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.crossJoin(strata).select("s", "n", (F.col("n") < need(F.col("m"))).alias("pooled"))  # strata is one row
    total = cut(sizes.agg(F.count_if(~F.col("pooled")).alias("own"), F.coalesce(F.sum(F.when(F.col("pooled"), F.col("n"))), F.lit(0)).alias("few")))
    m = F.col("own") + 1  # the pool is a stratum too
    everyone = F.col("few") < need(m)  # the pool takes in all labels
    by = by.join(sizes.drop("n"), "s").crossJoin(total)
    groups = by.select(F.explode(F.filter(F.array(F.when(~F.col("pooled"), F.struct(F.col("s").alias("s"))), F.when(F.col("pooled") | everyone, F.struct(F.lit(None).cast("string").alias("s")))), lambda x: x.isNotNull())).alias("g"), "at", "n")
    rejected = F.array(*(F.coalesce(F.sum(F.when(F.col("at") <= j, F.col("n"))), F.lit(0)) for j in range(len(STEPS))))
    paths = groups.groupBy("g.s").agg(F.sum("n").alias("n"), rejected.alias("k"))
    paths = cut(paths.withColumn("p", F.transform("k", lambda k: binomial_below(F.col("n"), k, risk))))

    # Holm: paths by the largest p-value of theirs; while the smallest is proven at its share, its share passes on
    worst = F.array_sort(F.collect_list(F.array_max("p")))
    proven = F.aggregate("w", F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda a, p: F.struct((a["k"] + (a["on"] & (p <= level / (F.size("w") - a["k"]))).cast("int")).alias("k"), (a["on"] & (p <= level / (F.size("w") - a["k"]))).alias("on")))
    share = paths.agg(worst.alias("w")).select((level / F.greatest(F.size("w") - proven["k"], F.lit(1))).alias("share"))
    passed = F.transform("p", lambda p: p <= F.col("share"))
    first_fail = F.array_position(passed, False).cast("int")
    steps = F.when(first_fail == 0, F.size("p")).otherwise(first_fail - 1)

    def strictest(rule: str) -> Column:
        own = [(j, i) for j, (r, i) in enumerate(STEPS) if r == rule]
        return F.coalesce(*(F.when(F.col("steps") > j, F.lit(RULES[rule][i])) for j, i in reversed(own)))

    chosen = paths.crossJoin(share).withColumn("steps", steps)  # share is one row
    return cut(chosen.select(F.col("s").alias("_stratum"), "n", F.col("s").isNull().alias("pooled"), "steps", F.struct(*(strictest(r).alias(r) for r in RULES)).alias("_cut")))


def apply_rules(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``_kept``: passes the base rules and every cutoff of its stratum, or of the pool."""
    own = cutoffs.where("_stratum is not null").select("_stratum", F.col("_cut").alias("_own"))
    own = F.broadcast(own) if cutoffs.count() <= MOST_STRATA else own
    pool = cutoffs.where("_stratum is null").agg(F.first("_cut").alias("_pool"))  # one row
    out = measured.withColumn("_stratum", F.coalesce("row.lang", F.lit(""))).join(own, "_stratum", "left").crossJoin(F.broadcast(pool))
    use = F.coalesce("_own", "_pool")
    fails = F.lit(False)
    for r in RULES:
        fails = fails | F.coalesce(_value(r) > use[r], F.lit(False))
    return out.select("row", "_q", (~base_failed() & ~fails).alias("_kept"))


def filter_documents(documents: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.1) -> DataFrame:
    """The rows of ``documents`` that are kept.  Rows are written once with their measures and read again."""
    measured = written(measure(documents))
    cutoffs = choose_cutoffs(measured, labels, risk, level)
    return apply_rules(measured, cutoffs).where("_kept").select("row.*")


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    measured = written(measure(table(spark, sf_dir, "documents"), ["doc_id", "lang"]))
    cutoffs = choose_cutoffs(measured, table(spark, sf_dir, "labels"))
    names = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return apply_rules(measured, cutoffs).select(
        "row.doc_id",
        F.col("_q.n_words").alias("n_words"),
        *(F.col(f"_q.{c}").alias(c) for c in names),
        base_failed().alias("base_failed"),
        F.col("_kept").alias("kept"),
    )
