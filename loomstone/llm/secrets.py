"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions only.

Base patterns propose the spans that are always kept.  The battery looks at the other long runs of
encoding characters, and at what is left of a run beside a base span.  For each it infers an encoding
(digits, hex, base32, base36, letters of one case, or base64) and tests the hypothesis that the run is written
text against the alternative that it is drawn uniformly, by the tests that say something about it:

* chi-squared statistic of its symbols against the encoding's alphabet.  Text concentrates on few
  symbols, so under the hypothesis the statistic is large; its mean and variance follow from the
  collision rates of text, ``LETTERS`` (digits, for hex);
* runs test over the classes of symbols (lower case, capitals, digits): text changes its class at
  ``CHANGES`` of its places.  Separators and the capitals of camel-case names are no changes.  It says
  nothing about letters of one case;
* runs test over vowels and consonants: text changes between them at ``VOWELS`` of its places or
  more, random letters at a third.  It says nothing about hex.

Their p-values are combined by Stouffer's rule, the classes with double weight.  A second hypothesis is that the run is structured, as
counters and keyboard rows are: a correlation of neighbouring symbols of ``SERIAL`` or more.  A run is
random only if both hypotheses are rejected, so its p-value is the larger of the two.

Whether a run can be a uniform draw at all is a chi-squared test of its letters and digits over their own
alphabet: 10 digits, 16 of hex, 26 letters of one case, 32, 36, 52 letters of both, or 62 (``+/_-`` also
separate, so they don't count).  Where it rejects uniformity at ``UNIFORM``, the run's p-value is 1: it is
neither text nor random, as lines of few symbols or encoded text are.  Runs of digits are tested like all
others; up to 60 digits no test tells them from dates and counters at any useful rate.

Discoveries are made by the Benjamini-Hochberg rule within strata of length, so that many short runs, which no test can
tell apart, don't loosen the threshold for long ones.  Its counts cover every candidate of the
table: p-values are put into bins, and only bin counts (at most 12 strata x 401 bins) leave Spark.

Null text is the empty text.  Null and repeated doc_ids are kept: one row out for one row in.
An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, span_text, spans

#: Fixed patterns of the contract. Each has a form with the same matches that Java's engine scans in linear time.
ASSIGN = r"""(?i)(?=[pstak])(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?:(?<![0-9a-f])|\G)[0-9a-f]{24,}+"
RUN = r"(?:(?<![A-Za-z0-9+/_-])|\G)[A-Za-z0-9+/_-]{20,}+={0,2}"  # '=' ends a run but may stand before one: name=value
HUMPS = "^(?:[a-z]++|[A-Z][a-z]++|[0-9]++)++$"  # camel case: every capital begins a word
KINDS = ("assign", "access", "hex")

LEAST = 20  # characters of a candidate
#: Fixed values. Sums of squares and cubes of the symbols' shares: of English letters, and of ten digits as dates and counters have them.
LETTERS, DIGITS = (0.0655, 0.0055), (0.13, 0.022)
CHANGES = 0.12  # changes of class a place, in names of files and programs
VOWELS = 0.55  # changes between vowels and consonants a place: German compounds have the fewest
UNIFORM = 1e-6  # level at which a run isn't a uniform draw from its alphabet
SERIAL = 0.85  # lag-1 correlation of 20 symbols that count up

BINS, STEP = 400, 0.1  # bins of -log10(p): 0 to 40
STRATA = 12
BROADCAST_SPANS = 500_000  # up to so many spans (some 20 MB) texts find theirs by broadcast, beyond by shuffle


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), within 2 % over z >= 0 and so far into the tail."""
    a = F.abs(z)
    q = F.exp(-a * a / 2) / F.sqrt(F.lit(6.283185307179586)) * 2 / (a + F.sqrt(a * a + 2.546479089470325))
    q = F.least(q, F.lit(0.5))
    return F.when(z >= 0, q).otherwise(1 - q)


def _fewer(n: Column, seen: Column, rate: float) -> Column:
    """Standard score of fewer changes than text has in ``n`` places."""
    return F.when(n > 4, (n * rate - seen - 0.5) / F.sqrt(n * rate * (1 - rate))).otherwise(F.lit(0.0))


def _squares(m: Column) -> Column:
    """Sum of squares of the counts of a string's symbols."""
    kinds = F.array_distinct(F.filter(F.split(m, ""), lambda c: c != ""))
    return F.aggregate(F.transform(kinds, lambda c: F.pow(F.length(m) - F.length(F.replace(m, c, F.lit(""))), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def _uniformity(body: Column) -> Column:
    """P-value of the chi-squared test that letters and digits are drawn uniformly from their alphabet (Wilson and Hilferty's cube root)."""
    size = (
        F.when(body.rlike("^[0-9]+$"), 10.0)
        .when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16.0)
        .when(body.rlike("^(?:[a-z]+|[A-Z]+)$"), 26.0)
        .when(body.rlike("^[A-Z2-7]+$"), 32.0)
        .when(body.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), 36.0)
        .when(body.rlike("^[A-Za-z]+$"), 52.0)
        .otherwise(62.0)
    )
    n = F.length(body).cast("double")
    chi = _squares(body) * size / F.when(n > 0, n) - n
    spread = 2 / (9 * (size - 1))
    return F.coalesce(_upper_tail((F.cbrt(F.greatest(chi, F.lit(0.0)) / (size - 1)) - (1 - spread)) / F.sqrt(spread)), F.lit(1.0))


def _battery(m: Column) -> Column:
    """Struct of p-value, alphabet and stratum for one candidate run."""
    n = F.length(m).cast("double")
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    size = (
        F.when(m.rlike("^[0-9]+$"), 10)
        .when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(m.rlike("^(?:[a-z]+|[A-Z]+)$"), 26)
        .when(m.rlike("^[A-Z2-7]+=*$"), 32)
        .when(m.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), 36)
        .otherwise(64)
    )
    digits = ~m.rlike("[A-Za-z]")
    hexed, one_case = (size == 16) | digits, (size == 26) | digits
    squares = _squares(m)
    # sum of squares of counts, which the chi-squared statistic is linear in: mean and variance in text
    k2, k3 = F.when(hexed, DIGITS[0]).otherwise(LETTERS[0]), F.when(hexed, DIGITS[1]).otherwise(LETTERS[1])
    pairs = n * (n - 1)
    sd = F.sqrt(2 * pairs * k2 * (1 - k2) + 4 * pairs * F.greatest(n - 2, F.lit(0.0)) * (k3 - k2 * k2))
    z_chi = (n + pairs * k2 - squares) / sd

    body = F.regexp_replace(m, "[^A-Za-z0-9]", "")
    classes = F.when(body.rlike(HUMPS), F.lower(body)).otherwise(body)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(classes, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    places = F.length(classes) - 1.0
    changes = F.length(F.regexp_replace(classes, r"(l+|u+|d+)", "x")) - 1.0
    z_class = F.when(places > 4, (changes - 0.5 - places * CHANGES) / F.sqrt(places * CHANGES * (1 - CHANGES))).otherwise(F.lit(0.0))

    letters = F.regexp_replace(F.lower(F.regexp_replace(m, "[^A-Za-z]", "")), "[aeiouy]", "0")
    letters = F.regexp_replace(letters, "[a-z]", "1")
    z_vowel = _fewer(F.length(letters) - 1.0, F.length(F.regexp_replace(letters, "(0+|1+)", "x")) - 1.0, VOWELS)

    w_class, w_vowel = F.when(one_case, 0.0).otherwise(F.lit(2.0)), F.when(hexed, 0.0).otherwise(F.lit(1.0))
    p_text = _upper_tail((z_chi + w_class * z_class + w_vowel * z_vowel) / F.sqrt(1 + w_class * w_class + w_vowel * w_vowel))

    codes = F.transform(chars, lambda c: F.ascii(F.lower(c)).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.transform(codes, lambda x: x - mean)
    var = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
    lag = F.aggregate(F.zip_with(F.slice(dev, F.lit(1), F.size(dev) - 1), F.slice(dev, F.lit(2), F.size(dev) - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rho = F.coalesce(F.abs(lag / F.when(var > 0, var)), F.lit(1.0))
    p_serial = _upper_tail((SERIAL - rho) * F.sqrt(n / (1 - SERIAL * SERIAL)))
    p = F.when(_uniformity(body) < UNIFORM, 1.0).otherwise(F.greatest(p_text, p_serial))
    return F.struct(p.alias("p"), size.alias("alphabet"), F.least(F.floor(F.log2(n)).cast("int"), F.lit(STRATA)).alias("stratum"))


def _beside(run: Column, base: Column) -> Column:
    """What is left of a run beside the base spans that touch it: structs of ``s, e, m``, of LEAST characters or more."""
    kind = "array<struct<s:int,e:int>>"
    touching = F.filter(base, lambda b: (b["s"] < run["e"]) & (run["s"] < b["e"]))
    piece = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e"))).cast(kind)
    zero = F.struct(run["s"].alias("at"), F.array().cast(kind).alias("out"))
    step = lambda a, b: F.struct(F.greatest(a["at"], b["e"]).alias("at"), F.concat(a["out"], piece(a["at"], b["s"])).alias("out"))
    free = F.aggregate(touching, zero, step, lambda a: F.concat(a["out"], piece(a["at"], run["e"])))
    long = F.filter(free, lambda x: x["e"] - x["s"] >= LEAST)
    return F.transform(long, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.substring(run["m"], x["s"] - run["s"] + 1, x["e"] - x["s"]).alias("m")))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-45))) / STEP), F.lit(BINS)).cast("int")


def find_secrets(documents: DataFrame, fdr: float = 0.01) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``extra`` (arrays of ``struct<k, s, e, p>``).

    ``base`` has the spans of the fixed patterns by start, then kind as listed; ``extra`` the runs
    that the battery adds at the given false-discovery rate, none of which touches a base span.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = "array<struct<s:int,o:int,k:string,e:int,p:double>>"

    def named(found: Column, i: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("o"), F.lit(KINDS[i]).alias("k"), x["e"].alias("e"), F.lit(0.0).alias("p"))).cast(kind)

    found = documents.select(
        "doc_id",
        spans(text, ASSIGN).alias("a"),
        spans(text, ACCESS).alias("b"),
        spans(text, HEX).alias("c"),
        spans(text, RUN).alias("r"),
    )
    assign = F.filter("a", lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= 6)
    base = F.array_sort(F.concat(named(assign, 0), named(F.col("b"), 1), named(F.col("c"), 2)))
    found = found.select("doc_id", base.alias("base"), "r")
    free = F.flatten(F.transform("r", lambda x: _beside(x, F.col("base"))))
    tested = F.transform(F.filter(free, lambda x: x["m"].rlike("[A-Za-z0-9]")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _battery(x["m"]).alias("t")))
    found = cut(found.select("doc_id", "base", tested.alias("r")))

    counts = (
        found.select(F.explode("r.t").alias("t"))
        .groupBy(F.col("t.stratum").alias("stratum"), _bin(F.col("t.p")).alias("bin"))
        .count()
        .collect()  # at most STRATA x (BINS + 1) rows
    )
    limit = {}
    for s in {c["stratum"] for c in counts}:
        own = {c["bin"]: c["count"] for c in counts if c["stratum"] == s}
        total, seen, best = sum(own.values()), 0, None
        for b in sorted(own, reverse=True):
            seen += own[b]
            if 10 ** (-b * STEP) * total / seen <= fdr:
                best = b
        if best is not None:
            limit[s] = best

    def passes(x: Column) -> Column:
        hit = F.lit(False)
        for s, b in limit.items():
            hit = hit | ((x["t"]["stratum"] == s) & (_bin(x["t"]["p"]) >= b))
        return hit

    extra = F.transform(
        F.filter("r", passes),
        lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("o"), F.lit("random").alias("k"), x["e"].alias("e"), x["t"]["p"].alias("p")),
    ).cast(kind)
    return found.select("doc_id", "base", extra.alias("extra"))


def redact(documents: DataFrame, mask: str = "[SECRET]", fdr: float = 0.01) -> DataFrame:
    """``documents`` with every secret replaced by ``mask`` and ``n_chars`` counted anew.

    Overlapping and touching spans are masked as one.  Documents join their spans by doc_id, so repeated or null
    ids are told apart by an md5 of id and text, which rows share by chance at no real size of a corpus.
    """
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    found = find_secrets(documents.select(key.alias("doc_id"), "text"), fdr)
    hits = found.select(F.col("doc_id").alias("key"), F.array_sort(F.concat("base", "extra")).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["key"])
    hits = cut(hits)
    if (hits.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        hits = F.broadcast(hits)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<g:int,n:int>>").alias("out"))

    def step(acc, x):  # the text from acc.at to x.s stays; mask only where the span begins anew
        keep = F.struct(acc["at"].alias("g"), (x["s"] - acc["at"]).alias("n"))
        inside = (x["s"] <= acc["at"]) & (F.size(acc["out"]) > 0)
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(keep).cast("array<struct<g:int,n:int>>"))).alias("out"),
        )

    cuts = F.aggregate("spans", zero, step)
    joined = documents.select(F.struct("*").alias("row"), key.alias("key")).join(hits, "key", "left").withColumn("cuts", F.when(F.col("spans").isNotNull(), cuts))
    kept = F.array_join(F.transform("cuts.out", lambda c: F.concat(F.substring(F.col("row.text"), c["g"] + 1, c["n"]), F.lit(mask))), "")
    masked = F.concat(kept, F.substring(F.col("row.text"), F.col("cuts.at") + 1, F.length("row.text")))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(masked)
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast("long"))
    return joined.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in documents.columns))


def op1_secrets(spark, sf_dir) -> DataFrame:
    from .common import table

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
