"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

DataFrame functions only.  Base kinds are email, ip (parts up to 255), card (13 to 19 digits that
pass Luhn) and phone (9 to 15 digits); a match that fails is dropped and not retried.  Two kinds are
added: iban (its country's length, mod-97 check) and id (nnn-nn-nnnn, of numbers that can be given
out).  Every span gets a score from 0 to 1: a prior by kind, plus what its validator adds, plus or minus
what whole words of the 48 code points before it and the 24 after it say.  Base spans always stay;
added ones need ``least_score``.

Null text is the empty text.  Null and repeated doc_ids are kept: one row out for one row in.
An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import span_text, spans, table

#: Lengths of account numbers by country (fixed values).
IBAN = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
#: Kinds in order. The patterns have the contract's matches; possessive forms and \G keep the scan linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN.items()) + r")\b",
    "id": r"\b(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b",
}
BASE = ("email", "ip", "card", "phone")
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "id": 0.3}
CONFIRMED = {"email": 0.1, "ip": 0.2, "card": 0.3, "phone": 0.1, "iban": 0.4, "id": 0.0}
CONTEXT = {
    "email": r"\b(?:e-?mails?|contact|write to|adresse?|correo)\b",
    "ip": r"\b(?:ip|address|host|server|login)\b",
    "card": r"\b(?:cards?|visa|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|telephone|tel|call|mobile|fax|handy)\b",
    "iban": r"\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "id": r"\b(?:ssn|social security|identity|id no|passport)\b",
}
AGAINST = r"\b(?:version|orders?|invoice|isbn|serial|build|example)\b"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks has the remainder 1 that its check digits promise."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda a, c: F.when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(letters, F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def find_personal(documents: DataFrame, least_score: float = 0.6) -> DataFrame:
    """One row per document: ``doc_id`` and ``found``, an array of ``struct<o, s, k, e, score>``.

    Sorted by kind as listed in PATTERNS (its number is ``o``), then start.
    """
    kinds = list(PATTERNS)
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = documents.select("doc_id", text.alias("_t"), *(spans(text, PATTERNS[k]).alias(k) for k in kinds))

    def scored(kind: str) -> Column:
        def one(x: Column) -> Column:
            before = F.lower(F.substring(F.col("_t"), F.greatest(x["s"] - 47, F.lit(1)), F.least(x["s"], F.lit(48))))
            after = F.lower(F.substring(F.col("_t"), x["e"] + 1, F.lit(24)))
            near = before.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind])
            score = PRIOR[kind] + CONFIRMED[kind] + F.when(near, 0.4).otherwise(0.0) - F.when(before.rlike(AGAINST), 0.2).otherwise(0.0)
            score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
            return F.struct(F.lit(kinds.index(kind)).alias("o"), x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), score.alias("score"))

        out = F.transform(F.filter(kind, lambda x: _valid(kind, x["m"])), one)
        return out if kind in BASE else F.filter(out, lambda x: x["score"] >= least_score)

    return raw.select("doc_id", F.array_sort(F.concat(*(scored(k) for k in kinds))).alias("found"))


def op3_pii(spark, sf_dir) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["o"] < len(BASE))
    n = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(n(k).alias(f"n_{k}") for k in BASE),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
