import hashlib
import re

from pyspark.sql import functions as F

from loomstone.llm import pii as P

SCHEMA = "doc_id long, text string, found string"


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return out


def sha(items):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in items).encode()).hexdigest()


CASES = [
    None,
    "",
    "é😀 a@b.co, x.y+z@mail-1.example.com. a@b.com+x@c.d foo@bar baz..@x.y.",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0255.00.1.9 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111000 1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "+1 (555) 123-4567 +44 20 7946 0958. +12 +1.2.3.4.5.6.7.8.9 +123456789012345678",
    "a" * 30000 + "@" + "b." * 20000 + "c",
    "1" * 60000,
    "1.1.1.1." * 8000,
    "+1 " * 5000,
    "a@b." * 3000,
]


def test_base_matches_brute_force(spark, tmp_path, sf):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in P.op3_pii(spark, str(tmp_path)).collect():
        want = brute(CASES[r.doc_id])
        assert r.base_sha256 == sha(want), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in P.BASE]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.op3_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.base_sha256 == sha(brute(texts[r.doc_id]))


def test_validators_and_context(spark):
    texts = [
        "our iban: DE89 3704 0044 0532 0130 00 please",
        "our iban: DE89 3704 0044 0532 0130 01 please",
        "social security 123-45-6789",
        "ticket 123-45-6789",
        "mail to a@b.org",
    ]
    got = {r.doc_id: [x.k for x in r.found] for r in P.find_personal(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert "iban" in got[0] and "iban" not in got[1]
    assert got[2] == ["id"] and got[3] == [] and got[4] == ["email"]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a@b.co", None), (1, "a@b.co", None), (None, None, None)]
    out = P.find_personal(spark.createDataFrame(rows, SCHEMA))
    assert out.where(F.size("found") == 1).count() == 2 and out.count() == 3
    assert P.find_personal(spark.createDataFrame([], SCHEMA)).count() == 0


def test_account_numbers_by_country_and_context_of_whole_words(spark):
    texts = [
        "pay to DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000", "DE89 3704 0044 0532 0130 01", "XX89 3704 0044 0532 0130 00",
        "ssn 123-45-6789", "ssn 666-45-6789", "ssn 123-00-6789", "the hotel +1 212 555 0100", "tel +1 212 555 0100", "+1 212 555 0100 is my phone", "border 123-45-6789 identity",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r.doc_id: {x.k: (x.s, x.e, x.score) for x in r.found} for r in P.find_personal(df).collect()}
    assert got[0]["iban"][:2] == (7, 34) and "iban" in got[1] and "iban" not in got[2] and "iban" not in got[3]
    assert "id" in got[4] and "id" not in got[5] and "id" not in got[6]
    assert got[7]["phone"][2] == 0.6 and got[8]["phone"][2] == 1.0 and got[9]["phone"][2] == 1.0
    assert got[10]["id"][2] == 0.7  # "border" is no order
