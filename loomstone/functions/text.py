"""Scalar functions over text, hashes, dates and numbers, as column expressions.

Each takes and returns columns, so it stays in generated code on the JVM and composes with filters.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query

#: Small closed word lists (fixed values).
STOP = ("the", "of", "and", "to", "in", "is", "it", "for", "that", "with")


def word_tokens(text: Column) -> Column:
    """words of letters and digits, with inner apostrophes; the curly one is folded."""
    return F.regexp_extract_all(F.regexp_replace(text, "’", "'"), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """lowered words without stop words and single letters."""
    return F.filter(word_tokens(F.lower(text)), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def fts_query(text: Column) -> Column:
    """words joined by OR; empty if none is long enough."""
    return F.array_join(F.filter(word_tokens(text), lambda w: (F.length(w) >= 2) | ~w.rlike(r"^[\x00-\x7f]*$")), " OR ")


def stem(word: Column) -> Column:
    """-ies to y, else a final s goes."""
    return F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(F.expr("''"), F.regexp_replace(word, "ies$", "y"))).when(
        word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")
    ).otherwise(word)


def normalize_value(text: Column) -> Column:
    """lowered, squeezed, without a leading article and outer punctuation."""
    squeezed = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(squeezed, r"^(the|a|an) ", ""), r"^[.,;:!?]+|[.,;:!?]+$", "")


def entity_token(name: Column) -> Column:
    """lowered, other characters to one underscore, ends trimmed, never empty."""
    t = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def stable_id(text: Column) -> Column:
    """the first 15 hex digits of the SHA-256 as a number (60 bits)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def content_id(prefix: str, *parts: Column) -> Column:
    """Prefix and hash of the parts in order; unit separators keep parts apart."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 24))


def decimalize(x: Column) -> Column:
    """an integer if integral, else six decimal places, as a string."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("decimal(38,6)").cast("string"))


def estimate_tokens(text: Column, num: int = 1, den: int = 1) -> Column:
    """characters over four, with a margin, rounded up."""
    return F.ceil(F.length(text) * num / F.lit(4.0 * den)).cast("long")


def sentences(text: Column) -> Column:
    """split after . ! ? before white space, blanks dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def truncate_at_boundary(text: Column, n: int) -> Column:
    """cut at the last sentence end within ``n`` characters, else the last blank, else nothing."""
    head = F.substring(text, 1, n)
    at_sentence = F.regexp_extract(head, r"(?s)^(.*[.!?\n])", 1)
    at_blank = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= n, text).when(at_sentence != "", F.rtrim(at_sentence)).otherwise(F.rtrim(at_blank))


def phone_key(text: Column) -> Column:
    """digits only, a leading US 1 of eleven goes, at least seven remain."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    cut = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(cut) >= 7, cut)


def age_days(ts: Column, now: str) -> Column:
    """days since a time; 0 for null."""
    return F.coalesce((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)) / 86400.0, F.lit(0.0))


def freshness(created: Column, expires: Column, now: Column) -> Column:
    """from 1 at creation down to 0 at expiry."""
    span = expires - created
    return F.when(span <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (expires - now) / span)))


def duration_seconds(text: Column) -> Column:
    """``20m``, ``2h`` -> seconds."""
    n = F.regexp_extract(text, r"^(\d+)([smhd])$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(n != "", n.cast("long")) * scale


_T = r"[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*"
DOCS = "FROM documents"


@query("f1_word_tokens", f"SELECT doc_id, len(regexp_extract_all(replace(text, '’', ''''), '{_T}')) AS n, len(list_distinct(regexp_extract_all(replace(text, '’', ''''), '{_T}'))) AS distinct_n {DOCS}")
def f1(spark, d):
    """word counts."""
    w = load(spark, d, "documents").select("doc_id", word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("distinct_n"))


@query("f2_fts_query", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '{_T}'), lambda w: length(w) >= 2 OR NOT regexp_full_match(w, '[\\x00-\\x7f]*')), ' OR ') AS q FROM benchmark")
def f2(spark, d):
    """F2."""
    return load(spark, d, "benchmark").select("item_id", fts_query(F.col("text")).alias("q"))


@query("f3_query_tokens", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '{_T}'), lambda w: length(w) > 1 AND w NOT IN {STOP}), ' ') AS q FROM benchmark")
def f3(spark, d):
    """F3/F7/F8."""
    return load(spark, d, "benchmark").select("item_id", F.array_join(query_tokens(F.col("text")), " ").alias("q"))


@query("f5_stems", r"""SELECT DISTINCT w, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN regexp_replace(w,'ies$','y') WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN regexp_replace(w,'s$','') ELSE w END AS stem FROM (SELECT unnest(regexp_extract_all(lower(text),'[a-z]+')) AS w FROM benchmark)""")
def f5(spark, d):
    """F5/F6."""
    w = load(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", stem(F.col("w")).alias("stem"))


@query("f18_token_estimate", "SELECT doc_id, ceil(length(text)/4.0)::BIGINT AS tokens FROM documents")
def f18(spark, d):
    """F18."""
    return load(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("f19_sentences", r"SELECT item_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s FROM benchmark")
def f19(spark, d):
    """sentences."""
    return load(spark, d, "benchmark").select("item_id", sentences(F.col("text")).alias("s"))


@query("f20_normalized", r"SELECT item_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(text),'\s+',' ','g')),'^(the|a|an) ',''),'^[.,;:!?]+|[.,;:!?]+$','','g') AS v FROM benchmark")
def f20(spark, d):
    """F20/F46/F47."""
    return load(spark, d, "benchmark").select("item_id", normalize_value(F.col("text")).alias("v"))


@query("f21_typed_value", "SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) AS value_num, CASE WHEN value = floor(value) THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR) END AS canonical FROM events")
def f21(spark, d):
    """Typed and canonical values."""
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("value_num"), decimalize(F.col("value")).alias("canonical"))


@query("f25_content_ids", "SELECT event_id, 'ev_' || substr(sha256(event_type || chr(31) || CAST(user_id AS VARCHAR) || chr(31) || props),1,24) AS id FROM events")
def f25(spark, d):
    """Content-addressed ids."""
    return load(spark, d, "events").select("event_id", content_id("ev_", F.col("event_type"), F.col("user_id"), F.col("props")).alias("id"))


@query("f29_stable_id", "SELECT doc_id, CAST('0x' || substr(sha256(text),1,15) AS BIGINT) AS sid FROM documents")
def f29(spark, d):
    """Stable numbers for text keys."""
    return load(spark, d, "documents").select("doc_id", stable_id(F.col("text")).alias("sid"))


@query("f31_age_days", "SELECT o_orderkey, round(coalesce(epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate),0)/86400.0,6) AS age FROM orders")
def f31(spark, d):
    """F31/F53."""
    return load(spark, d, "orders").select("o_orderkey", F.round(age_days(F.col("o_orderdate").cast("timestamp"), "1998-08-02 00:00:00"), 6).alias("age"))


@query("f35_phone_keys", r"SELECT doc_id, k FROM (SELECT doc_id, CASE WHEN length(x)=11 AND x LIKE '1%' THEN substr(x,2,10) ELSE x END AS k FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text,'\+[0-9][0-9 ().-]{6,}[0-9]')),'[^0-9]','','g') AS x FROM documents)) WHERE length(k) >= 7")
def f35(spark, d):
    """phone keys."""
    p = load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\+[0-9][0-9 ().-]{6,}[0-9]"), F.lit(0))).alias("x"))
    return p.select("doc_id", phone_key(F.col("x")).alias("k")).where("k IS NOT NULL")


@query("f36_entity_token", "SELECT p_partkey, CASE WHEN t='' THEN 'unknown' ELSE t END AS token FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9]+','_','g'),'^_+|_+$','','g') AS t FROM part)")
def f36(spark, d):
    """F36/F37."""
    return load(spark, d, "part").select("p_partkey", entity_token(F.col("p_name")).alias("token"))


@query("f38_folder_cards", r"WITH p AS (SELECT regexp_extract(url,'://[^/]+/([^/?#]*)',1) AS folder, page_id FROM pages) SELECT folder, count(*) AS n, array_to_string(list_sort(list(page_id))[1:8], ', ') AS first_ids FROM p GROUP BY folder")
def f38(spark, d):
    """cards of folders: the count and first eight names."""
    p = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]+/([^/?#]*)", 1).alias("folder"))
    w = Window.partitionBy("folder").orderBy("page_id")
    first = p.withColumn("r", F.row_number().over(w)).where("r <= 8").groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ", ").alias("first_ids"))
    return p.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).join(first, "folder")




@query("f40_row_text", "SELECT c_custkey, substr('c_name=' || c_name || '; c_mktsegment=' || c_mktsegment || '; c_nationkey=' || c_nationkey, 1, 350) AS body FROM customer")
def f40(spark, d):
    """a row as bounded text."""
    pair = lambda c: F.concat(F.lit(c + "="), F.substring(F.col(c).cast("string"), 1, 100))
    return load(spark, d, "customer").select("c_custkey", F.substring(F.concat_ws("; ", *map(pair, ("c_name", "c_mktsegment", "c_nationkey"))), 1, 350).alias("body"))


@query("f52_truncate", r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN regexp_extract(substr(text,1,300),'(?s)^(.*[.!?\n])',1) <> '' THEN regexp_replace(regexp_extract(substr(text,1,300),'(?s)^(.*[.!?\n])',1),' +$','') ELSE regexp_replace(regexp_extract(substr(text,1,300),'(?s)^(.*)\s',1),' +$','') END AS head FROM documents""")
def f52(spark, d):
    """F52/W17."""
    return load(spark, d, "documents").select("doc_id", truncate_at_boundary(F.col("text"), 300).alias("head"))


@query("f54_text_hash", r"SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text),'\s+',' ','g'))),1,32) AS h FROM documents")
def f54(spark, d):
    """F54."""
    return load(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256), 1, 32).alias("h"))


@query("f33_durations", "SELECT DISTINCT p_size, CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size*60 ELSE p_size*3600 END::BIGINT AS seconds FROM part")
def f33(spark, d):
    """F33."""
    s = load(spark, d, "part").select("p_size").distinct()
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit("s"), F.lit("m"), F.lit("h")), (F.col("p_size") % 3 + 1).cast("int")))
    return s.select("p_size", duration_seconds(text).alias("seconds"))


@query("f24_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def f24(spark, d):
    """the hash of a content, of its UTF-8 bytes."""
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))


@query("v20_fold_ids", """WITH b AS (SELECT conv_id, turn // 8 AS span, string_agg(sha256(text), '' ORDER BY turn) AS hs FROM conversations GROUP BY ALL)
  SELECT conv_id, span, 'fold_' || substr(sha256(hs), 1, 12) AS fold FROM b""")
def v20(spark, d):
    """The id of a folded span of eight turns, from the hashes of its turns: equal spans have equal ids."""
    c = load(spark, d, "conversations").select("conv_id", F.expr("turn div 8").alias("span"), "turn", F.sha2("text", 256).alias("h"))
    g = c.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("hs"))  # eight hashes at most
    return g.select("conv_id", "span", F.concat(F.lit("fold_"), F.substring(F.sha2(F.array_join(F.col("hs.h"), ""), 256), 1, 12)).alias("fold"))
