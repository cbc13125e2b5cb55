"""Answering and upkeep: reading spans, static blocks, entity pages, corrections, hints, health."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query
from .eventlog import append
from .retrieval import cosine, query_vector, top
from .search import WORD, index_of

Rule = Callable[[DataFrame], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Register a derivation rule, a function from facts to derived facts (entity, predicate, value, confidence)."""

    def add(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return add


@rule("spender")
def _spender(facts: DataFrame) -> DataFrame:
    big = facts.where("predicate = 'purchase' AND value > 50")
    return big.select("entity", F.lit("is_spender").alias("predicate"), F.lit("yes").alias("value"), F.lit(0.75).alias("confidence"))


@rule("troubled")
def _troubled(facts: DataFrame) -> DataFrame:
    bad = facts.where("predicate = 'error' AND value > 80")
    return bad.select("entity", F.lit("has_trouble").alias("predicate"), F.lit("yes").alias("value"), F.lit(0.6).alias("confidence"))


def derive(facts: DataFrame) -> DataFrame:
    """All rules over all facts, each derived fact once with its highest confidence."""
    out = None
    for f in RULES.values():
        got = f(facts)
        out = got if out is None else out.union(got)
    return out.groupBy("entity", "predicate", "value").agg(F.max("confidence").alias("confidence"))


def hash_embed(docs: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """V4: ``key, i, x``: signed word counts by hash, as the non-zero cells of a unit vector."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("w"))
    tf = words.groupBy(key, "w").agg(F.count(F.lit(1)).alias("tf"))
    h = F.conv(F.substring(F.sha2("w", 256), 1, 8), 16, 10).cast("long")
    cells = tf.select(key, (h % dims).alias("i"), (F.when(F.floor(h / dims) % 2 == 0, 1).otherwise(-1) * F.col("tf")).alias("x"))
    cells = cells.groupBy(key, "i").agg(F.sum("x").alias("x"))
    norm = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return cells.join(norm, key).where("n > 0").select(key, "i", (F.col("x") / F.col("n")).alias("x"))


def best_sentence(text: Column, words: list[str]) -> Column:
    """The first sentence with one of the words, else the first line, 200 characters at most."""
    s = F.split(text, r"(?<=[.!?])\s+")
    hit = F.filter(s, lambda x: reduce(Column.__or__, (F.contains(F.lower(x), F.lit(w)) for w in words)))
    return F.substring(F.coalesce(F.get(hit, F.lit(0)), F.substring_index(text, "\n", 1)), 1, 200)


def capped(rows: DataFrame, keys: list[str], cap: int, *order: Column) -> DataFrame:
    """At most ``cap`` rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


@query("v4_hash_embedding", f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM benchmark), h AS (SELECT item_id, CAST('0x' || substr(sha256(w),1,8) AS BIGINT) AS h FROM w), c AS (SELECT item_id, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL)
  SELECT item_id, i, round(x/sqrt(sum(x*x) OVER (PARTITION BY item_id)),5) AS x FROM c QUALIFY sum(x*x) OVER (PARTITION BY item_id) > 0""")
def v4(spark, d):
    """V4/V5: hashed embeddings of the benchmark's texts."""
    return hash_embed(load(spark, d, "benchmark"), "item_id", "text").select("item_id", "i", F.round("x", 5).alias("x"))


@query("v12_two_stage", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]),5) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=4) q ORDER BY sim DESC, a.vec_id LIMIT 10")
def v12(spark, d):
    """A shortlist by the first half of the coordinates prunes with a proven bound, whole products decide.

    By Cauchy and Schwarz the second halves add at most the product of their lengths, so a vector whose first
    half plus that bound stays below the tenth best whole product of a first guess can't be among the ten.
    The guess is the ten best by first half; whole products are computed for it and for what passes.
    """
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    half = 32
    q = query_vector(e, 4)
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    rest = F.slice("embedding", half + 1, F.size("embedding"))
    q_rest = F.slice(q, half + 1, F.size(q))
    coarse = e.select("vec_id", "embedding", product(F.slice("embedding", 1, half), F.slice(q, 1, half)).alias("c"), (F.sqrt(product(rest, rest)) * F.sqrt(product(q_rest, q_rest))).alias("most"))
    guess = coarse.orderBy(F.desc("c")).limit(10).select(product(F.col("embedding"), q).alias("x")).agg(F.min("x").alias("low"))
    near = coarse.join(F.broadcast(guess), F.col("c") + F.col("most") >= F.col("low") - 1e-9)
    return near.select("vec_id", F.round(F.col("c") + product(rest, q_rest), 5).alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(10)


@query("t8_read_and_answer")
def t8(spark, d):
    """The best documents for a question and the sentence of each that answers it (ranked text, tested by brute force)."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    hits = top(index_of(spark, f"{d}/documents.parquet").bm25(["with", "for", "that"]).withColumn("score", F.round("score", 6)), 10)
    return docs.join(F.broadcast(hits), F.col("doc_id") == F.col("doc")).select("doc_id", "rank", best_sentence(F.col("text"), ["with", "for", "that"]).alias("answer"))


@query("t14_ask_about", "SELECT c.c_custkey, c.c_name, n.n_name, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice),0),2) AS spent FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey LEFT JOIN orders o ON o.o_custkey=c.c_custkey GROUP BY ALL")
def t14(spark, d):
    """An entity with its place and the digest of its records; records are summed before the join."""
    c = load(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    n = load(spark, d, "nation").select("n_nationkey", "n_name")  # 25 rows
    j = c.join(F.broadcast(n), "n_nationkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query("t16_explain", "SELECT o.o_orderkey, count(l.l_linenumber) AS premises, CASE WHEN o.o_orderstatus='P' THEN 'not_found' ELSE o.o_orderstatus END AS status FROM orders o JOIN lineitem l ON l.l_orderkey=o.o_orderkey GROUP BY o.o_orderkey, o.o_orderstatus")
def t16(spark, d):
    """A belief with its premises; unreadable ones look as if absent."""
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "not_found").otherwise(F.col("o_orderstatus")).alias("status"))
    p = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("premises"))
    return o.join(p, "o_orderkey").select("o_orderkey", "premises", "status")


@query("t20_reflections", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text),'the') OR contains(lower(text),'der') ORDER BY conv_id, turn LIMIT 5")
def t20(spark, d):
    """The first five that mention a word."""
    t = F.lower("text")
    return load(spark, d, "conversations").where(F.contains(t, F.lit("the")) | F.contains(t, F.lit("der"))).select("conv_id", "turn").orderBy("conv_id", "turn").limit(5)


@query("r10_corrected", """WITH c AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_id, lead(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_value FROM events)
  SELECT event_id, CASE WHEN next_id IS NULL THEN 'active' WHEN next_value IS NULL OR next_value < 1 THEN 'retracted' ELSE 'superseded' END AS status, next_id AS superseded_by FROM c""")
def r10(spark, d):
    """What a later event of the key makes of a belief."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    c = load(spark, d, "events").select("event_id", F.lead("event_id").over(w).alias("superseded_by"), F.lead("value").over(w).alias("v"))
    status = F.when(F.col("superseded_by").isNull(), "active").when(F.col("v").isNull() | (F.col("v") < 1), "retracted").otherwise("superseded")
    return c.select("event_id", status.alias("status"), "superseded_by")


@query("r21_insert_beliefs", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS belief, count(*) AS provenance, CASE WHEN event_type='signup' THEN 'high' ELSE 'normal' END AS criticality FROM events GROUP BY user_id, event_type")
def r21(spark, d):
    """Beliefs with provenance and criticality."""
    g = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("belief"), F.count(F.lit(1)).alias("provenance"))
    return g.withColumn("criticality", F.when(F.col("event_type") == "signup", "high").otherwise("normal"))


@query("l24_health", """SELECT * FROM (SELECT 'documents' AS t, count(*) AS n, count(*) FILTER (text IS NULL OR text='') AS bad, count(*) - count(DISTINCT doc_id) AS repeats FROM documents
  UNION ALL SELECT 'events', count(*), count(*) FILTER (value IS NULL), count(*) - count(DISTINCT event_id) FROM events UNION ALL SELECT 'embeddings', count(*), count(*) FILTER (len(embedding)<>64), count(*) - count(DISTINCT vec_id) FROM embeddings)""")
def l24(spark, d):
    """Counts, bad rows and repeats by table."""
    out = None
    for t, key, bad in (("documents", "doc_id", F.col("text").isNull() | (F.col("text") == "")), ("events", "event_id", F.col("value").isNull()), ("embeddings", "vec_id", F.size("embedding") != 64)):
        g = load(spark, d, t).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count_distinct(key).alias("u"))
        g = g.select(F.lit(t).alias("t"), "n", "bad", (F.col("n") - F.col("u")).alias("repeats"))
        out = g if out is None else out.union(g)
    return out


@query("x9_reply_validator", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, CAST(json_extract_string(props,'$.k') AS BIGINT) BETWEEN 0 AND 80 AS valid FROM events")
def x9(spark, d):
    """Replies parsed by a strict schema; what doesn't fit is invalid."""
    r = F.from_json("props", "struct<k:bigint>", {"mode": "PERMISSIVE"})
    return load(spark, d, "events").select("event_id", r["k"].alias("k"), F.coalesce(r["k"].between(0, 80), F.lit(False)).alias("valid"))


@query("x10_hint_cap", "SELECT user_id, event_id FROM events WHERE event_type='click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def x10(spark, d):
    """The newest hints of each owner up to a cap."""
    return capped(load(spark, d, "events").where("event_type='click'"), ["user_id"], 3, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("a26_line_dedup", "SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY conv_id, text")
def a26(spark, d):
    """Of equal lines the first stays."""
    return load(spark, d, "conversations").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))


@query("w24_preference_packing", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS place FROM conversations""")
def w24(spark, d):
    """What the user said comes first, the rest after, in order."""
    first = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    w = Window.partitionBy("conv_id").orderBy(first, "turn")
    return load(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("place"))


@query("w19_best_passage", f"SELECT label, vec_id, round(0.5*sim,6) AS score FROM (SELECT a.label, a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]),5) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=6) q) WHERE sim > 0.15 QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) = 1")
def w19(spark, d):
    """The best passage of each record above the floor, at half weight."""
    e = load(spark, d, "embeddings")
    s = e.select("label", "vec_id", F.round(cosine(F.col("embedding"), query_vector(e, 6)), 5).alias("sim")).where("sim > 0.15")
    return capped(s, ["label"], 1, F.desc("sim"), F.col("vec_id")).select("label", "vec_id", F.round(0.5 * F.col("sim"), 6).alias("score"))


@query("u8_retract_set", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type='error')")
def u8(spark, d):
    """Rows without a set of retracted ids."""
    e = load(spark, d, "events").select("event_id", "event_type")
    return append(e.where("event_type='error'").select("event_id"), e.select("event_id"))


@query("s22_last_update", "SELECT doc_id, arg_max(quality, (toxic, quality)) AS quality FROM labels GROUP BY doc_id")
def s22(spark, d):
    """Partial updates, last writer wins."""
    return load(spark, d, "labels").groupBy("doc_id").agg(F.max_by("quality", F.struct("toxic", "quality")).alias("quality"))


@query("l26_derived_facts", """SELECT entity, predicate, value, max(confidence)::DOUBLE AS confidence FROM (SELECT user_id AS entity, 'is_spender' AS predicate, 'yes' AS value, 0.75 AS confidence FROM events WHERE event_type='purchase' AND value > 50
  UNION ALL SELECT user_id, 'has_trouble', 'yes', 0.6 FROM events WHERE event_type='error' AND value > 80) GROUP BY ALL""")
def l26(spark, d):
    """Every registered rule over all facts; a fact that several premises give comes once."""
    facts = load(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("predicate"), "value")
    return derive(facts).select("entity", "predicate", "value", "confidence")
