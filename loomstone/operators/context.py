"""Context for a question: belief search, raw tier, pools, fusion, abstention, spans, budgets and sections.

Ranked lists are cut before they are joined or windowed, so windows without a partition see a bounded head.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from ..functions.language import FACTS, FOCUS, LEVEL_SQL, NORM_SQL, SAID, content_words, criticality, said, standing_instruction
from ..functions.text import sentences
from ..plans.registry import load, query
from .retrieval import COS, bm25_sql, cosine, dot, minmax, norm, query_vector, rrf, top
from .search import WORD, index_of

Q = ["the", "with", "keit"]
_TOP = "SELECT doc, score, row_number() OVER (ORDER BY round(score,6) DESC, doc) AS rank FROM bm25 WHERE score > 0 QUALIFY rank <= {k}"


def text_hits(spark, d, words: list[str], k: int) -> DataFrame:
    """``doc, score, rank`` of the ``k`` best documents."""
    return top(index_of(spark, f"{d}/documents.parquet").bm25(words).withColumn("score", F.round("score", 6)), k)


def vector_hits(spark, d, vec_id: int, k: int, least: float = -1.0) -> DataFrame:
    e = load(spark, d, "embeddings")
    s = e.select(F.col("vec_id").alias("doc"), F.round(cosine(F.col("embedding"), query_vector(e, vec_id)), 6).alias("score"))
    return top(s.where(F.col("score") > least), k)


PART_BM = bm25_sql(["widget", "bolt", "cold"]).replace("doc_id AS doc", "p_partkey AS doc").replace("lower(text)", "lower(p_name)").replace("FROM documents", "FROM part")


@query("t2_belief_search", f"WITH {PART_BM} SELECT doc, round(score,6) AS score FROM bm25 WHERE score > 0 ORDER BY round(score,6) DESC, doc LIMIT 20")
def t2(spark, d):
    """Full-text search over beliefs' own text."""
    hits = index_of(spark, f"{d}/part.parquet", "p_partkey", "p_name").bm25(["widget", "bolt", "cold"]).select("doc", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "doc").limit(20)


RAW_SQL = f"""f AS ({_TOP.format(k=40)}), v AS (SELECT a.vec_id AS doc, round({COS},6) AS cos FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=12) q WHERE round({COS},6) > 0.1 ORDER BY cos DESC, a.vec_id LIMIT 40), u AS (SELECT doc, 1.0/(60+rank+1) AS s FROM f UNION ALL SELECT doc, 0.6*cos FROM v),
  raw AS (SELECT u.doc, round(sum(s)*max(CASE WHEN e.ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' THEN 1.5 ELSE 0.75 END),6) AS score FROM u JOIN events e ON e.event_id = u.doc GROUP BY u.doc)"""


def raw_tier(spark, d, words: list[str], vec_id: int, k: int) -> DataFrame:
    """Text and vector channels summed; what lies in the time window counts half as much again, the rest a quarter less."""
    f = text_hits(spark, d, words, 40).select("doc", (1.0 / (60 + F.col("rank") + 1)).alias("s"))
    v = vector_hits(spark, d, vec_id, 40, 0.1).select("doc", (0.6 * F.col("score")).alias("s"))
    at = load(spark, d, "events").select(F.col("event_id").alias("doc"), "ts")
    near = at.join(F.broadcast(f.union(v)), "doc")  # 80 rows
    boost = F.max(F.when(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz")), 1.5).otherwise(0.75))
    g = near.groupBy("doc").agg(F.round(F.sum("s") * boost, 6).alias("score"))
    return g.orderBy(F.desc("score"), "doc").limit(k)


@query("w23_temporal_boost", f"WITH {bm25_sql(Q)}, {RAW_SQL} SELECT doc, score FROM raw ORDER BY score DESC, doc LIMIT 40")
def w23(spark, d):
    """The raw tier's channels and its temporal boost."""
    return raw_tier(spark, d, Q, 12, 40)


@query("t5_raw_retrieve", f"WITH {bm25_sql(Q)}, {RAW_SQL} SELECT r.doc, r.score, substr(d.text, 1, 120) AS excerpt FROM (SELECT * FROM raw ORDER BY score DESC, doc LIMIT 20) r JOIN documents d ON d.doc_id = r.doc")
def t5(spark, d):
    """T5: the best of the raw tier with their excerpts."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.substring("text", 1, 120).alias("excerpt"))
    return docs.join(F.broadcast(raw_tier(spark, d, Q, 12, 20)), "doc").select("doc", "score", "excerpt")


@query("w5_mmr_pool", f"WITH {bm25_sql(Q)}, h AS ({_TOP.format(k=30)}) SELECT h.doc, e.vec_id IS NOT NULL AS vectored, row_number() OVER (PARTITION BY e.vec_id IS NOT NULL ORDER BY rank) AS place FROM h LEFT JOIN embeddings e ON e.vec_id = h.doc WHERE rank <= greatest(10, round(1.5*10))")
def w5(spark, d):
    """The pool that diversity picks from: half as many again as are wanted; those without a vector fill up by score."""
    pool = text_hits(spark, d, Q, 30).where(F.col("rank") <= max(10, round(1.5 * 10)))
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.lit(True).alias("v"))
    j = pool.join(e, "doc", "left").withColumn("vectored", F.coalesce("v", F.lit(False)))
    return j.select("doc", "vectored", F.row_number().over(Window.partitionBy("vectored").orderBy("rank")).cast("long").alias("place"))


@query("t4_two_tier_search", f"""WITH {bm25_sql(Q)}, f AS ({_TOP.format(k=40)}), v AS (SELECT doc, row_number() OVER (ORDER BY sim DESC, doc) AS rank FROM (SELECT a.vec_id AS doc, round({COS},6) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=12) q) QUALIFY rank <= 40),
  r AS (SELECT doc, sum(s) AS fused FROM (SELECT doc, 0.5/(60+rank) AS s FROM f UNION ALL SELECT doc, 0.5/(60+rank) FROM v) GROUP BY doc), c AS (SELECT r.doc, round(fused,9) AS fused, round({COS},6) AS sim FROM r LEFT JOIN embeddings a ON a.vec_id = r.doc LEFT JOIN (SELECT embedding FROM embeddings WHERE vec_id=12) q ON true),
  m AS (SELECT *, (fused - min(fused) OVER ())/(max(fused) OVER () - min(fused) OVER ()) AS x FROM c) SELECT doc, round(CASE WHEN sim IS NULL THEN x ELSE 0.5*greatest(sim, 0) + 0.5*x END,5) AS score FROM m ORDER BY score DESC, doc LIMIT 10""")
def t4(spark, d):
    """T4: the search entry: channels fused by rank, the head reranked by a blend with similarity, then the limit."""
    fused = rrf([(0.5, text_hits(spark, d, Q, 40)), (0.5, vector_hits(spark, d, 12, 40))]).select("doc", F.round("score", 9).alias("fused"))
    e = load(spark, d, "embeddings")
    j = e.join(F.broadcast(fused), F.col("vec_id") == F.col("doc"), "right").withColumn("sim", F.when(F.col("embedding").isNotNull(), F.round(cosine(F.col("embedding"), query_vector(e, 12)), 6)))
    x = minmax("fused")
    blend = F.when(F.col("sim").isNull(), x).otherwise(0.5 * F.greatest("sim", F.lit(0.0)) + 0.5 * x)
    return j.select("doc", F.round(blend, 5).alias("score")).orderBy(F.desc("score"), "doc").limit(10)


@query("v18_abstention", f"WITH b AS (SELECT q.vec_id AS query, max(round({COS},6)) AS best FROM embeddings q JOIN embeddings a ON a.vec_id <> q.vec_id AND a.label = q.label WHERE q.vec_id % 100 = 0 GROUP BY 1) SELECT query, round(1 - best,6) AS distance, 1 - best > 0.6 AS abstain FROM b")
def v18(spark, d):
    """An answer is refused where its best evidence is too far away; every 100th vector asks."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label", F.col("embedding").alias("q"))
    j = e.join(q, "label").where("vec_id <> query").select("query", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("c"))
    b = j.groupBy("query").agg(F.max("c").alias("best"))
    return b.select("query", F.round(1 - F.col("best"), 6).alias("distance"), (1 - F.col("best") > 0.6).alias("abstain"))


SYNONYMS = {"license": "permission", "token": "key", "keit": "quality"}


@query("v19_query_understanding", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(w, list_filter(list_transform(w, lambda x: CASE x WHEN 'license' THEN 'permission' WHEN 'token' THEN 'key' WHEN 'keit' THEN 'quality' END), lambda x: x IS NOT NULL)))), ' ') AS terms, len(w) AS n FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS w FROM benchmark)")
def v19(spark, d):
    """A question as its distinct words and the predicates they are synonyms of."""
    w = load(spark, d, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w"))
    syn = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    more = F.filter(F.transform("w", lambda x: syn[x]), lambda x: x.isNotNull())
    return w.select("item_id", F.array_join(F.array_sort(F.array_union("w", more)), " ").alias("terms"), F.size("w").cast("long").alias("n"))


@query("v11_observed_proxies", f"SELECT l.quality, l.toxic, arg_max(a.vec_id, (round({COS},6), -a.vec_id)) AS vec_id, max(round({COS},6)) AS sim FROM embeddings a JOIN labels l ON l.doc_id = a.vec_id, (SELECT embedding FROM embeddings WHERE vec_id=14) q GROUP BY ALL")
def v11(spark, d):
    """The observation nearest to a question in each class."""
    e = load(spark, d, "embeddings")
    j = e.join(load(spark, d, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id")
    s = j.select("quality", "toxic", "vec_id", F.round(cosine(F.col("embedding"), query_vector(e, 14)), 6).alias("c"))
    return s.groupBy("quality", "toxic").agg(F.max_by("vec_id", F.struct("c", -F.col("vec_id"))).alias("vec_id"), F.max("c").alias("sim"))


@query("v2_batch_cosine", f"SELECT a.vec_id, round({COS},4) AS wide, round({COS},3) AS narrow FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=15) q")
def v2(spark, d):
    """V2: products of a batch with a vector in double and in single precision, as matrix products over Arrow batches."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    q = np.array(e.where("vec_id = 15").first().embedding, "f8")

    def run(batches):
        for b in batches:
            m = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            wide = m.astype("f8") @ q / np.linalg.norm(m.astype("f8"), axis=1) / np.linalg.norm(q)
            narrow = (m.astype("f4") @ q.astype("f4") / np.linalg.norm(m.astype("f4"), axis=1) / np.float32(np.linalg.norm(q))).astype("f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wide), pa.array(narrow)], names=["vec_id", "w", "n"])

    s = e.mapInArrow(run, "vec_id long, w double, n double")
    return s.select("vec_id", F.round("w", 4).alias("wide"), F.round(F.when(F.abs(F.col("w") - F.col("n")) < 1e-5, F.col("w")).otherwise(F.col("n")), 3).alias("narrow"))


@query("v3_pack_unpack", "SELECT vec_id, 4*len(embedding) AS bytes, true AS same FROM embeddings")
def v3(spark, d):
    """V3: vectors packed as little-endian single floats and read again without loss."""

    def run(batches):
        for b in batches:
            packed = [np.asarray(v, "<f4").tobytes() for v in b.column(1).to_pylist()]
            same = [np.frombuffer(p, "<f4").tolist() == v for p, v in zip(packed, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in packed], pa.int64()), pa.array(same)], names=["vec_id", "bytes", "same"])

    return load(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, bytes long, same boolean")


@query("a21_mean_normalised", """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE/sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS m FROM embeddings, range(1,65) t(i) GROUP BY ALL) SELECT label, i - 1 AS i, round(m/sqrt(sum(m*m) OVER (PARTITION BY label)),5) AS x FROM c""")
def a21(spark, d):
    """Unit vectors averaged, and the mean made a unit again."""
    e = load(spark, d, "embeddings")
    unit = F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding")))
    c = e.select("label", F.posexplode(unit).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    n = c.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return c.join(n, "label").select("label", F.col("i").cast("long").alias("i"), F.round(F.col("m") / F.col("n"), 5).alias("x"))


@query("v5_chunked_embedding", """WITH w AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark), h AS (SELECT item_id, CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 4 AS chunk, CAST('0x' || substr(sha256(w), 9, 8) AS BIGINT) % 16 AS i FROM w), c AS (SELECT item_id, chunk, i, count(*) AS x FROM h GROUP BY ALL), u AS (SELECT item_id, chunk, i, x/sqrt(sum(x*x) OVER (PARTITION BY item_id, chunk)) AS x FROM c), n AS (SELECT item_id, count(DISTINCT chunk) AS k FROM u GROUP BY 1)
  SELECT item_id, i, round(sum(x)/any_value(k),5) AS x FROM u JOIN n USING (item_id) GROUP BY item_id, i""")
def v5(spark, d):
    """V5: a text over the cap is embedded by chunks, and its vector is their mean."""
    number = lambda a: F.conv(F.substring(F.sha2("w", 256), a, 8), 16, 10).cast("long")
    w = load(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    c = w.select("item_id", (number(1) % 4).alias("chunk"), (number(9) % 16).alias("i")).groupBy("item_id", "chunk", "i").agg(F.count(F.lit(1)).alias("x"))
    n = c.groupBy("item_id", "chunk").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    k = c.groupBy("item_id").agg(F.count_distinct("chunk").alias("k"))
    u = c.join(n, ["item_id", "chunk"]).groupBy("item_id", "i").agg(F.sum(F.col("x") / F.col("n")).alias("s"))
    return u.join(k, "item_id").select("item_id", "i", F.round(F.col("s") / F.col("k"), 5).alias("x"))


@query("t6_graph_seeds", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'an') OR contains(lower(n_name), 'us') ORDER BY n_nationkey LIMIT 6")
def t6(spark, d):
    """Entities whose name has a word of the question; at most six begin the walk."""
    has = F.contains(F.lower("n_name"), F.lit("an")) | F.contains(F.lower("n_name"), F.lit("us"))
    return load(spark, d, "nation").where(has).select("n_nationkey", "n_name").orderBy("n_nationkey").limit(6)


WORDS_SQL = f"list_distinct(regexp_extract_all(lower(text), '{WORD}'))"


@query("t7_support_gate", f"WITH q AS (SELECT {WORDS_SQL} AS q FROM benchmark ORDER BY item_id LIMIT 1), {bm25_sql(Q)}, h AS ({_TOP.format(k=5)}), s AS (SELECT h.doc, round(len(list_intersect(q.q, {WORDS_SQL}))/len(q.q)::DOUBLE,6) AS coverage FROM h JOIN documents d ON d.doc_id = h.doc, q) SELECT doc, coverage, coverage >= 0.5 AS supported FROM s")
def t7(spark, d):
    """How much of a question's words the five best documents cover; half is support."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)))
    q = load(spark, d, "benchmark").orderBy("item_id").limit(1).select(words("text").alias("q"))  # one row
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), words("text").alias("w"))
    j = docs.join(F.broadcast(text_hits(spark, d, Q, 5).select("doc")), "doc").join(F.broadcast(q))
    s = j.select("doc", F.round(F.size(F.array_intersect("q", "w")) / F.size("q"), 6).alias("coverage"))
    return s.withColumn("supported", F.col("coverage") >= 0.5)


@query("t9_best_span", f"""WITH {bm25_sql(Q)}, h AS ({_TOP.format(k=10)}), s AS (SELECT h.rank, unnest(string_split(regexp_replace(d.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(d.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i, h.doc FROM h JOIN documents d ON d.doc_id = h.doc),
  b AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING) AS used, contains(lower(s), 'the')::INT + contains(lower(s), 'with')::INT + contains(lower(s), 'keit')::INT AS focus FROM s) SELECT doc, arg_max(sha256(trim(s)), (focus, -i)) AS h, max(focus)::BIGINT AS focus FROM b WHERE used <= 4000 GROUP BY doc""")
def t9(spark, d):
    """Of each hit's sentences within 4,000 characters, the one with the most words of focus, the first on ties."""
    hits = text_hits(spark, d, Q, 10).select("doc")
    docs = load(spark, d, "documents").withColumnRenamed("doc_id", "doc").join(F.broadcast(hits), "doc")
    s = docs.select("doc", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("i", "s"))
    used = F.sum(F.length("s")).over(Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    focus = sum((F.contains(F.lower("s"), F.lit(w)).cast("int") for w in Q), F.lit(0))
    b = s.withColumn("used", used).where("used <= 4000").withColumn("focus", focus)
    return b.groupBy("doc").agg(F.max_by(F.sha2(F.trim("s"), 256), F.struct("focus", -F.col("i"))).alias("h"), F.max("focus").cast("long").alias("focus"))


@query("w17_trimmed_units", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents), r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS used, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM l)
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (total <= 300 OR used <= 300 - 24), '') || CASE WHEN max(total) > 300 AND count(*) FILTER (used <= 276) > 0 THEN chr(10) || '[' || (max(n) - count(*) FILTER (used <= 276)) || ' lines dropped]' ELSE '' END AS text FROM r GROUP BY doc_id""")
def w17(spark, d):
    """A unit over its budget loses whole lines from its end; a note says how many, and must fit; else nothing is left."""
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", fit_lines(F.col("text"), 300).alias("text"))


def fit_lines(text: Column, most: int, note: int = 24) -> Column:
    lines = F.split(text, "\n")
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"))

    def step(a, x):
        used = a["used"] + F.length(x) + F.when(a["n"] > 0, 1).otherwise(0)
        ok = (used <= most - note) & (a["n"] >= 0)
        stop = F.when(a["n"] < 0, a["n"]).otherwise(-1 - a["n"])  # a negative count ends the run
        return F.struct(F.when(ok, used).otherwise(a["used"]).alias("used"), F.when(ok, a["n"] + 1).otherwise(stop).alias("n"))

    kept = F.aggregate(lines, zero, step, lambda a: F.when(a["n"] < 0, -1 - a["n"]).otherwise(a["n"]))
    left = F.concat(F.array_join(F.slice(lines, F.lit(1), kept), "\n"), F.lit("\n["), (F.size(lines) - kept).cast("string"), F.lit(" lines dropped]"))
    return F.when(F.length(text) <= most, text).when(kept > 0, left).otherwise("")


@query("w21_breadth_floor", """WITH RECURSIVE g AS (SELECT source, sum(n_chars)::BIGINT AS need FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY need, source) AS i FROM g QUALIFY i <= 10), n AS (SELECT count(*) AS n FROM r),
  w AS (SELECT source, i, least(need, 100000 // n)::BIGINT AS share, 100000 - least(need, 100000 // n)::BIGINT AS remaining FROM r, n WHERE i = 1 UNION ALL SELECT r.source, r.i, least(r.need, w.remaining // (n - w.i))::BIGINT, w.remaining - least(r.need, w.remaining // (n - w.i))::BIGINT FROM w JOIN r ON r.i = w.i + 1, n) SELECT source, i, share FROM w""")
def w21(spark, d):
    """The first ten groups in turn get a fair share of what is left: remaining over the groups to come."""
    g = load(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("need")).orderBy("need", "source").limit(10)
    ten = g.agg(F.array_sort(F.collect_list(F.struct("need", "source"))).alias("g"))  # ten rows
    kind = "array<struct<source:string,i:bigint,share:bigint>>"
    zero = F.struct(F.lit(100000).cast("long").alias("left"), F.array().cast(kind).alias("out"))

    def step(a, x):
        i = F.size(a["out"]).cast("long")
        share = F.least(x["need"], F.floor(a["left"] / (F.size("g") - i)))
        return F.struct((a["left"] - share).alias("left"), F.concat(a["out"], F.array(F.struct(x["source"].alias("source"), (i + 1).alias("i"), share.alias("share"))).cast(kind)).alias("out"))

    return ten.select(F.explode(F.aggregate("g", zero, step, lambda a: a["out"])).alias("r")).select("r.*")


SECTIONS = {"fact": 600, "session": 600, "noise": 225}  # of a budget of 1,500 characters; noise has 15 % at most
CTX_SQL = f"""f AS (SELECT 'fact' AS section, p_partkey AS ref, p_name || ' is ' || p_brand AS line, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50), s AS (SELECT 'session' AS section, conv_id * 1000 + turn AS ref, substr(split_part(text, chr(10), 1), 1, 160) AS line, len(list_intersect({WORDS_SQL}, ['the','with','for']))::DOUBLE AS score FROM conversations ORDER BY score DESC, ref LIMIT 50),
  n AS (SELECT 'noise' AS section, h.doc AS ref, substr(split_part(d.text, chr(10), 1), 1, 100) AS line, round(h.score,6) AS score FROM ({_TOP.format(k=50)}) h JOIN documents d ON d.doc_id = h.doc), u AS (SELECT * FROM f UNION ALL SELECT * FROM s UNION ALL SELECT * FROM n),
  b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY section ORDER BY score DESC, ref ROWS UNBOUNDED PRECEDING) AS used FROM u)"""


def assemble(parts: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """``section, ref, line`` in order of worth while each section's budget of characters lasts; ``parts`` are short ranked lists."""
    most = F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv))[F.col("section")]
    used = F.sum(F.length("line") + 1).over(Window.partitionBy("section").orderBy(F.desc("score"), "ref").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("used", used).where(F.col("used") <= most).select("section", "ref", "line")


@query("t11_context", f"WITH {bm25_sql(Q)}, {CTX_SQL} SELECT section, ref, line FROM b WHERE used <= CASE section WHEN 'noise' THEN 225 ELSE 600 END")
def t11(spark, d):
    """A context of facts, sessions and a little noise, each within its part of the budget."""
    head = lambda n: F.substring(F.substring_index("text", "\n", 1), 1, n)
    facts = load(spark, d, "part").select(F.lit("fact").alias("section"), F.col("p_partkey").alias("ref"), F.concat_ws(" is ", "p_name", "p_brand").alias("line"), F.col("p_retailprice").alias("score")).orderBy(F.desc("score"), "ref").limit(50)
    asked = F.array(*map(F.lit, ["the", "with", "for"]))
    shared = F.size(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), asked)).cast("double")
    turns = load(spark, d, "conversations").select(F.lit("session").alias("section"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ref"), head(160).alias("line"), shared.alias("score")).orderBy(F.desc("score"), "ref").limit(50)
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), head(100).alias("line"))
    noise = docs.join(F.broadcast(text_hits(spark, d, Q, 50)), "doc").select(F.lit("noise").alias("section"), F.col("doc").alias("ref"), "line", "score")
    return assemble(facts.union(turns).union(noise), SECTIONS)


@query("t13_static_block", f"""WITH {SAID}, a AS (SELECT c, text, {LEVEL_SQL} AS level, {NORM_SQL} AS norm FROM said) SELECT * FROM (SELECT 'directive' AS kind, c AS ref, text AS line FROM a WHERE norm ORDER BY c LIMIT 50) UNION ALL SELECT * FROM (SELECT 'critical', c, text FROM a WHERE level = 'critical' ORDER BY c LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'contradiction', o_custkey, o_orderpriority FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 2 ORDER BY o_custkey, o_orderpriority LIMIT 5) UNION ALL SELECT * FROM (SELECT 'profile', min(event_id), event_type FROM events WHERE user_id = 3 GROUP BY event_type ORDER BY 2 LIMIT 15)""")
def t13(spark, d):
    """The block that is always there: norms, five critical facts, five contradictions, fifteen attributes of the profile."""
    s = said(spark, d).select(F.col("c").alias("ref"), F.col("text").alias("line"))
    kind = lambda k, rows: rows.select(F.lit(k).alias("kind"), "ref", "line")
    norms = kind("directive", s.where(standing_instruction(F.col("line"))).orderBy("ref").limit(50))
    worst = kind("critical", s.where(criticality(F.col("line"))["level"] == "critical").orderBy("ref").limit(5))
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("ref"), F.col("o_orderpriority").alias("line")).agg(F.count_distinct("o_orderstatus").alias("n")).where("n > 2")
    profile = load(spark, d, "events").where("user_id = 3").groupBy(F.col("event_type").alias("line")).agg(F.min("event_id").alias("ref")).orderBy("ref").limit(15)
    return norms.union(worst).union(kind("contradiction", o.orderBy("ref", "line").limit(5))).union(kind("profile", profile))


@query("t17_plan_context", f"WITH {bm25_sql(Q)}, h AS ({_TOP.format(k=5)}), r AS (SELECT item_id FROM benchmark WHERE contains(lower(text), 'tion') OR contains(lower(text), 'keit') ORDER BY item_id LIMIT 5), g AS (SELECT count(*) AS n FROM h) SELECT 'evidence' AS kind, doc AS ref FROM h UNION ALL SELECT 'reflection', item_id FROM r UNION ALL SELECT CASE WHEN n = 0 THEN 'verify' ELSE 'proceed' END, n FROM g")
def t17(spark, d):
    """What a plan starts from: evidence, reflections on the like, and whether to verify first."""
    h = text_hits(spark, d, Q, 5)
    has = F.contains(F.lower("text"), F.lit("tion")) | F.contains(F.lower("text"), F.lit("keit"))
    r = load(spark, d, "benchmark").where(has).select("item_id").orderBy("item_id").limit(5)
    gate = h.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 0, "verify").otherwise("proceed").alias("kind"), F.col("n").alias("ref"))
    return h.select(F.lit("evidence").alias("kind"), F.col("doc").alias("ref")).union(r.select(F.lit("reflection"), "item_id")).union(gate)


@query("f9_proper_nouns", r"WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-zäöüß,;] ([A-Z][a-zäöüß]{3,})', 1))) AS w FROM documents) SELECT w, count(*) AS docs FROM w GROUP BY w HAVING count(*) > 1")
def f9(spark, d):
    """capitalised words of content that don't begin a sentence, and how many documents have them."""
    w = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-zäöüß,;] ([A-Z][a-zäöüß]{3,})"), F.lit(1)))
    return load(spark, d, "documents").select(F.explode(w).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")


TEMPLATES = {"part": ["What is {n}?", "What kind of thing is {n}?", "Where is {n} kept?"], "place": ["Where is {n}?", "Who lives in {n}?"]}


def questions(kind: str, name: Column, host: Column | None = None, most: int = 4) -> Column:
    """The host's own questions first, then templates of the kind; the same question counts once in either case."""
    own = F.array(*(F.replace(F.lit(t), F.lit("{n}"), name) for t in TEMPLATES[kind]))
    every = own if host is None else F.concat(F.filter(host, lambda x: x.isNotNull()), own)
    lowered = F.transform(every, F.lower)
    first = F.filter(every, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


@query("f42_doc2query", "SELECT p_partkey AS id, 'part' AS kind, unnest(['What is ' || p_name || '?', 'What kind of thing is ' || p_name || '?', 'Where is ' || p_name || ' kept?']) AS question FROM part UNION ALL SELECT n_nationkey, 'place', unnest(['Where is ' || n_name || '?', 'Who lives in ' || n_name || '?']) FROM nation")
def f42(spark, d):
    """questions that a fact answers, by templates of its kind."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.explode(questions("part", F.col("p_name"))).alias("question"))
    return p.union(load(spark, d, "nation").select(F.col("n_nationkey"), F.lit("place"), F.explode(questions("place", F.col("n_name")))))


@query("u5_merged_questions", "SELECT p_partkey AS id, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN ['WHAT IS ' || upper(p_name) || '?', 'What kind of thing is ' || p_name || '?', 'Where is ' || p_name || ' kept?'] ELSE ['Why ' || p_name || '?', 'What is ' || p_name || '?', 'What kind of thing is ' || p_name || '?', 'Where is ' || p_name || ' kept?'] END, ' ') AS questions FROM part")
def u5(spark, d):
    """Questions of the host before those of templates, in order, without repeats, at most four."""
    host = F.array(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("WHAT IS "), F.upper("p_name"), F.lit("?"))).otherwise(F.concat(F.lit("Why "), F.col("p_name"), F.lit("?"))))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(questions("part", F.col("p_name"), host), " ").alias("questions"))


# plug-ins


@query("x1_sql_function", "SELECT doc_id, CAST('0x' || substr(sha256(text),1,15) AS BIGINT) AS sid FROM documents")
def x1(spark, d):
    """A scalar function registered for SQL, native and without Python."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION loom_sid(t STRING) RETURNS BIGINT RETURN CAST(conv(substring(sha2(t, 256), 1, 15), 16, 10) AS BIGINT)")
    load(spark, d, "documents").createOrReplaceTempView("_x1_docs")
    return spark.sql("SELECT doc_id, loom_sid(text) AS sid FROM _x1_docs")


@udtf(returnType="predicate: string, value: string")
class Extractor:
    """An extractor as a table function; the rules are those of the library's facts."""

    def eval(self, sentence: str):
        import re

        for predicate, rx in FACTS.items():
            if m := re.search(rx, sentence or ""):
                yield predicate, m[1]


@query("x2_extractor", f"WITH {SAID}, p(predicate, rx) AS (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in FACTS.items()) + ") SELECT c, predicate, regexp_extract(text, rx, 1) AS value FROM said, p WHERE regexp_extract(text, rx, 1) <> ''")
def x2(spark, d):
    """A plugged-in extractor joined laterally to texts."""
    spark.udtf.register("loom_extract", Extractor)
    said(spark, d).createOrReplaceTempView("_x2_said")
    return spark.sql("SELECT c, predicate, value FROM _x2_said, LATERAL loom_extract(text)")


def embedder(dims: int) -> Callable[[Column], Column]:
    """A plug-in that embeds text columns: an Arrow batch at a time, unit vectors of hashed words."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts.fillna(""):
            v = np.zeros(dims)
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dims] += 1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


@query("x3_embedder", "SELECT p_partkey, 32 AS width, true AS unit FROM part")
def x3(spark, d):
    """Vectors by a plugged-in embedder, of its width and of unit length."""
    e = load(spark, d, "part").select("p_partkey", embedder(32)(F.col("p_name")).alias("v"))
    return e.select("p_partkey", F.size("v").alias("width"), (F.abs(norm(F.col("v")) - 1) < 1e-9).alias("unit"))


class Provider(DataSource):
    """A capability provider as a data source: rows of a Parquet folder by key ranges, one partition each."""

    @classmethod
    def name(cls):
        return "loom_provider"

    def schema(self):
        return "id long, name string"

    def reader(self, schema):
        return ProviderReader(self.options)


class ProviderReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        most, parts = int(self.options["most"]), int(self.options.get("parts", "4"))
        size = -(-(most + 1) // parts)
        return [InputPartition((a, a + size)) for a in range(0, most + 1, size)]

    def read(self, partition):
        import pyarrow.dataset as ds
        from pyarrow import fs

        a, b = partition.value
        system, path = (fs.LocalFileSystem(), self.options["path"]) if "://" not in self.options["path"] else fs.FileSystem.from_uri(self.options["path"])
        rows = ds.dataset(path, filesystem=system).to_table(columns=[self.options["key"], self.options["column"]], filter=(ds.field(self.options["key"]) >= a) & (ds.field(self.options["key"]) < b))
        yield from zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def provider(spark: SparkSession, path: str, key: str, column: str, most: int) -> DataFrame:
    spark.dataSource.register(Provider)
    return spark.read.format("loom_provider").options(path=path, key=key, column=column, most=str(most)).load()


@query("x5_provider", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def x5(spark, d):
    """Records resolved through a plugged-in provider, in ranges of keys."""
    most = load(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] or 0
    return provider(spark, f"{d}/supplier.parquet", "s_suppkey", "s_name", most)
