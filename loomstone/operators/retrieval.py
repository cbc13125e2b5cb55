"""Retrieval: BM25, vector scores, fusion, diversity, rerank, gates.

Vectors stay arrays of floats and scores are array expressions on the JVM.  A query is one vector or
a bounded list of words, sent as literals; corpora are only ever scanned, aggregated or joined by key,
and every ranked list is a top-k, which Spark keeps per task before it merges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query
from .search import WORD, index_of, unit_vectors

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where the widths differ or a vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def query_vector(vectors: DataFrame, vec_id: int) -> Column:
    """The vector of one id as a literal."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*(F.lit(float(x)) for x in row[0]))


def top(rows: DataFrame, k: int, score: str = "score", key: str = "doc") -> DataFrame:
    """The ``k`` best rows with their ``rank``: score descending, then id."""
    best = rows.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def rrf(channels: list[tuple[float, DataFrame]], key: str = "doc", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: ``sum(weight / (k + rank))``."""
    parts = [c.select(key, (F.lit(w) / (k + F.col("rank"))).alias("s")) for w, c in channels]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def minmax(c: str) -> Column:
    w = Window.partitionBy()
    span = F.max(c).over(w) - F.min(c).over(w)
    return F.when(span > 0, (F.col(c) - F.min(c).over(w)) / span).otherwise(1.0)


def mmr(candidates: DataFrame, k: int, lam: float = 0.7, group: str = "group") -> DataFrame:
    """Maximal marginal relevance within each group of a bounded pool: greedy, the first wins ties.

    ``candidates`` has ``group, id, rel, embedding``; pools are top-k lists, so a group is small.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rel", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rel = pdf["rel"].to_numpy("f8")
        span = rel.max() - rel.min()
        rel = (rel - rel.min()) / span if span > 0 else np.ones(len(rel))
        v = np.stack(pdf["embedding"].to_numpy()).astype("f8")
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, left, order = np.zeros(len(v)), np.ones(len(v), bool), []
        for step in range(min(k, len(v))):
            gain = np.where(left, lam * rel - (1 - lam) * near, -np.inf)
            best = int(np.argmax(gain))
            order.append(best)
            left[best] = False
            sim = v @ v[best]
            near = sim if step == 0 else np.maximum(near, sim)
        return pd.DataFrame({group: pdf[group].iloc[0], "id": pdf["id"].iloc[order].to_numpy(), "pick": np.arange(1, len(order) + 1)})

    return candidates.groupBy(group).applyInPandas(pick, f"{group} long, id long, pick long")


def hashed_embedding(text: Column, dims: int = 256) -> Column:
    """Hashing-trick embedding: word counts signed and summed by hash, L2-normalised."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long"))
    cells = F.transform(hashes, lambda h: F.struct((h % dims).cast("int").alias("i"), F.when(F.shiftright(h, 31) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(cells, lambda c: c["i"] == i), F.lit(0.0), lambda a, c: a + c["s"]))
    return vec


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, rows: int = 1 << 15, asked: int = 1 << 10) -> DataFrame:
    """The ``k`` nearest other vectors of each query row, exactly.

    Vectors are dealt into parts of about ``rows``, queries into blocks of about ``asked``; every part meets
    every block in one task, which returns its own k best for each query, and one window merges them.
    """
    n, m = vectors.count(), queries.count()
    parts, blocks = max(-(-n // rows), min(8, n // 500), 1), max(1, -(-m // asked))
    deal = lambda df, own, count, other, others: df.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))
    v, q = deal(vectors, "p", parts, "b", blocks), deal(queries, "b", blocks, "p", parts)

    def run(key, v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query": [], "vec_id": [], "sim": []})
        a, b = (np.stack(x["embedding"].to_numpy()).astype("f8") for x in (q, v))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
        qid, vid = q["vec_id"].to_numpy(), v["vec_id"].to_numpy()
        s = np.round(a @ b.T, 6)
        s[qid[:, None] == vid[None, :]] = -2
        few = min(k, len(vid))
        order = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :few]
        out = pd.DataFrame({"query": np.repeat(qid, few), "vec_id": vid[order].ravel(), "sim": np.take_along_axis(s, order, 1).ravel()})
        return out[out["sim"] > -2]

    found = v.groupBy("p", "b").cogroup(q.groupBy("p", "b")).applyInPandas(run, "query long, vec_id long, sim double")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


COS = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[])/sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))/sqrt(list_dot_product(q.embedding::DOUBLE[],q.embedding::DOUBLE[]))"
WORDS3 = ["the", "of", "and"]
_W = WORD.replace("'", "''")


def bm25_sql(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln((n - df{i} + 0.5)/(df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2*(1 - 0.75 + 0.75*dl/avgdl))" for i in range(len(words)))
    return f"""bm_w AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '{_W}') AS w FROM documents), bm_r AS (SELECT doc, len(w) AS dl, {tf} FROM bm_w),
      bm_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM bm_r), bm25 AS (SELECT doc, {score} AS score FROM bm_r, bm_s)"""


@query("t1_bm25_search", f"WITH {bm25_sql(['the', 'with', 'for'])} SELECT doc, round(score,6) AS score FROM bm25 WHERE score > 0 ORDER BY round(score,6) DESC, doc LIMIT 20")
def t1(spark, d):
    """Full-text search by BM25, the 20 best."""
    hits = index_of(spark, f"{d}/documents.parquet").bm25(["the", "with", "for"]).select("doc", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "doc").limit(20)


@query("t1_inverted_index", f"SELECT term, count(*) AS docs, sum(tf)::BIGINT AS uses FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM documents) GROUP BY ALL) GROUP BY term HAVING count(*) > 1")
def t1b(spark, d):
    """The index's document frequencies."""
    t = index_of(spark, f"{d}/documents.parquet").postings.where("term IS NOT NULL")
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses")).where("docs > 1")


@query("t3_prefix_gate", f"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '{_W}'), lambda x: starts_with(x, 'tion') OR starts_with(x, 'keit'))) > 0")
def t3(spark, d):
    """Documents with a word that begins with one of the stems."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    return load(spark, d, "documents").where(F.exists(words, lambda w: w.startswith("tion") | w.startswith("keit"))).select("doc_id")


@query("v1_cosine", f"SELECT a.vec_id, round({COS}, 5) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=7) q")
def v1(spark, d):
    """V1/V2: similarity of every vector with a query."""
    e = load(spark, d, "embeddings")
    return e.select("vec_id", F.round(cosine(F.col("embedding"), query_vector(e, 7)), 5).alias("sim"))


@query("w2_knn_topk", f"SELECT a.vec_id, round({COS}, 5) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=3) q WHERE {COS} > 0.1 ORDER BY sim DESC, a.vec_id LIMIT 25")
def w2k(spark, d):
    """Nearest vectors above 0.1, at most 25."""
    e = load(spark, d, "embeddings")
    s = e.select("vec_id", cosine(F.col("embedding"), query_vector(e, 3)).alias("c")).where("c > 0.1").select("vec_id", F.round("c", 5).alias("sim"))
    return s.orderBy(F.desc("sim"), "vec_id").limit(25)


@query("v9_knn_of_queries", f"""SELECT query, vec_id, round(sim,4) AS sim, rank FROM (SELECT q.vec_id AS query, a.vec_id, round({COS},6) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS},6) DESC, a.vec_id) AS rank
  FROM embeddings a JOIN embeddings q ON q.vec_id % 100 = 0 AND a.vec_id <> q.vec_id) WHERE rank <= 10""")
def v9(spark, d):
    """V9: exact nearest neighbours of a query set, in blocks of queries."""
    e = load(spark, d, "embeddings")
    return knn_blocks(e, e.where("vec_id % 100 = 0"), 10).select("query", "vec_id", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("v10_proxies_per_label", f"SELECT label, round(max(sim),5) AS sim, arg_max(vec_id, (sim, -vec_id)) AS vec_id FROM (SELECT a.label, a.vec_id, round({COS},5) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=11) q WHERE a.vec_id <> 11) GROUP BY label")
def v10(spark, d):
    """The best proxy of each owner."""
    e = load(spark, d, "embeddings")
    s = e.where("vec_id <> 11").select("label", "vec_id", F.round(cosine(F.col("embedding"), query_vector(e, 11)), 5).alias("sim"))
    return s.groupBy("label").agg(F.max("sim").alias("sim"), F.max_by("vec_id", F.struct("sim", -F.col("vec_id"))).alias("vec_id"))


CENT = "cent AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1,65) t(i) GROUP BY ALL)"


@query("v14_centroid_route", f"WITH {CENT}, s AS (SELECT e.vec_id, c.label AS route, sum(e.embedding[c.i]::DOUBLE*c.m)/sqrt(sum(c.m*c.m))/sqrt(sum(e.embedding[c.i]::DOUBLE*e.embedding[c.i]::DOUBLE)) AS sim FROM embeddings e, cent c GROUP BY ALL) SELECT vec_id, arg_max(route, (round(sim,6), -route)) AS route FROM s GROUP BY vec_id")
def v14(spark, d):
    """Each vector's nearest centroid: blocks of centroids meet the vectors by key, one aggregation picks the best."""
    e = load(spark, d, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cent = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return nearest_centroid(e, cent)


def nearest_centroid(e: DataFrame, cent: DataFrame, size: int = 256) -> DataFrame:
    """``vec_id, route``: the label of the nearest row of ``cent`` (label, c), the smallest label on ties."""
    blocks = max(1, -(-cent.count() // size))
    own = cent.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("label", "c")).alias("cs"))  # about ``size`` rows each
    rows = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b")).join(own, "b")
    unit = norm(F.col("embedding"))
    sims = F.transform("cs", lambda x: F.struct(F.round(dot(F.col("embedding"), x["c"]) / norm(x["c"]) / unit, 6).alias("s"), (-x["label"]).alias("l")))
    best = rows.select("vec_id", F.array_max(sims).alias("b")).groupBy("vec_id").agg(F.max("b").alias("b"))
    return best.select("vec_id", (-F.col("b.l")).alias("route"))


@query("a20_centroids", "SELECT label, i - 1 AS i, round(avg(embedding[i]::DOUBLE),6) AS m, count(*) AS n FROM embeddings, range(1,65) t(i) GROUP BY ALL")
def a20(spark, d):
    """Running sums of an entity's vectors, as means by position."""
    e = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"), F.count(F.lit(1)).alias("n"))


@query("v15_novelty", f"SELECT q.vec_id, round(1 - greatest(0, max({COS})),4) AS novelty FROM embeddings q JOIN embeddings a ON a.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id")
def v15(spark, d):
    """One less the similarity of the nearest other vector."""
    e = load(spark, d, "embeddings")
    near = knn_blocks(e, e.where("vec_id % 100 = 0"), 1)
    return near.select(F.col("query").alias("vec_id"), F.round(1 - F.greatest(F.lit(0.0), "sim"), 4).alias("novelty"))


@query("v16_supersede_candidates", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT a.vec_id AS old_id, q.vec_id AS new_id, round({COS},4) AS sim FROM e a JOIN e q ON a.label=q.label AND a.r BETWEEN q.r-50 AND q.r-1 WHERE round({COS},6) >= 0.3""")
def v16(spark, d):
    """Of an entity's 50 facts before, those that are near enough.  Facts are numbered within the entity by counts of blocks of ids."""
    e = load(spark, d, "embeddings").withColumn("c", F.floor(F.col("vec_id") / 1000))
    n = e.groupBy("label", "c").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("label", "c", (F.sum("n").over(Window.partitionBy("label").orderBy("c")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("label", "c").orderBy("vec_id"))
    e = e.withColumn("p", place).join(before, ["label", "c"]).select("label", "vec_id", "embedding", (F.col("before") + F.col("p")).alias("r"))
    e = e.withColumn("b", F.floor(F.col("r") / 50))
    old = e.select("label", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"), F.col("r").alias("old_r"), F.col("vec_id").alias("old_id"), F.col("embedding").alias("o"))
    j = e.join(old, ["label", "b"]).where("old_r BETWEEN r - 50 AND r - 1")
    s = j.select("old_id", F.col("vec_id").alias("new_id"), cosine(F.col("embedding"), F.col("o")).alias("sim")).where(F.round("sim", 6) >= 0.3)
    return s.withColumn("sim", F.round("sim", 4))


@query("f58_hamming", "SELECT a.vec_id, list_sum(list_transform(range(1,65), lambda i: CASE WHEN (a.embedding[i] > 0) <> (q.embedding[i] > 0) THEN 1 ELSE 0 END))::BIGINT AS hamming FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=5) q")
def f58(spark, d):
    """sign bits packed into one number, compared by bit count."""
    e = load(spark, d, "embeddings")
    bits = lambda v: F.aggregate(F.transform(v, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))
    q = bits(query_vector(e, 5))
    return e.select("vec_id", F.bit_count(bits(F.col("embedding")).bitwiseXOR(q)).cast("long").alias("hamming"))


@query("w3_rrf_fusion", f"""WITH {bm25_sql(WORDS3)}, f AS (SELECT doc, row_number() OVER (ORDER BY round(score,6) DESC, doc) AS rank FROM bm25 WHERE score > 0 QUALIFY rank <= 40),
  v AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM (SELECT a.vec_id, round({COS},6) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=1) q) QUALIFY rank <= 40)
  SELECT doc, round(sum(s),6) AS score FROM (SELECT doc, 0.4/(60+rank) AS s FROM f UNION ALL SELECT doc, 0.6/(60+rank) FROM v) GROUP BY doc""")
def w3(spark, d):
    """Full-text and vector channels fused by reciprocal rank."""
    return hybrid(spark, d, WORDS3, 1, 40).select("doc", F.round("score", 6).alias("score"))


def hybrid(spark, d, words, vec_id, k) -> DataFrame:
    f = top(index_of(spark, f"{d}/documents.parquet").bm25(words).withColumn("score", F.round("score", 6)), k)
    e = load(spark, d, "embeddings")
    v = top(e.select(F.col("vec_id").alias("doc"), F.round(cosine(F.col("embedding"), query_vector(e, vec_id)), 6).alias("score")), k)
    return rrf([(0.4, f), (0.6, v)])


@query("w6_rerank_blend", f"""WITH c AS (SELECT d.doc_id, d.n_chars::DOUBLE AS fused, round({COS},6) AS sim FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) d LEFT JOIN embeddings a ON a.vec_id=d.doc_id LEFT JOIN (SELECT embedding FROM embeddings WHERE vec_id=6) q ON true),
  m AS (SELECT *, (fused-min(fused) OVER ())/(max(fused) OVER ()-min(fused) OVER ()) AS f FROM c) SELECT doc_id, round(CASE WHEN sim IS NULL THEN f ELSE 0.5*greatest(sim,0)+0.5*f END,6) AS blended FROM m""")
def w6(spark, d):
    """The 50 best of a list reranked by a blend of their own score and similarity; a row without a vector keeps its score."""
    head = load(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("fused")).orderBy(F.desc("fused"), "doc_id").limit(50)
    e = load(spark, d, "embeddings")
    near = e.join(F.broadcast(head), F.col("vec_id") == F.col("doc_id"), "right").withColumn("sim", F.when(F.col("embedding").isNotNull(), F.round(cosine(F.col("embedding"), query_vector(e, 6)), 6)))
    blend = F.when(F.col("sim").isNull(), minmax("fused")).otherwise(0.5 * F.greatest("sim", F.lit(0.0)) + 0.5 * minmax("fused"))
    return near.select("doc_id", F.round(blend, 6).alias("blended"))


@query("w4_mmr_select")
def w4(spark, d):
    """Diverse picks among each label's 30 vectors nearest to a query (greedy, so no SQL)."""
    e = load(spark, d, "embeddings")
    s = e.select(F.col("label").cast("long").alias("group"), F.col("vec_id").alias("id"), cosine(F.col("embedding"), query_vector(e, 2)).alias("rel"), "embedding")
    w = Window.partitionBy("group").orderBy(F.desc("rel"), "id")
    return mmr(s.withColumn("r", F.row_number().over(w)).where("r <= 30").drop("r"), 10)


@query("w7_cap_per_session", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def w7(spark, d):
    """At most three excerpts of a session."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, d, "documents").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "doc_id", "n_chars")


@query("w8_tie_buckets", "SELECT event_id, CAST(round(value*10) AS BIGINT) AS bucket, row_number() OVER (ORDER BY round(value*10) DESC, event_id) AS pos FROM (SELECT * FROM events WHERE event_type='error')")
def w8(spark, d):
    """Scores that round alike share a bucket; order is by bucket, then id.  Ranks are counted by bucket, not by one global sort."""
    e = load(spark, d, "events").where("event_type='error'").select("event_id", F.round(F.col("value") * 10).cast("long").alias("bucket"))
    n = e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("bucket"))) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("event_id"))
    return e.withColumn("p", place).join(before, "bucket").select("event_id", "bucket", (F.col("before") + F.col("p")).alias("pos"))


@query("w9_tie_aware_head", "SELECT event_id, value FROM events WHERE event_type='purchase' QUALIFY rank() OVER (ORDER BY round(value) DESC) <= 5")
def w9(spark, d):
    """The first five and everything tied with the fifth."""
    e = load(spark, d, "events").where("event_type='purchase'").withColumn("b", F.round("value"))
    fifth = e.select("b").orderBy(F.desc("b")).limit(5).agg(F.min("b").alias("low"))
    return e.join(F.broadcast(fifth), F.col("b") >= F.col("low")).select("event_id", "value")


@query("w10_modal_share", "WITH h AS (SELECT source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20), c AS (SELECT source, count(*) AS n FROM h GROUP BY source) SELECT arg_max(source, (n, source)) AS modal, max(n) AS n, round(max(n)/sum(n),6) AS share FROM c")
def w10(spark, d):
    """The share of the most common session in the head."""
    h = load(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(20).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return h.agg(F.max_by("source", F.struct("n", "source")).alias("modal"), F.max("n").alias("m"), F.round(F.max("n") / F.sum("n"), 6).alias("share")).withColumnRenamed("m", "n")


@query("w11_neighbour_window", "SELECT c.conv_id, c.turn, abs(c.turn - a.turn) AS distance FROM conversations c JOIN (SELECT conv_id, min(turn) + 1 AS turn FROM conversations GROUP BY conv_id) a ON c.conv_id=a.conv_id AND c.turn BETWEEN a.turn-2 AND a.turn+2")
def w11(spark, d):
    """The turns around an anchor of each session."""
    c = load(spark, d, "conversations").select("conv_id", "turn")
    a = c.groupBy("conv_id").agg((F.min("turn") + 1).alias("anchor"))
    j = c.join(a, "conv_id").withColumn("distance", F.abs(F.col("turn") - F.col("anchor")))
    return j.where("distance <= 2").select("conv_id", "turn", "distance")


@query("w12_topic_shift", f"""WITH p AS (SELECT a.vec_id, a.label, round({COS},6) AS c FROM embeddings a LEFT JOIN (SELECT *, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) q ON q.nxt=a.vec_id)
  SELECT vec_id, label, sum(CASE WHEN c < 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM p""")
def w12(spark, d):
    """Segments that begin where a vector differs from the one before."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = load(spark, d, "embeddings").withColumn("prev", F.lag("embedding").over(w))
    cut = F.when(F.col("prev").isNotNull() & (F.round(cosine(F.col("embedding"), F.col("prev")), 6) < 0.35), 1).otherwise(0)
    return e.withColumn("cut", cut).select("vec_id", "label", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


@query("w18_container_collapse", r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host, length(html) AS score FROM pages)
  SELECT host, count(*) AS n, arg_max(page_id, (score, -page_id)) AS best, max(score) AS score FROM h GROUP BY host""")
def w18(spark, d):
    """The best hit of each container and how many it stands for."""
    h = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)/", 1).alias("host"), F.length("html").cast("long").alias("s"))
    return h.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max_by("page_id", F.struct("s", -F.col("page_id"))).alias("best"), F.max("s").alias("score"))


@query("w16_budget_packing", """SELECT source, doc_id, least(n_chars, 20000 - before)::BIGINT AS taken FROM (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM documents) WHERE before < 20000""")
def w16(spark, d):
    """Units taken in order while the budget lasts; the one that crosses it is clipped."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    p = load(spark, d, "documents").select("source", "doc_id", "n_chars", F.coalesce(F.sum("n_chars").over(w), F.lit(0)).alias("before"))
    return p.where("before < 20000").select("source", "doc_id", F.least("n_chars", 20000 - F.col("before")).alias("taken"))


@query("w22_last_identical", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn DESC) = 1")
def w22(spark, d):
    """Of identical outputs only the newest stays."""
    c = load(spark, d, "conversations")
    return c.groupBy("conv_id", "role", "text").agg(F.max("turn").alias("turn")).select("conv_id", "turn", "role")


@query("v17_answer_support", f"SELECT a.label, round(max({COS}),5) AS best, max(round({COS},6)) >= 0.3 AS supported FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=9) q WHERE a.vec_id <> 9 GROUP BY a.label")
def v17(spark, d):
    """Whether any evidence is near enough to an answer."""
    e = load(spark, d, "embeddings")
    s = e.where("vec_id <> 9").select("label", cosine(F.col("embedding"), query_vector(e, 9)).alias("c"))
    return s.groupBy("label").agg(F.round(F.max("c"), 5).alias("best"), (F.max(F.round("c", 6)) >= 0.3).alias("supported"))


@query("u1_token_union", """SELECT doc_id, min(p) AS priority FROM (SELECT doc_id, 0 AS p FROM documents WHERE contains(lower(text),'license') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(lower(text),'token') UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(lower(text),'keit')) GROUP BY doc_id""")
def u1(spark, d):
    """Any-token search, longest token first; one scan gives each row its best priority."""
    t = F.lower("text")
    p = F.when(F.contains(t, F.lit("license")), 0).when(F.contains(t, F.lit("token")), 1).when(F.contains(t, F.lit("keit")), 2)
    return load(spark, d, "documents").select("doc_id", p.alias("priority")).where("priority IS NOT NULL")


@query("u7_token_jaccard", f"""WITH s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{_W}')) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
  SELECT conv_id, turn, round(len(list_intersect(w,b))/greatest(1,len(list_distinct(list_concat(w,b))))::DOUBLE,6) AS jaccard FROM p WHERE b IS NOT NULL""")
def u7(spark, d):
    """Word-set similarity of each turn with the one before."""
    c = load(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w"))
    p = c.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    j = F.size(F.array_intersect("w", "b")) / F.greatest(F.lit(1), F.size(F.array_union("w", "b")))
    return p.select("conv_id", "turn", F.round(j, 6).alias("jaccard"))


@query("v13_stored_scores", f"SELECT a.vec_id, round({COS}, 5) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=13) q")
def v13(spark, d):
    """Scores of all observed vectors from the stored copy of unit length, kept while the table stays the same."""
    v = unit_vectors(spark, f"{d}/embeddings.parquet")
    asked = F.array(*(F.lit(x) for x in v.where("vec_id = 13").first()["unit"]))
    return v.select("vec_id", F.round(F.aggregate(F.zip_with("unit", asked, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 5).alias("score"))
