"""Foreign stores and access: scans, sweeps, searches over several stores, identity links, and who may read what.

Access is a column expression over the row and the principal; principals and access lists are derived from
``customer``.  Stores are the given tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import load, query
from ..sources.mirror import read_mirror, work_folder, write_mirror
from .curation import checkpointed
from .retrieval import COS, cosine, query_vector
from .search import index_of


def foreign_rows(rows: DataFrame, key: str, after: int, limit: int = 1000) -> DataFrame:
    """A page of a foreign table: rows past a key, in its order; an empty page where the table has no such key."""
    if key not in rows.columns:
        return rows.limit(0)
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


@query("s7_keyset_page", "SELECT event_id, user_id, value FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def s7(spark, d):
    """A page of rows past a cursor, without an offset."""
    return foreign_rows(load(spark, d, "events"), "event_id", 500, 200).select("event_id", "user_id", "value")


@query("s12_foreign_rows", "SELECT p_partkey AS id, p_name || ' | ' || p_brand || ' | ' || p_type AS content FROM part WHERE p_partkey > 10 ORDER BY p_partkey LIMIT 1000")
def s12(spark, d):
    """Rows of a foreign table with their text columns joined, whatever they are."""
    p = foreign_rows(load(spark, d, "part"), "p_partkey", 10)
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" | ", *text_columns(p)).alias("content"))


def text_columns(rows: DataFrame) -> list[str]:
    """The columns of text, by the schema."""
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


STORES = ("customer", "nation", "part", "supplier")


@query("s13_schema_discovery", "SELECT table_name AS t, column_name AS c, row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) AS i FROM information_schema.columns WHERE table_name IN ('customer','nation','part','supplier')")
def s13(spark, d):
    """Tables and their columns, read from the files."""
    rows = [(t, f.name, i) for t in STORES for i, f in enumerate(load(spark, d, t).schema.fields, 1)]
    return spark.createDataFrame(rows, "t string, c string, i long")


@query("p12_text_columns", "SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ('customer','nation','part','supplier') AND data_type = 'VARCHAR'")
def p12(spark, d):
    """Which columns a text search reads."""
    return spark.createDataFrame([(t, c) for t in STORES for c in text_columns(load(spark, d, t))], "t string, c string")


@query("s15_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def s15(spark, d):
    """One row by its key; the filter reaches the scan."""
    return load(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice").limit(1)


@query("s20_bulk_append", "SELECT event_id // 64 AS batch, count(*) AS n, count(DISTINCT sha256(event_type || chr(31) || user_id || chr(31) || props)) AS distinct_events FROM events GROUP BY 1")
def s20(spark, d):
    """Events appended in windows of 64, with content ids by which repeats are known."""
    e = load(spark, d, "events").select(F.expr("event_id div 64").alias("batch"), F.sha2(F.concat_ws("\x1f", "event_type", "user_id", "props"), 256).alias("h"))
    return e.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("distinct_events"))


@query("s24_mirror_replay", "SELECT event_id, row_number() OVER (ORDER BY ts::DATE, event_id) AS seq FROM events")
def s24(spark, d):
    """The log replayed from its mirror: sequence numbers are dealt anew by day and id, from counts of days, not by one sort."""
    folder = work_folder(spark, "replay")
    write_mirror(load(spark, d, "events"), folder)
    e = read_mirror(spark, folder).dropDuplicates(["event_id"]).select("event_id", F.to_date("ts").alias("day"))
    n = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))  # one row a day
    place = F.row_number().over(Window.partitionBy("day").orderBy("event_id"))
    return e.withColumn("p", place).join(before, "day").select("event_id", (F.col("before") + F.col("p")).alias("seq"))


def sweep(rows: DataFrame, key: str, watermark: int, rescan: int, budget: int) -> DataFrame:
    """New rows past the watermark, then, with what is left of the budget, older ones from the rescan cursor on."""
    new = rows.where(F.col(key) > watermark).orderBy(key).limit(budget)
    used = new.agg((budget - F.count(F.lit(1))).alias("left"))  # one row
    old = rows.where((F.col(key) > rescan) & (F.col(key) <= watermark)).orderBy(key).limit(budget)
    old = old.withColumn("r", F.row_number().over(Window.orderBy(key))).join(F.broadcast(used)).where(F.col("r") <= F.col("left"))  # ``budget`` rows at most
    return new.withColumn("kind", F.lit("new")).union(old.drop("r", "left").withColumn("kind", F.lit("rescan")))


@query("s26_federation_sweep", """WITH new AS (SELECT event_id, value FROM events WHERE event_id > 900 ORDER BY event_id LIMIT 300), old AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS r FROM events WHERE event_id > 100 AND event_id <= 900)
  SELECT event_id, 'new' AS kind, value > 50 AS changed FROM new UNION ALL SELECT event_id, 'rescan', value > 50 FROM old WHERE r <= 300 - (SELECT count(*) FROM new)""")
def s26(spark, d):
    """One run of a federation sweep over both cursors, with change detection."""
    return sweep(load(spark, d, "events").select("event_id", "value"), "event_id", 900, 100, 300).select("event_id", "kind", (F.col("value") > 50).alias("changed"))


@query("s29_passage_texts", "SELECT d.doc_id, sha256(d.text) AS h FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s29(spark, d):
    """Texts of the records that hits name, from a second table, by one semi-join."""
    ids = load(spark, d, "labels").where("quality = 1").select("doc_id")
    return load(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("h"))


def any_column(rows: DataFrame, store: str, key: str, tokens: list[str], cap: int) -> DataFrame:
    """Rows of which any text column has any token; the first token in the list gives the priority."""
    text = F.lower(F.concat_ws("\x1f", *text_columns(rows)))
    priority = F.coalesce(*(F.when(F.contains(text, F.lit(t)), F.lit(i)) for i, t in enumerate(tokens)))
    return rows.select(F.lit(store).alias("store"), F.col(key).alias("id"), priority.alias("priority")).where("priority IS NOT NULL").orderBy("priority", "id").limit(cap)


SEARCHED = {"part": ("p_partkey", "p_name || chr(31) || p_brand || chr(31) || p_type"), "customer": ("c_custkey", "c_name || chr(31) || c_mktsegment"), "supplier": ("s_suppkey", "s_name")}


def _any_sql(t: str, cap: int) -> str:
    k, text = SEARCHED[t]
    case = f"CASE WHEN contains(lower({text}), 'machine') THEN 0 WHEN contains(lower({text}), 'widget') THEN 1 WHEN contains(lower({text}), '00001') THEN 2 END"
    return f"(SELECT '{t}' AS store, {k} AS id, {case} AS priority FROM {t} WHERE {case} IS NOT NULL ORDER BY priority, id LIMIT {cap})"


@query("u2_any_column_search", f"SELECT * FROM {_any_sql('part', 200)}")
def u2(spark, d):
    """Any column, any token, taken literally."""
    return any_column(load(spark, d, "part"), "part", "p_partkey", ["machine", "widget", "00001"], 200)


@query("u3_federated_union", " UNION ALL ".join(f"SELECT * FROM {_any_sql(t, 50)}" for t in SEARCHED))
def u3(spark, d):
    """Hits of three stores together; a store that can't be read adds nothing."""

    def hits(t: str) -> DataFrame | None:
        try:
            return any_column(load(spark, d, t), t, SEARCHED[t][0], ["machine", "widget", "00001"], 50)
        except Exception:  # a store that is away must not fail the others
            return None

    return reduce(DataFrame.union, [h for h in map(hits, SEARCHED) if h is not None])


@query("p13_literal_patterns", "SELECT p_partkey FROM part WHERE contains(p_brand || '_%x', '1_%') OR starts_with(p_name || '%', 'cold%') OR starts_with(p_name, 'cold')")
def p13(spark, d):
    """Tokens with wildcards in them are literal."""
    mark = F.contains(F.concat("p_brand", F.lit("_%x")), F.lit("1_%"))
    return load(spark, d, "part").where(mark | F.col("p_name").startswith("cold")).select("p_partkey")


MENTIONS = "m AS (SELECT 'customer' AS store, 'c' || c_custkey AS entity, c_nationkey || ':' || floor(c_acctbal/20)::BIGINT AS key FROM customer UNION ALL SELECT 'supplier', 's' || s_suppkey, s_nationkey || ':' || floor(s_acctbal/20)::BIGINT FROM supplier)"


def mentions(spark, d) -> DataFrame:
    """``store, entity, key``: identifiers of two stores."""
    key = lambda n, b: F.concat_ws(":", F.col(n).cast("string"), F.floor(F.col(b) / 20).cast("string"))
    c = load(spark, d, "customer").select(F.lit("customer").alias("store"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), key("c_nationkey", "c_acctbal").alias("key"))
    return c.union(load(spark, d, "supplier").select(F.lit("supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), key("s_nationkey", "s_acctbal")))


@query("j8_same_as", f"WITH {MENTIONS}, g AS (SELECT key, min(entity) AS a, max(entity) AS b FROM m GROUP BY key HAVING count(DISTINCT entity) = 2 AND count(DISTINCT store) = 2) SELECT a, b, key FROM g UNION ALL SELECT b, a, key FROM g")
def j8(spark, d):
    """A key of exactly two entities of two stores makes them the same, both ways."""
    g = mentions(spark, d).groupBy("key").agg(F.count_distinct("entity").alias("n"), F.count_distinct("store").alias("s"), F.min("entity").alias("a"), F.max("entity").alias("b")).where("n = 2 AND s = 2")
    return g.select(F.explode(F.array(F.struct("a", "b", "key"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "key"))).alias("r")).select("r.*")


@query("j9_ambiguous_duplicates", f"WITH {MENTIONS} SELECT key, min(store) AS store, count(DISTINCT entity) AS n, min(entity) AS anchor FROM m GROUP BY key HAVING count(DISTINCT entity) > 1 AND count(DISTINCT store) = 1")
def j9(spark, d):
    """Keys that several entities of one store share: not merged, reported."""
    g = mentions(spark, d).groupBy("key").agg(F.min("store").alias("store"), F.count_distinct("entity").alias("n"), F.count_distinct("store").alias("s"), F.min("entity").alias("anchor"))
    return g.where("n > 1 AND s = 1").drop("s")


def linked(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Mention rows by a configured query over registered stores."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    return spark.sql(sql)


@query("j10_linked_import", "SELECT 'supplier' AS provider, s_suppkey AS external_ref, n_name AS entity FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def j10(spark, d):
    """Links that a domain store holds, imported by its own query."""
    sql = "SELECT 'supplier' AS provider, s_suppkey AS external_ref, n_name AS entity FROM _link_supplier JOIN _link_nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0"
    return linked(spark, {"_link_supplier": load(spark, d, "supplier"), "_link_nation": load(spark, d, "nation")}, sql)


PLACES = "place AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'east' ELSE 'west' END FROM region UNION ALL SELECT 'east', 'world' UNION ALL SELECT 'west', 'world')"


def ancestors(edges: DataFrame) -> DataFrame:
    """``a, b, hops`` of the transitive closure of containment, hop by hop to the fixpoint."""
    found = front = checkpointed(edges.select("a", "b", F.lit(1).alias("hops")))
    while True:
        step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
        front = checkpointed(front.join(step, "b").select("a", F.col("c").alias("b"), (F.col("hops") + 1).alias("hops")).join(found.select("a", "b"), ["a", "b"], "left_anti").distinct())
        if front.isEmpty():
            return found
        found = checkpointed(found.union(front))


@query("j14_transitive_location", f"WITH RECURSIVE {PLACES}, w AS (SELECT a, b, 1 AS hops FROM place UNION ALL SELECT w.a, p.b, w.hops + 1 FROM w JOIN place p ON p.a = w.b) SELECT c_custkey, b AS located, hops FROM customer JOIN w ON w.a = 'n' || c_nationkey")
def j14(spark, d):
    """Where something is, up the whole chain of containment."""
    r = load(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("a"), F.when(F.col("r_regionkey") % 2 == 0, "east").otherwise("west").alias("b"))
    n = load(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("b"))
    up = r.select(F.col("b").alias("a"), F.lit("world").alias("b")).distinct()
    c = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("a"))
    return c.join(ancestors(n.union(r).union(up)), "a").select("c_custkey", F.col("b").alias("located"), "hops")


@query("j15_link_candidates", """WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, 'Supplier', 'Customer') ELSE ' ' || upper(replace(s_name, 'Supplier', 'Customer')) END AS display FROM supplier), j AS (SELECT s.s_suppkey, c.c_custkey, CASE WHEN c.c_name = s.display THEN 1.0 ELSE 0.9 END AS score, s_nationkey
  FROM s JOIN customer c ON lower(trim(s.display)) = lower(trim(c.c_name)) WHERE s.s_nationkey <> c.c_nationkey) SELECT s_suppkey, c_custkey, score::DOUBLE AS score FROM j QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey) <= 3""")
def j15(spark, d):
    """Records whose name is an entity's (1.0) or nearly (0.9), not linked yet; a few for review, none linked."""
    like = F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, like).otherwise(F.concat(F.lit(" "), F.upper(like))).alias("display"))
    tidy = lambda c: F.lower(F.trim(c))
    j = s.withColumn("k", tidy("display")).join(load(spark, d, "customer").withColumn("k", tidy("c_name")), "k").where("s_nationkey <> c_nationkey")
    j = j.withColumn("score", F.when(F.col("c_name") == F.col("display"), 1.0).otherwise(0.9))
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("score"), "s_suppkey")
    return j.withColumn("r", F.row_number().over(w)).where("r <= 3").select("s_suppkey", "c_custkey", "score")


@query("j16_merge_candidates", "WITH g AS (SELECT p_partkey, min(p_partkey) OVER w AS anchor, row_number() OVER (w ORDER BY p_partkey) AS r FROM part WINDOW w AS (PARTITION BY lower(trim(p_name)), p_brand, p_type)) SELECT p_partkey, anchor FROM g WHERE p_partkey <> anchor AND r <= 11")
def j16(spark, d):
    """Entities of one exact name in one scope, with the smallest id as anchor, at most ten a group."""
    p = load(spark, d, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"), "p_brand", "p_type")
    keys = ["name", "p_brand", "p_type"]
    anchors = p.groupBy(*keys).agg(F.min("p_partkey").alias("anchor"))
    ranked = p.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("p_partkey"))).where("r <= 11")
    return ranked.join(anchors, keys).where("p_partkey <> anchor").select("p_partkey", "anchor")


@query("j1_filtered_knn", f"SELECT a.vec_id, round({COS},5) AS sim FROM embeddings a JOIN labels l ON l.doc_id = a.vec_id AND l.quality = 1, (SELECT embedding FROM embeddings WHERE vec_id=8) q ORDER BY sim DESC, a.vec_id LIMIT 25")
def j1(spark, d):
    """Nearest vectors among those whose row passes a filter: the equality joins before scores are taken."""
    e = load(spark, d, "embeddings")
    good = load(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id")).distinct()
    s = e.join(good, "vec_id", "left_semi").select("vec_id", F.round(cosine(F.col("embedding"), query_vector(e, 8)), 5).alias("sim"))
    return s.orderBy(F.desc("sim"), "vec_id").limit(25)


@query("j2_hits_without_sessions", "SELECT d.doc_id, d.source FROM documents d WHERE list_contains(regexp_extract_all(lower(text), '[a-zàâäçéèêëîïôöùûüßáíóúñ]+'), 'the') AND (d.source IS NULL OR NOT starts_with(d.source, 'src1'))")
def j2(spark, d):
    """Text hits with their rows, without those of some sessions; a hit whose row is gone stays."""
    hits = index_of(spark, f"{d}/documents.parquet").of(["the"]).select(F.col("doc").alias("doc_id")).distinct()
    j = hits.join(load(spark, d, "documents").select("doc_id", "source"), "doc_id", "left")
    return j.where("source IS NULL OR NOT startswith(source, 'src1')")


@query("j4_outstanding", "SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j4(spark, d):
    """How many rows have no extraction of any version."""
    return load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("a17_mention_counts", f"WITH {MENTIONS} SELECT store, count(DISTINCT entity) AS entities, count(*) AS mentions FROM m GROUP BY store")
def a17(spark, d):
    """Records of each provider that mention something."""
    return mentions(spark, d).groupBy("store").agg(F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("mentions"))


@query("t21_identity_candidates", f"WITH {MENTIONS}, k AS (SELECT key, count(DISTINCT entity) AS n FROM m GROUP BY key) SELECT m.entity, 'identity' AS kind, m.store || '/' || m.key AS ref, CASE WHEN k.n = 1 THEN 'unique' WHEN k.n = 2 THEN 'pair' ELSE 'ambiguous' END AS standing FROM m JOIN k USING (key)")
def t21(spark, d):
    """A foreign hit as an identity candidate."""
    m = mentions(spark, d)
    n = m.groupBy("key").agg(F.count_distinct("entity").alias("n"))
    standing = F.when(F.col("n") == 1, "unique").when(F.col("n") == 2, "pair").otherwise("ambiguous")
    return m.join(n, "key").select("entity", F.lit("identity").alias("kind"), F.concat_ws("/", "store", "key").alias("ref"), standing.alias("standing"))


# access

OWNED = """owned AS (SELECT c_custkey AS id, 'u' || c_nationkey || ':a' || (c_custkey % 3) AS owner, c_custkey % 10 = 0 AS boxed, CASE c_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN '{"mode":"user_agents","allow":["u3:a1","u4"],"deny":["u9"]}' WHEN 2 THEN '{"mode":"user_agents","allow":[],"deny":["u3:a1"]}' ELSE '{bad' END AS acl,
  CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'retracted' END END AS status, CASE c_custkey % 5 WHEN 0 THEN 'secret' ELSE 'plain' END AS label, CASE c_custkey % 6 WHEN 0 THEN '*' WHEN 1 THEN 'support' ELSE 'billing,support' END AS purposes, c_mktsegment AS domain FROM customer)"""
ME = "u3:a1"


def owned(spark, d) -> DataFrame:
    """``id, owner, boxed, acl, status, label, purposes, domain``: rows with owners and access lists."""
    c = F.col("c_custkey")
    listed = lambda allow, deny: F.lit('{"mode":"user_agents","allow":' + allow + ',"deny":' + deny + "}")
    acl = F.when(c % 4 == 0, "private").when(c % 4 == 1, listed('["u3:a1","u4"]', '["u9"]')).when(c % 4 == 2, listed("[]", '["u3:a1"]')).otherwise("{bad")
    status = F.when(c % 3 == 0, "active").when(c % 3 == 1, "draft").when(c % 2 == 0, "retracted")
    return load(spark, d, "customer").select(
        c.alias("id"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string"), F.lit(":a"), (c % 3).cast("string")).alias("owner"), (c % 10 == 0).alias("boxed"), acl.alias("acl"), status.alias("status"),
        F.when(c % 5 == 0, "secret").otherwise("plain").alias("label"), F.when(c % 6 == 0, "*").when(c % 6 == 1, "support").otherwise("billing,support").alias("purposes"), F.col("c_mktsegment").alias("domain"),
    )


def user_of(principal: Column) -> Column:
    """What stands before the colon; the default user where there is none."""
    return F.when(F.instr(principal, ":") > 0, F.substring_index(principal, ":", 1)).otherwise("_user")


def parse_acl(acl: Column) -> Column:
    """Struct of mode, allow and deny from a mode or JSON; what can't be read is private."""
    got = F.from_json(acl, "mode string, allow array<string>, deny array<string>")
    none = F.array().cast("array<string>")
    mode = F.when(acl.isin("private", "user_agents"), acl).otherwise(F.coalesce(got["mode"], F.lit("private")))
    return F.struct(mode.alias("mode"), F.coalesce(got["allow"], none).alias("allow"), F.coalesce(got["deny"], none).alias("deny"))


def grant(acl: Column, who: str) -> Column:
    return F.struct(acl["mode"].alias("mode"), F.array_sort(F.array_union(acl["allow"], F.array(F.lit(who)))).alias("allow"), F.array_remove(acl["deny"], who).alias("deny"))


def revoke(acl: Column, who: str) -> Column:
    return F.struct(acl["mode"].alias("mode"), F.array_remove(acl["allow"], who).alias("allow"), F.array_sort(F.array_union(acl["deny"], F.array(F.lit(who)))).alias("deny"))


def acl_allows(owner: Column, boxed: Column, acl: Column, me: str) -> Column:
    """Own rows; else not denied, not boxed, and shared with all agents of the user or allowed by name."""
    a = parse_acl(acl)
    same = user_of(owner) == user_of(F.lit(me))
    return (owner == me) | (~F.array_contains(a["deny"], me) & ~boxed & ((same & (a["mode"] == "user_agents")) | F.array_contains(a["allow"], me)))


def envelope(label: Column, purposes: Column, domain: Column, purpose: str, wanted: str | None) -> Column:
    """P5: not secret, for this purpose, of the domain asked for."""
    scope = F.split(purposes, ",")
    fits = F.array_contains(scope, "*") | F.array_contains(scope, purpose)
    return (label != "secret") & fits & (F.lit(True) if wanted is None else domain == wanted)


ALLOW_SQL = """(owner = 'u3:a1' OR (NOT (acl LIKE '%"deny":[%u3:a1%') AND NOT boxed AND ((split_part(owner, ':', 1) = 'u3' AND acl LIKE '%user_agents%') OR acl LIKE '%"allow":[%u3:a1%],"deny"%')))"""
ENV_SQL = "(label <> 'secret' AND (purposes = '*' OR list_contains(string_split(purposes, ','), 'billing')))"


@query("p2_topology_ceiling", """WITH e AS (SELECT DISTINCT 'u' || s_nationkey AS reader, 'u' || ((s_nationkey + s_suppkey % 3 + 1) % 25) AS target FROM supplier), o AS (SELECT c_custkey AS id, 'u' || c_nationkey AS usr, 'u' || c_nationkey || ':a' || (c_custkey % 3) AS owner, c_custkey % 10 = 0 AS boxed FROM customer)
  SELECT id, CASE WHEN owner = 'u3:a1' THEN true WHEN boxed THEN false WHEN usr = 'u3' THEN true ELSE EXISTS (SELECT 1 FROM e WHERE e.reader = 'u3' AND e.target = o.usr) END AS readable FROM o""")
def p2(spark, d):
    """Whom a principal may read at most: itself, its user's agents, and users that an edge names; never a sandboxed owner."""
    s = load(spark, d, "supplier")
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    edges = s.select(name(F.col("s_nationkey")).alias("reader"), name((F.col("s_nationkey") + F.col("s_suppkey") % 3 + 1) % 25).alias("usr")).where(F.col("reader") == ME.split(":")[0])
    o = owned(spark, d).select("id", "owner", "boxed", user_of(F.col("owner")).alias("usr"))
    j = o.join(edges.select("usr", F.lit(True).alias("edge")).distinct(), "usr", "left")
    ok = F.when(F.col("owner") == ME, True).when(F.col("boxed"), False).when(F.col("usr") == user_of(F.lit(ME)), True).otherwise(F.coalesce("edge", F.lit(False)))
    return j.select("id", ok.alias("readable"))


@query("p3_user_of", f"WITH {OWNED} SELECT CASE WHEN id % 7 = 0 THEN '_user' ELSE split_part(owner, ':', 1) END AS usr, count(*) AS n FROM owned GROUP BY 1")
def p3(spark, d):
    """Users of principals; bare names belong to the default user."""
    o = owned(spark, d).select(user_of(F.when(F.col("id") % 7 == 0, F.lit("agent")).otherwise(F.col("owner"))).alias("usr"))
    return o.groupBy("usr").agg(F.count(F.lit(1)).alias("n"))


@query("p4_acl_updates", """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'user_agents' ELSE 'private' END AS mode, CASE c_custkey % 4 WHEN 1 THEN 'u3:a1,u4,u5' ELSE 'u5' END AS granted, CASE c_custkey % 4 WHEN 1 THEN 'u4,u9' WHEN 2 THEN 'u3:a1,u4' ELSE 'u4' END AS denied FROM customer""")
def p4(spark, d):
    """Access lists parsed, then a grant and a revocation applied."""
    a = owned(spark, d).select("id", parse_acl(F.col("acl")).alias("a"))
    return a.select("id", "a.mode", F.array_join(grant(F.col("a"), "u5")["allow"], ",").alias("granted"), F.array_join(revoke(F.col("a"), "u4")["deny"], ",").alias("denied"))


@query("p5_envelopes", f"WITH {OWNED} SELECT id FROM owned WHERE {ENV_SQL} AND domain = 'MACHINERY'")
def p5(spark, d):
    """P5: rows whose envelope allows a purpose in a domain."""
    return owned(spark, d).where(envelope(F.col("label"), F.col("purposes"), F.col("domain"), "billing", "MACHINERY")).select("id")


@query("p6_readable", f"WITH {OWNED} SELECT id FROM owned WHERE coalesce(status, 'active') IN ('active', 'draft') AND {ALLOW_SQL} AND {ENV_SQL}")
def p6(spark, d):
    """Live rows that this principal may read for this purpose."""
    o = owned(spark, d).where(F.coalesce("status", F.lit("active")).isin("active", "draft"))
    return o.where(acl_allows(F.col("owner"), F.col("boxed"), F.col("acl"), ME) & envelope(F.col("label"), F.col("purposes"), F.col("domain"), "billing", None)).select("id")


@query("p7_readable_history", f"WITH {OWNED} SELECT id, status FROM owned WHERE {ALLOW_SQL} AND {ENV_SQL}")
def p7(spark, d):
    """The same on history surfaces, whatever the status."""
    o = owned(spark, d)
    return o.where(acl_allows(F.col("owner"), F.col("boxed"), F.col("acl"), ME) & envelope(F.col("label"), F.col("purposes"), F.col("domain"), "billing", None)).select("id", "status")


@query("p8_reference_readability", f"WITH {OWNED}, r AS (SELECT event_id AS ref, user_id FROM events) SELECT ref, coalesce(o.ok, e.ok, false) AS readable FROM (SELECT ref, user_id FROM r) r LEFT JOIN (SELECT id, {ALLOW_SQL} AS ok FROM owned) o ON o.id = ref LEFT JOIN (SELECT event_id, user_id = 3 AS ok FROM events) e ON e.event_id = ref")
def p8(spark, d):
    """A bare id is a belief's or an event's; whichever is found says whether it can be read."""
    e = load(spark, d, "events").select(F.col("event_id").alias("ref"), (F.col("user_id") == 3).alias("event_ok"))
    o = owned(spark, d).select(F.col("id").alias("ref"), acl_allows(F.col("owner"), F.col("boxed"), F.col("acl"), ME).alias("belief_ok"))
    return e.join(o, "ref", "left").select("ref", F.coalesce("belief_ok", "event_ok", F.lit(False)).alias("readable"))


@query("p9_subject_grounding", """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a.b' WHEN 1 THEN '' ELSE 'user' || user_id END AS entity, CASE event_id % 7 WHEN 0 THEN 'attr_' || event_type WHEN 1 THEN 'x.' || event_type ELSE event_type END AS predicate FROM events) SELECT event_id, entity = '' OR contains(entity, '.') OR contains(predicate, '.') OR starts_with(predicate, 'attr_') AS rejected FROM s""")
def p9(spark, d):
    """Facts without a proper subject or predicate are quarantined."""
    i = F.col("event_id")
    entity = F.when(i % 5 == 0, "a.b").when(i % 5 == 1, "").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string")))
    predicate = F.when(i % 7 == 0, F.concat(F.lit("attr_"), F.col("event_type"))).when(i % 7 == 1, F.concat(F.lit("x."), F.col("event_type"))).otherwise(F.col("event_type"))
    s = load(spark, d, "events").select(i, entity.alias("e"), predicate.alias("p"))
    return s.select("event_id", ((F.col("e") == "") | F.contains("e", F.lit(".")) | F.contains("p", F.lit(".")) | F.col("p").startswith("attr_")).alias("rejected"))


@query("p14_exhaust_filter", r"SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND regexp_matches(lower(text), '^(to|the|and)\b|\b(exit code|traceback|npm|pip)\b')")
def p14(spark, d):
    """An assistant's run-logs, by their markers."""
    return load(spark, d, "conversations").where((F.col("role") == "assistant") & F.lower("text").rlike(r"^(to|the|and)\b|\b(exit code|traceback|npm|pip)\b")).select("conv_id", "turn")


@query("p18_forbidden_gate", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def p18(spark, d):
    """What equals erased content is not captured again."""
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    gone = docs.join(load(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("h")
    return docs.join(gone, "h", "left_anti").select("doc_id")
