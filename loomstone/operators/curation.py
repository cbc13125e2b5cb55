"""Curation sweeps: joins, consistency, identity, derivation, graph walks, decay, queues.

Graph walks are bounded by depth or iterate to a fixpoint with a checkpointed frontier; neighbours
are joined by key, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query
from ..sources.mirror import shared_folder

LADDER = ("verbatim", "gist", "parametric_only", "tombstone")  # fixed values: fidelity from high to low


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder (a temporary one only where none is set)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def can_read(owner: Column, principal: Column, mode: Column, allow: Column, deny: Column, sandboxed: Column) -> Column:
    """Row-level access: deny wins; a sandboxed owner is never read by others; else own, shared or allowed."""
    same_user = F.substring_index(owner, ":", 1) == F.substring_index(principal, ":", 1)
    own = owner == principal
    ceiling = own | (same_user & ~sandboxed)
    return ceiling & ~F.array_contains(deny, principal) & (own | (mode == "user_agents") | F.array_contains(allow, principal))


def overlaps(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Whether half-open intervals meet; a null end is open."""
    return (a_until.isNull() | b_from.isNull() | (b_from < a_until)) & (b_until.isNull() | a_from.isNull() | (a_from < b_until))


def identifier_join(left: DataFrame, right: DataFrame, key: str, entity: str) -> DataFrame:
    """Rows of ``left`` with the one entity that holds their key; keys of several entities are ambiguous and drop out."""
    held = right.groupBy(key).agg(F.min(entity).alias(entity), F.max(entity).alias("_hi")).where(F.col(entity) == F.col("_hi")).drop("_hi")
    return left.join(held, key)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node, hops`` of all nodes within ``depth`` undirected hops of the seeds (column ``node``)."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    seen = frontier = checkpointed(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, depth + 1):
        new = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = checkpointed(new.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.union(frontier)  # of written parts: nothing is computed again
    return seen


def roots(links: DataFrame, most: int = 64) -> DataFrame:
    """``node, root``: where chains ``node -> to`` end, by pointer doubling (a chain of n takes log2 n rounds)."""
    step = checkpointed(links.select("node", F.col("to").alias("root")))
    for _ in range(most):
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = checkpointed(step.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("node", "root")
        step = new.select("node", "root")
    return step


def chain_ends(links: DataFrame) -> DataFrame:
    """``node, root``: where chains ``node -> to`` (one row a node) end; chains that run into a circle have no end.

    Pointers double, so a chain of n takes log2 n rounds, and a round moves the open chains only.  While a chain
    that ends is open, each round closes some node of it, so a round that closes none has circles left.
    """
    opened = checkpointed(links.select("node", F.col("to").alias("root"), F.lit(True).alias("open")))
    n, closed = opened.count(), None
    while n:
        known = opened if closed is None else opened.union(closed)
        nxt = known.select(F.col("node").alias("root"), F.col("root").alias("further"), F.col("open").alias("ahead"))
        new = checkpointed(opened.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.coalesce("ahead", F.lit(False)).alias("open")))
        closed = new.where("NOT open") if closed is None else closed.union(new.where("NOT open"))
        opened, before = new.where("open"), n
        n = opened.count()
        if n == before:
            break
    return (opened.where("NOT open") if closed is None else closed).select("node", "root")


COMPACT = 8  # rounds of a walk after which its parts are written as one


def follow(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node``: all that ``edges`` (``belief`` rests on ``support``) reach from ``start``, round by round."""
    gone, frontier, rounds = start, start, 0
    while not frontier.isEmpty():
        new = edges.join(frontier, F.col("support") == F.col("node"), "left_semi").select(F.col("belief").alias("node")).distinct()
        frontier = checkpointed(new.join(gone, "node", "left_anti"))
        gone, rounds = gone.union(frontier), rounds + 1  # of written parts: nothing is computed again
        gone = gone if rounds % COMPACT else checkpointed(gone)
    return gone


def cascade(edges: DataFrame, retracted: DataFrame) -> DataFrame:
    """All dependents of retracted nodes (``belief`` rests on ``support``), to the fixpoint.

    Only nodes that are supports themselves are walked.  Those of one support are chains, whose ends are found by
    pointer doubling; what is walked round by round are the nodes of several supports, over the chains' ends.
    """
    seeds = checkpointed(retracted.select("node").distinct())
    e = edges.select("belief", "support")
    inner = e.where("belief <> support").join(e.select(F.col("support").alias("belief")).distinct(), "belief", "left_semi").join(seeds.withColumnRenamed("node", "belief"), "belief", "left_anti")
    held = checkpointed(inner.groupBy("belief").agg(F.min("support").alias("support"), F.max("support").alias("last")))
    ends = chain_ends(held.where("support = last").select(F.col("belief").alias("node"), F.col("support").alias("to")))
    several = held.where("support <> last").select("belief")
    tops = seeds
    if not several.isEmpty():
        over = inner.join(several, "belief", "left_semi").join(ends.withColumnRenamed("node", "support"), "support", "left")
        tops = follow(checkpointed(over.select("belief", F.coalesce("root", "support").alias("support")).where("belief <> support").distinct()), seeds)
    gone = tops.union(ends.join(tops.withColumnRenamed("node", "root"), "root", "left_semi").select("node"))
    return seeds.union(e.join(gone, F.col("support") == F.col("node"), "left_semi").select("belief")).distinct()


def running_max_calibration(buckets: DataFrame) -> DataFrame:
    """``bucket, n, correct`` -> Laplace-smoothed precision, made monotone by a running maximum."""
    p = (F.col("correct") + 1) / (F.col("n") + 2)
    return buckets.withColumn("calibrated", F.round(F.max(p).over(Window.orderBy("bucket")), 6))


@query("p1_row_security", """WITH r AS (SELECT c_custkey, 'u' || (c_nationkey % 3) || ':a' || (c_custkey % 4) AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'user_agents' ELSE 'private' END AS mode, CASE WHEN c_custkey % 5 = 0 THEN ['u1:a2'] ELSE [] END AS allow, CASE WHEN c_custkey % 7 = 0 THEN ['u1:a2'] ELSE [] END AS deny, c_custkey % 11 = 0 AS boxed FROM customer)
  SELECT c_custkey, owner FROM r WHERE (owner='u1:a2' OR (split_part(owner,':',1)='u1' AND NOT boxed)) AND NOT list_contains(deny,'u1:a2') AND (owner='u1:a2' OR mode='user_agents' OR list_contains(allow,'u1:a2'))""")
def p1(spark, d):
    """The access predicate pushed into the scan as one column expression."""
    k = F.col("c_custkey")
    r = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("u"), (F.col("c_nationkey") % 3).cast("string"), F.lit(":a"), (k % 4).cast("string")).alias("owner"))
    me = F.lit("u1:a2")
    none = F.array().cast("array<string>")
    mode = F.when(k % 3 == 0, "user_agents").otherwise("private")
    return r.where(can_read(F.col("owner"), me, mode, F.when(k % 5 == 0, F.array(me)).otherwise(none), F.when(k % 7 == 0, F.array(me)).otherwise(none), k % 11 == 0))


@query("p10_abandoned_branch", "SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, max(turn) - 1 AS keep FROM conversations GROUP BY conv_id) k USING (conv_id) WHERE c.turn <= k.keep")
def p10(spark, d):
    """P10: rows after a session's branch point are left out."""
    c = load(spark, d, "conversations").select("conv_id", "turn")
    return c.join(c.groupBy("conv_id").agg((F.max("turn") - 1).alias("keep")), "conv_id").where("turn <= keep").select("conv_id", "turn")


@query("j3_unextracted", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=1)")
def j3(spark, d):
    """Rows without an extraction at this version."""
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").where("quality=1").select("doc_id"), "doc_id", "left_anti")


@query("j5_exists_counts", "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey=c.c_custkey AND o.o_orderstatus='F') GROUP BY c_mktsegment")
def j5(spark, d):
    """Counts of rows that have a pointer."""
    has = load(spark, d, "orders").where("o_orderstatus='F'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(has, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("j6_retention_guard", "SELECT o_orderkey FROM orders o WHERE o_orderstatus='F' AND o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l.l_returnflag='R')")
def j6(spark, d):
    """Old rows that nothing refers to any more."""
    used = load(spark, d, "lineitem").where("l_returnflag='R'").select(F.col("l_orderkey").alias("o_orderkey"))
    old = load(spark, d, "orders").where("o_orderstatus='F' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").select("o_orderkey")
    return old.join(used, "o_orderkey", "left_anti")


@query("j7_identifier_join", r"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+'))) AS key, source FROM documents), h AS (SELECT key, min(source) AS source, count(DISTINCT source) AS n FROM m GROUP BY key)
  SELECT m.doc_id, m.key, h.source AS entity FROM m JOIN h USING (key) WHERE h.n = 1""")
def j7(spark, d):
    """Identifiers in records, joined to the one entity that holds them."""
    keys = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0)))
    m = load(spark, d, "documents").select("doc_id", "source", F.explode(keys).alias("key"))
    return identifier_join(m.select("doc_id", "key"), m.select("key", F.col("source").alias("entity")), "key", "entity").select("doc_id", "key", "entity")


@query("j11_entity_records", "SELECT c.c_custkey, o.o_orderkey, coalesce(o.o_orderdate, TIMESTAMP '1970-01-01') AS at FROM customer c JOIN orders o ON o.o_custkey=c.c_custkey QUALIFY row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey) <= 5")
def j11(spark, d):
    """The newest records of an entity."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"))
    w = Window.partitionBy("c_custkey").orderBy(F.desc("at"), "o_orderkey")
    j = load(spark, d, "customer").select("c_custkey").join(o, "c_custkey")
    return j.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@query("j12_interval_overlap", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_shipdate < b.l_shipdate + INTERVAL 3 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 3 DAY")
def j12(spark, d):
    """Pairs of a key whose intervals meet: an equality for the shuffle, the range as residual."""
    three = F.expr("INTERVAL 3 DAYS")
    rows = load(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_shipdate").alias("f"), (F.col("l_shipdate") + three).alias("u"))
    a, b = rows.alias("a"), rows.alias("b")
    j = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.n") < F.col("b.n")))
    return j.where(overlaps(F.col("a.f"), F.col("a.u"), F.col("b.f"), F.col("b.u"))).select("a.l_orderkey", F.col("a.n").alias("a"), F.col("b.n").alias("b"))


@query("j13_rule_join", """WITH a AS (SELECT o_custkey AS s, min(o_orderkey) AS id, min(o_totalprice) AS v, min(o_orderdate) AS at FROM orders WHERE o_orderstatus='P' GROUP BY 1 HAVING count(*) = 1), b AS (SELECT o_custkey AS s, min(o_orderkey) AS id, min(o_totalprice) AS v, min(o_orderdate) AS at FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1 HAVING count(*) = 1)
  SELECT a.s, a.id AS left_id, b.id AS right_id, round(least(0.75, 0.9*least(a.v, b.v)/200000.0),6) AS confidence FROM a JOIN b ON a.s=b.s WHERE a.at < b.at + INTERVAL 400 DAY AND b.at < a.at + INTERVAL 400 DAY""")
def j13(spark, d):
    """A fact derived from two premises of a subject, each the only one of its predicate, whose intervals meet.

    Premises are reduced to one row of a subject before the join, so it is linear; confidence is 0.9 of the weaker, at most 0.75.
    """
    o = load(spark, d, "orders")

    def premise(rows: DataFrame) -> DataFrame:
        g = rows.groupBy(F.col("o_custkey").alias("s")).agg(F.min("o_orderkey").alias("id"), F.min("o_totalprice").alias("v"), F.min("o_orderdate").alias("at"), F.count(F.lit(1)).alias("n"))
        return g.where("n = 1").withColumn("until", F.col("at") + F.expr("INTERVAL 400 DAYS"))

    a, b = premise(o.where("o_orderstatus = 'P'")).alias("a"), premise(o.where("o_orderpriority = '1-URGENT'")).alias("b")
    j = a.join(b, F.col("a.s") == F.col("b.s")).where(overlaps(F.col("a.at"), F.col("a.until"), F.col("b.at"), F.col("b.until")))
    return j.select("a.s", F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.round(F.least(F.lit(0.75), 0.9 * F.least("a.v", "b.v") / 200000.0), 6).alias("confidence"))


GRAPH = "SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


def graph(spark, d) -> DataFrame:
    e = lambda t, p, k, q, v: load(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("a"), F.concat(F.lit(q), F.col(v).cast("string")).alias("b"))
    return e("customer", "c", "c_custkey", "n", "c_nationkey").union(e("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(e("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query("j17_graph_hops", f"""WITH RECURSIVE e AS ({GRAPH}), u AS (SELECT a,b FROM e UNION ALL SELECT b,a FROM e), w AS (SELECT 'c1' AS node, 0 AS hops UNION SELECT u.b, w.hops+1 FROM w JOIN u ON u.a=w.node WHERE w.hops < 3) SELECT node, min(hops) AS hops FROM w GROUP BY node""")
def j17(spark, d):
    """Neighbours within three hops."""
    return reach(graph(spark, d), spark.createDataFrame([("c1",)], "node string"), 3)


@query("j19_merge_roots", """WITH RECURSIVE l AS (SELECT p_partkey AS node, p_partkey // 2 AS nxt FROM part WHERE p_partkey > 1), w AS (SELECT node, nxt AS root FROM l UNION ALL SELECT w.node, l.nxt FROM w JOIN l ON l.node=w.root) SELECT node, min(root) AS root FROM w GROUP BY node""")
def j19(spark, d):
    """The survivor at the end of every merge chain, by pointer doubling."""
    return roots(load(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("to")))


@query("r11_cascade", """WITH RECURSIVE e AS (SELECT o_orderkey AS belief, o_custkey AS support FROM orders), g AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 50 = 0 UNION SELECT e.belief FROM e JOIN g ON e.support=g.node) SELECT node FROM g""")
def r11(spark, d):
    """Everything that rests on what was retracted, to the fixpoint."""
    edges = load(spark, d, "orders").select(F.col("o_orderkey").alias("belief"), F.col("o_custkey").alias("support"))
    return cascade(edges, load(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node")))


@query("a3_calibration", """WITH b AS (SELECT floor(least(value/100.0, 0.999)*10)/10 AS bucket, count(*) AS n, count(*) FILTER (event_type='purchase') AS correct FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1) SELECT bucket, n, correct, round(max((correct+1)/(n+2)) OVER (ORDER BY bucket),6) AS calibrated FROM b""")
def a3(spark, d):
    """A3-A5: calibration counters by bucket and their running maximum (ten buckets)."""
    b = F.floor(F.least(F.col("value") / 100.0, F.lit(0.999)) * 10) / 10
    g = load(spark, d, "events").where("value BETWEEN 0 AND 100").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("correct"))
    return running_max_calibration(g)


@query("a6_multi_value", "SELECT event_type, count(*) AS entities FROM (SELECT event_type, user_id FROM events GROUP BY ALL HAVING count(DISTINCT props) > 1) GROUP BY event_type")
def a6(spark, d):
    """Predicates with several values of an entity."""
    g = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count_distinct("props").alias("n")).where("n > 1")
    return g.groupBy("event_type").agg(F.count(F.lit(1)).alias("entities"))


@query("a8_consistency", "SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS n_values, min(o_orderkey) AS oldest FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")
def a8(spark, d):
    """Keys of single cardinality that hold several values."""
    g = load(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("n_values"), F.min("o_orderkey").alias("oldest"))
    return g.where("n_values > 1")


@query("a9_ghost_facts", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > 200000 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l.l_returnflag='A') ORDER BY o_orderkey LIMIT 200")
def a9(spark, d):
    """A page of strong facts that were never confirmed."""
    confirmed = load(spark, d, "lineitem").where("l_returnflag='A'").select(F.col("l_orderkey").alias("o_orderkey"))
    strong = load(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")
    return strong.join(confirmed, "o_orderkey", "left_anti").orderBy("o_orderkey").limit(200)


@query("a10_recall_gap", "SELECT event_type, round(count(*) FILTER (value < 10)/count(*)::DOUBLE,6) AS gap FROM events GROUP BY event_type")
def a10(spark, d):
    """Misses over tries."""
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.count_if(F.col("value") < 10) / F.count(F.lit(1)), 6).alias("gap"))


@query("a15_summary_map", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, min(doc_id) AS first_id, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def a15(spark, d):
    """Summary by provider."""
    return load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first_id"), F.sum("n_chars").alias("chars"))


@query("a16_date_span", "SELECT o_orderstatus, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1")
def a16(spark, d):
    """The span of dates."""
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))


@query("a18_queue_counts", "SELECT event_type, user_id % 4 AS status, count(*) AS n, grouping(user_id % 4)::BIGINT AS is_total FROM events GROUP BY GROUPING SETS ((event_type, user_id % 4), (event_type))")
def a18(spark, d):
    """Counts by task and status with the roll-up by task, in one aggregation."""
    e = load(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("status"))
    r = e.rollup("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return r.where("g < 3").select("event_type", "status", "n", F.col("g").cast("long").alias("is_total"))


@query("a19_entity_digest", """WITH v AS (SELECT DISTINCT user_id, event_type || '=' || CAST(json_extract_string(props,'$.k') AS BIGINT) % 10 AS x FROM events), n AS (SELECT user_id, list_sort(list(x)) AS xs FROM v GROUP BY 1)
  SELECT user_id, array_to_string(xs[1:5], '; ') || CASE WHEN len(xs) > 5 THEN '; +' || (len(xs)-5) || ' more' ELSE '' END AS digest FROM n WHERE len(xs) >= 3""")
def a19(spark, d):
    """One line for each entity with three facts or more."""
    x = F.concat_ws("=", "event_type", (F.get_json_object("props", "$.k").cast("long") % 10).cast("string"))
    g = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(x)).alias("xs")).where(F.size("xs") >= 3)  # a set of 50 values at most
    more = F.when(F.size("xs") > 5, F.concat(F.lit("; +"), (F.size("xs") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("user_id", F.concat(F.array_join(F.slice("xs", 1, 5), "; "), more).alias("digest"))


@query("a25_apportionment", """WITH w AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), q AS (SELECT event_type, n, 100*n//(SELECT sum(n) FROM w) AS base, (100*n)%(SELECT sum(n) FROM w) AS rest FROM w)
  SELECT event_type, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, event_type) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM q""")
def a25(spark, d):
    """A budget of 100 shared by largest remainder (one row per class)."""
    w = load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()
    q = w.withColumn("total", F.sum("n").over(all_)).selectExpr("event_type", "100*n div total AS base", "(100*n) % total AS rest")
    left = 100 - F.sum("base").over(all_)
    return q.select("event_type", (F.col("base") + F.when(F.row_number().over(Window.orderBy(F.desc("rest"), "event_type")) <= left, 1).otherwise(0)).cast("long").alias("quota"))


@query("l5_enqueue_dedup", "SELECT event_type AS task, user_id AS payload, min(event_id) AS job FROM events GROUP BY ALL HAVING count(*) FILTER (value > 90) = 0")
def l5(spark, d):
    """Identical pending jobs collapse, running ones are not queued again."""
    e = load(spark, d, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("payload"), "event_id", "value")
    running = e.where("value > 90").select("task", "payload").distinct()
    return e.groupBy("task", "payload").agg(F.min("event_id").alias("job")).join(running, ["task", "payload"], "left_anti")


@query("l11_decay", """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' OR age <= 90 THEN 'verbatim' WHEN age <= 180 THEN 'gist' WHEN age <= 360 THEN 'parametric_only' ELSE 'tombstone' END AS fidelity FROM (SELECT *, datediff('day', o_orderdate, TIMESTAMP '1998-08-02') AS age FROM orders)""")
def l11(spark, d):
    """Fidelity goes down the ladder with age; critical rows stay."""
    o = load(spark, d, "orders").withColumn("age", F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")))
    step = F.when(F.col("o_orderpriority").startswith("1-") | (F.col("age") <= 90), 0).when(F.col("age") <= 180, 1).when(F.col("age") <= 360, 2).otherwise(3)
    return o.select("o_orderkey", F.element_at(F.array(*map(F.lit, LADDER)), step + 1).alias("fidelity"))


@query("l14_verify", r"SELECT page_id, regexp_extract(url, '[^/]+$', 0) AS value, contains(html, regexp_extract(url, '[^/]+$', 0)) AS verified FROM pages")
def l14(spark, d):
    """Whether the source of a fact still says its value, each row against its own source."""
    value = F.regexp_extract("url", "[^/]+$", 0)
    return load(spark, d, "pages").select("page_id", value.alias("value"), F.contains("html", value).alias("verified"))


@query("l20_fold_expand", """WITH h AS (SELECT conv_id, (turn // 64) AS b, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS h, count(*) AS n FROM conversations GROUP BY ALL)
  SELECT conv_id, sha256(string_agg(h, '' ORDER BY b)) AS digest, sum(n)::BIGINT AS n FROM h GROUP BY conv_id""")
def l20(spark, d):
    """A session's turns folded in order, lossless by digest: hashes of turns by blocks of 64, then of blocks; texts are never gathered."""
    c = load(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 64).alias("b"), "turn", F.sha2("text", 256).alias("h"))
    ordered = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), ""), 256)
    blocks = c.groupBy("conv_id", "b").agg(ordered("turn").alias("h"), F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("conv_id").agg(ordered("b").alias("digest"), F.sum("n").alias("n"))


@query("l22_rolling_digest", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000")
def l22(spark, d):
    """The newest lines that fit the budget stay."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    c = load(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used"))
    return c.where("used <= 2000").select("conv_id", "turn")


