"""Truth maintenance over stored adjacency.

``Adjacency`` keeps the edges of a graph as a table bucketed and sorted by one end, in the shared folder.  A
walk joins its frontier with it, so a round moves the frontier and what it touches, never the edges.

``retract`` follows what rests on retracted nodes to the fixpoint.  A belief that a rule derived falls with
any of its premises; another falls when a support of it has fallen and none is left that is more than an
assumption.  Rounds count what each belief lost: a round reads the edges of the nodes that fell in the round
before, adds up losses of the beliefs at their other ends (with what these lost in earlier rounds), and writes
one part of a journal of losses.  A belief's number of real supports is kept on its edges, so no round looks
a belief up.  Beliefs that support each other stay while each has a real support that has not fallen; the
outcome does not depend on the order.  The journal and the frontiers are written, so lineage is short and a
lost executor costs a round at most.

A belief can't support itself: such edges are left out.  Edges that repeat count once, as real if one of them
is.  Retracted nodes that nothing rests on are part of the result.  Null ends are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query
from ..sources.mirror import drop_folder, swept, work_folder
from .search import generation

PLAIN_RULES = ("", "extraction", "confirmation")  # fixed values: rules of beliefs that were not derived
EVERY = 3  # hops of a walk between two written frontiers


@dataclass
class Adjacency:
    spark: SparkSession
    table: str
    key: str

    @classmethod
    def store(cls, edges: DataFrame, key: str, buckets: int | None = None) -> Adjacency:
        """Write ``edges`` bucketed by ``key``."""
        spark = edges.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"edges_{uuid.uuid4().hex}"
        edges.repartition(n, key).write.option("compression", "zstd").bucketBy(n, key).sortBy(key).option("path", work_folder(spark, "edges")).format("parquet").saveAsTable(name)
        return cls(spark, name, key)

    def edges(self) -> DataFrame:
        return self.spark.table(self.table)

    def of(self, frontier: DataFrame, node: str = "node") -> DataFrame:
        """Edges of the frontier's nodes, with the frontier's other columns."""
        return self.edges().join(frontier.withColumnRenamed(node, self.key), self.key)


def undirected(edges: DataFrame) -> Adjacency:
    """Adjacency of ``a, b`` in both directions."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return Adjacency.store(both.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "a")


def neighbours(adjacency: Adjacency, seeds: DataFrame, depth: int, most: int | None = None, readable: DataFrame | None = None) -> DataFrame:
    """``node, hops`` within ``depth`` hops of the seeds.

    ``most``: a node shows that many neighbours, by name; ``readable``: the edges ``a, b`` that may be walked.
    """
    spark = adjacency.spark
    seen = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        step = adjacency.of(frontier.select("node"))
        if readable is not None:
            step = step.join(readable.select("a", "b").distinct(), ["a", "b"], "left_semi")
        if most is not None:
            step = step.groupBy("a").agg(F.slice(F.sort_array(F.collect_set("b")), 1, most).alias("b")).select("a", F.explode("b").alias("b"))
        new = step.select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        if hop % EVERY == 0 and hop < depth:
            folder = work_folder(spark, "walk")
            seen.unionByName(new).write.parquet(folder)
            seen = spark.read.parquet(folder)
            frontier = seen.where(F.col("hops") == hop)
            if frontier.isEmpty():
                return seen
        else:
            frontier, seen = new, seen.unionByName(new)
    return seen


def justifications(rows: DataFrame) -> Adjacency:
    """Adjacency by support of ``belief, support, kind, rule``: whether the belief is derived, and its real supports.

    Rows are dealt by belief once; what a belief has in all is a window over its edges there.
    """
    spark = rows.sparkSession
    marked = rows.where("belief <> support").select(
        "belief", "support", (F.coalesce("kind", F.lit("")) != "assumption").alias("real"), (~F.coalesce("rule", F.lit("")).isin(*PLAIN_RULES)).alias("derived")
    )
    e = marked.repartition("belief").groupBy("belief", "support").agg(F.bool_or("real").alias("real"), F.bool_or("derived").alias("derived"))
    own = Window.partitionBy("belief")
    folder = work_folder(spark, "counted")  # written, so that the rows dealt by belief and by support aren't on disk at once
    with swept(spark):
        e.select("belief", "support", "real", F.count_if("real").over(own).alias("reals"), F.bool_or("derived").over(own).alias("derived")).write.option("compression", "zstd").parquet(folder)
        out = Adjacency.store(spark.read.parquet(folder), "support")
    drop_folder(spark, folder)
    return out


@dataclass
class Retraction:
    """What a retraction did: a journal of losses by round."""

    spark: SparkSession
    seeds: str
    journal: str
    rounds: int

    def fallen(self) -> DataFrame:
        """``node, round``: seeds in round 0, then what fell."""
        seeds = self.spark.read.parquet(self.seeds).withColumn("round", F.lit(0))
        if not self.rounds:
            return seeds
        return seeds.unionByName(self._losses().where("fell").select(F.col("belief").alias("node"), "round"))

    def weakened(self) -> DataFrame:
        """``belief, remaining``: beliefs that lost supports and stay, and how many real ones they have left."""
        if not self.rounds:
            return self.spark.createDataFrame([], "belief string, remaining long")
        g = self._losses().groupBy("belief").agg(F.bool_or("fell").alias("fell"), (F.max("reals") - F.sum("lost")).alias("remaining"))
        return g.where("NOT fell").select("belief", "remaining")

    def _losses(self) -> DataFrame:
        return self.spark.read.parquet(self.journal)


JOURNAL = "belief string, reals long, derived boolean, lost long, fell boolean, round int"


def retract(adjacency: Adjacency, retracted: DataFrame) -> Retraction:
    """Everything that falls with ``retracted`` (column ``node``)."""
    spark = adjacency.spark
    folder = work_folder(spark, "retraction")
    seeds, journal = f"{folder}/seeds", f"{folder}/journal"
    retracted.select("node").where("node IS NOT NULL").distinct().write.parquet(seeds)
    frontier, gone = spark.read.parquet(seeds), spark.read.parquet(seeds)
    done = 0
    while not frontier.isEmpty():
        hits = adjacency.of(frontier.select("node")).groupBy("belief").agg(F.max("reals").alias("reals"), F.bool_or("derived").alias("derived"), F.count_if("real").alias("lost"))
        hits = hits.join(gone.select(F.col("node").alias("belief")), "belief", "left_anti")  # a retracted belief doesn't fall again
        if done:
            past = spark.read.schema(JOURNAL).parquet(journal).join(hits.select("belief"), "belief", "left_semi").groupBy("belief").agg(F.sum("lost").alias("past"), F.bool_or("fell").alias("fell"))
            hits = hits.join(past, "belief", "left").where("NOT coalesce(fell, false)").drop("fell").withColumn("past", F.coalesce("past", F.lit(0)))
        else:
            hits = hits.withColumn("past", F.lit(0))
        falls = F.col("derived") | (F.col("lost") + F.col("past") >= F.col("reals"))
        part = f"{journal}/part={done + 1}"
        with swept(spark):
            hits.select("belief", "reals", "derived", "lost", falls.alias("fell"), F.lit(done + 1).alias("round")).write.option("compression", "zstd").parquet(part)
        done += 1
        frontier = spark.read.parquet(part).where("fell").select(F.col("belief").alias("node"))
    return Retraction(spark, seeds, journal, done)


J_SQL = """l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem),
  j AS (SELECT 'l' || o || '-' || n AS belief, 'p' || p AS support, 'event' AS kind, 'extraction' AS rule FROM l
    UNION ALL SELECT 'l' || o || '-' || n, 's' || s, 'event', 'extraction' FROM l
    UNION ALL SELECT 'l' || o || '-' || n, 'l' || o || '-' || (CASE WHEN n > 1 THEN n - 1 ELSE last END), 'belief', 'confirmation' FROM l WHERE n > 1 OR (o % 2 = 0 AND last > 1)
    UNION ALL SELECT 'o' || o, 'l' || o || '-' || n, 'belief', '' FROM l
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'assumption', '' FROM orders
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'belief', 'r_customer' FROM orders WHERE o_orderkey % 8 < 2),
  e AS (SELECT belief, support, bool_or(kind <> 'assumption') AS real, bool_or(rule NOT IN ('', 'extraction', 'confirmation')) AS derived FROM j WHERE belief <> support GROUP BY ALL),
  b AS (SELECT belief, count(*) FILTER (real) AS reals, bool_or(derived) AS derived FROM e GROUP BY belief),
  gone(node, round) USING KEY (node) AS (
    SELECT node, 0 FROM (SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 1)
    UNION
    SELECT h.belief, h.round FROM (SELECT e.belief, max(g.round) + 1 AS round, count(*) FILTER (e.real) AS lost FROM e JOIN recurring.gone g ON g.node = e.support GROUP BY e.belief) h
    JOIN b ON b.belief = h.belief WHERE (b.derived OR h.lost >= b.reals) AND h.belief NOT IN (SELECT node FROM recurring.gone))"""


def trade_justifications(spark: SparkSession, d: str) -> DataFrame:
    """``belief, support, kind, rule`` from the trade tables.

    A line rests on its part, its supplier and the line before it (in even orders the first on the last, so
    the lines support each other in a circle); an order on its lines, and on its customer as an assumption;
    a customer is derived from some of its orders.
    """
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    rows = rows.withColumn("last", F.max("n").over(Window.partitionBy("o")))
    o = load(spark, d, "orders")
    line = lambda n: join("l", F.col("o"), "-", n)
    own = line(F.col("n"))
    a = lambda belief, support, kind, rule: F.struct(belief.alias("belief"), support.alias("support"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"))
    edges = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("e")).where("e IS NOT NULL").select("e.*")
    before = line(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.col("last")))
    customer, order = join("c", F.col("o_custkey")), join("o", F.col("o_orderkey"))
    parts = [
        edges(
            rows, a(own, join("p", F.col("p")), "event", "extraction"), a(own, join("s", F.col("s")), "event", "extraction"),
            F.when(F.expr("n > 1 OR (o % 2 = 0 AND last > 1)"), a(own, before, "belief", "confirmation")), a(join("o", F.col("o")), own, "belief", ""),
        ),
        edges(o, a(order, customer, "assumption", ""), F.when(F.expr("o_orderkey % 8 < 2"), a(customer, order, "belief", "r_customer"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_stored: dict[tuple, Adjacency] = {}


def stored(spark: SparkSession, d: str) -> Adjacency:
    """The adjacency of the trade tables' justifications, stored once until the lines change."""
    key = generation(spark, f"{d}/lineitem.parquet")
    if key not in _stored:
        _stored[key] = justifications(trade_justifications(spark, d))
    return _stored[key]


def trade_retraction(spark: SparkSession, d: str) -> Retraction:
    node = lambda t, k, letter, where: load(spark, d, t).where(where).select(F.concat(F.lit(letter), F.col(k).cast("string")).alias("node"))
    return retract(stored(spark, d), node("part", "p_partkey", "p", "p_partkey % 2 = 0").union(node("supplier", "s_suppkey", "s", "s_suppkey % 3 <> 1")))


@query("r11_support_counts", f"WITH RECURSIVE {J_SQL} SELECT node, round FROM gone")
def r11s(spark, d):
    """What falls with parts and suppliers, and in which round, where beliefs have several supports and circles."""
    return trade_retraction(spark, d).fallen()


@query("r20_remaining_supports", f"WITH RECURSIVE {J_SQL} SELECT e.belief, count(*) FILTER (e.real AND g.node IS NULL) AS remaining FROM e LEFT JOIN gone g ON g.node = e.support WHERE e.belief NOT IN (SELECT node FROM gone) GROUP BY e.belief HAVING count(g.node) > 0")
def r20s(spark, d):
    """Beliefs that lost supports and stay, with the real supports they have left."""
    return trade_retraction(spark, d).weakened()


@query("j17_readable_hops", """WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem WHERE l_returnflag <> 'R')),
  t AS (SELECT a, b FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 50),
  w AS (SELECT 'p1' AS node, 0 AS hops UNION SELECT t.b, w.hops + 1 FROM w JOIN t ON t.a = w.node WHERE w.hops < 4) SELECT node, min(hops) AS hops FROM w GROUP BY node""")
def j17r(spark, d):
    """Four hops over edges that may be read, fifty neighbours a node."""
    rows = load(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"), "l_returnflag")
    key = (*generation(spark, f"{d}/lineitem.parquet"), "orders and parts")
    if key not in _stored:
        _stored[key] = undirected(rows)
    ok = rows.where("l_returnflag <> 'R'")
    both = ok.select("a", "b").unionByName(ok.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return neighbours(_stored[key], spark.createDataFrame([("p1",)], "node string"), 4, 50, both)
