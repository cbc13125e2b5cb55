"""Sources and sinks: the JSON mirror of the log, directory ingest, schema discovery, guarded SQL."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import load, query

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and Spark is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a work folder wherever Spark's file systems reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_mirror(events: DataFrame, folder: str) -> None:
    """Events as JSON lines, one directory for each day."""
    events.withColumn("day", F.to_date("ts")).repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(8))).write.partitionBy("day").json(folder)


def read_mirror(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """The mirror's events; lines that don't parse have a null id and are left out."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder).drop("day").where("event_id IS NOT NULL")


READS = frozenset(  # plan nodes of the parser that only read (fixed values)
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Distinct Join Union Intersect Except SubqueryAlias UnresolvedRelation "
    "LocalRelation UnresolvedInlineTable UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedWith With OneRowRelation Window Offset LateralJoin CTERelationRef UnresolvedOrderBy".split()
)
REFUSED = frozenset("reflect java_method try_reflect input_file_name assert_true raise_error".split())  # functions that reach beyond the rows


def read_only_sql(spark: SparkSession, sql: str, limit: int = 50, tables: frozenset[str] | None = None) -> DataFrame:
    """A single SELECT against the session's tables (or those listed), at most ``limit`` rows.

    The classes of the parsed plan decide, not its text: every node must be of READS, relations must be
    plain names (a file path has two parts), and functions that reach beyond the rows are refused.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)

    def each(sequence):
        return [sequence.apply(i) for i in range(sequence.size())]

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind not in READS:
            raise ValueError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            names = each(node.multipartIdentifier())
            if len(names) > 1 or (tables is not None and names[0] not in tables):
                raise ValueError(f"no such table: {'.'.join(names)}")
        for e in each(node.expressions()):
            inspect(e)
        if kind == "UnresolvedWith":
            for c in each(node.cteRelations()):
                walk(c._2())
        for child in each(node.children()):
            walk(child)

    def inspect(e):
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and not REFUSED.isdisjoint(x.lower() for x in each(e.nameParts())):
            raise ValueError("this function is not allowed")
        if kind in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
            walk(e.plan())
        for child in each(e.children()):
            inspect(child)

    walk(plan)
    return spark.sql(sql).limit(limit)


def manifest(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """Table, column and type of every column."""
    return [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]


@query("s23_json_mirror", "SELECT event_id, user_id, event_type, round(value,4) AS value FROM events")
def s23(spark, d):
    """The log written as daily JSON lines and replayed."""
    folder = work_folder(spark, "mirror")
    write_mirror(load(spark, d, "events"), folder)
    return read_mirror(spark, folder).dropDuplicates(["event_id"]).select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


@query("s18_guarded_sql", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type LIMIT 50")
def s18(spark, d):
    """User SQL, queries only."""
    load(spark, d, "events").createOrReplaceTempView("_events_ro")
    return read_only_sql(spark, "SELECT event_type, count(*) AS n FROM _events_ro GROUP BY event_type ORDER BY event_type")


@query("s25_directory_ingest", "SELECT sha256(text) AS h, min(doc_id) AS first_id, substr(min_by(text, doc_id),1,4000) AS excerpt FROM documents GROUP BY 1")
def s25(spark, d):
    """Each record once by the hash of its whole text, with an excerpt."""
    docs = load(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", F.substring("text", 1, 4000).alias("excerpt"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.first("excerpt").alias("excerpt"))


@query("s14_manifest_counts", "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def s14(spark, d):
    """Row counts of foreign tables (read from file footers)."""
    parts = [load(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t in ("orders", "lineitem", "customer")]
    return parts[0].union(parts[1]).union(parts[2])
