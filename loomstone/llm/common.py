"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


RUN = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only where that is unset, as in
    tests on one machine, a new temporary folder is made and set for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder; what reads it later reads only the columns it needs."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


HEAVY, COPIES = 1000, 64


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``rows.join(side, keys, how)`` where some keys hold a large share of ``rows``.

    ``heavy`` has those keys: not more than HEAVY, each with over 1 / HEAVY of the rows.  Their rows are
    dealt into COPIES parts by the hash of the whole row (so a task that runs again deals alike), and
    ``side`` repeats its rows of these keys for each part.
    """
    flag, salt = (f"{x}-{uuid.uuid4().hex}" for x in ("heavy", "salt"))
    flags = F.broadcast(heavy.select(*keys).withColumn(flag, F.lit(True)))
    part = F.when(F.col(flag), F.pmod(F.xxhash64(*rows.columns), F.lit(COPIES))).otherwise(F.lit(0))
    parts = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(flags, keys, "left").withColumn(salt, part.cast("int")).drop(flag)
    right = side.join(flags, keys, "left").withColumn(salt, F.explode(parts)).drop(flag)
    return left.join(right, [*keys, salt], how).drop(salt)


def heavy_keys(counted: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Keys of ``counted`` (one row each) with over 1 / HEAVY of ``total`` rows; at most HEAVY of them."""
    return counted.where(F.col(size) > max(1, total / HEAVY)).select(*keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<s, e, m>>`` of the leftmost non-overlapping matches of a Java pattern.

    ``s`` and ``e`` count code points, ``e`` is exclusive, ``m`` is the matched text.  The gaps
    between matches come from ``split`` with the same pattern, so both see the same matches; the
    split runs only for texts that have a match.  Null or unmatched texts give an empty array.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        found,
        F.split(text, pattern, -1),
        lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")),
    )
    kind = "array<struct<s:int,e:int,m:string>>"

    def one(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        new = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).cast(kind)
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"))

    def run(acc, part):  # arrays grow by copying, so they grow to RUN entries only
        zero = F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out"))
        done = F.aggregate(part, zero, one)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    def located(p):
        parts = F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(RUN)), lambda c: F.slice(p, c + 1, RUN))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(parts, zero, run, lambda a: a["out"]))

    # transform over one element names the pieces, so the patterns run once
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.get(F.transform(F.array(pieces), located), F.lit(0))).otherwise(F.array().cast(kind))


def span_text(items: Column) -> Column:
    """``kind:start:end`` of each item, comma-joined, in the order given."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
