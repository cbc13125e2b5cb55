"""Ordered scans in which one key may hold most rows: running sums, the row before, budgets.

A window over a key is one task's work however many rows the key has.  Here rows are written once in the order
of (key, order), in *blocks* of about BLOCK rows that range partitioning cuts; a key's rows fill as many blocks
as they need.  A scan then works within (key, block), which is a bounded window, and adds what the blocks before
hand over: their sum, or their last row.  What is handed over is one row for each key and block; it is summed
over the blocks of a key by the same scheme again if a key has more than BLOCK of them.

The order must tell rows apart; rows that it doesn't tell apart come in an arbitrary order.  Null values count
as 0 in sums; a null key is a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import ORACLE, load, query
from ..sources.mirror import work_folder
from .retrieval import cosine

BLOCK = 100_000


@dataclass
class Ordered:
    """Rows in blocks: the column ``_block`` rises with the order within a key."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    most: int

    @classmethod
    def of(cls, rows: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> Ordered:
        """Write the rows in blocks; ``order`` is ascending."""
        spark = rows.sparkSession
        folder = work_folder(spark, "blocks")
        rows.write.parquet(f"{folder}/rows")  # so that the count, the cuts and the rows are of one reading
        rows = spark.read.parquet(f"{folder}/rows")
        n = max(1, -(-rows.count() // block))
        by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
        rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_block", F.spark_partition_id()).write.parquet(f"{folder}/blocks")
        return cls(spark.read.parquet(f"{folder}/blocks"), keys, order, block)

    def _within(self) -> Window:
        return Window.partitionBy(*self.keys, "_block").orderBy(*(F.col(c).asc_nulls_first() for c in self.order))

    def _sums(self, value: Column) -> DataFrame:
        """``keys, _block, _sum, _before``: each block's sum, and that of the blocks before it."""
        sums = self.rows.groupBy(*self.keys, "_block").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
        if sums.groupBy(*self.keys).count().where(F.col("count") > self.most).isEmpty():
            over = Window.partitionBy(*self.keys).orderBy("_block")
            return sums.withColumn("_before", F.sum("_sum").over(over) - F.col("_sum"))
        up = Ordered.of(sums.withColumnRenamed("_block", "_part"), self.keys, ["_part"], self.most)
        return up.running(F.col("_sum"), "_before", inclusive=False).drop("_block").withColumnRenamed("_part", "_block")

    def _joined(self, handed: DataFrame) -> DataFrame:
        h = handed
        for c in self.keys:
            h = h.withColumnRenamed(c, f"_k_{c}")
        h = h.withColumnRenamed("_block", "_k_block")
        same = self.rows["_block"] == h["_k_block"]
        for c in self.keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return self.rows.join(h, same, "left").drop("_k_block", *(f"_k_{c}" for c in self.keys))

    def running(self, value: Column, name: str, inclusive: bool = True) -> DataFrame:
        """The rows with the sum of ``value`` over the key's rows up to each (or before it) in column ``name``."""
        own = F.sum(F.coalesce(value, F.lit(0))).over(self._within())
        if not inclusive:
            own = own - F.coalesce(value, F.lit(0))
        handed = self._sums(value).select(*self.keys, "_block", F.col("_before").alias("_handed"))
        return self._joined(handed).withColumn(name, own + F.col("_handed")).drop("_handed")

    def previous(self, columns: list[str], prefix: str = "prev_") -> DataFrame:
        """The rows with ``columns`` of the key's row before each, null for the first; ``_first`` tells which that is."""
        pack = F.struct(*columns)
        last = self.rows.groupBy(*self.keys, "_block").agg(F.max_by(pack, F.struct(*self.order)).alias("_last"))
        over = Window.partitionBy(*self.keys).orderBy("_block")  # a row for each block of the key
        handed = last.withColumn("_from", F.lag("_last").over(over)).drop("_last")
        own = F.coalesce(F.lag(pack).over(self._within()), F.col("_from"))
        out = self._joined(handed).withColumn("_p", own).withColumn("_first", F.col("_p").isNull())
        return out.select("*", *(F.col("_p")[c].alias(f"{prefix}{c}") for c in columns)).drop("_p", "_from")

    def within_budget(self, cost: str, budget: int) -> DataFrame:
        """Rows that begin before ``budget`` is used up, with what each takes of it (``taken``); the last is clipped.

        Only the blocks that begin below the budget are scanned.  Costs are 0 or more.
        """
        sums = self._sums(F.col(cost)).where(F.col("_before") < budget).drop("_sum")
        inner = Ordered(self._joined(sums).where("_before IS NOT NULL"), self.keys, self.order, self.most)
        value = F.coalesce(F.col(cost), F.lit(0))
        before = F.sum(value).over(inner._within()) - value + F.col("_before")
        return inner.rows.withColumn("_at", before).where(F.col("_at") < budget).withColumn("taken", F.least(value, budget - F.col("_at"))).drop("_at", "_before")


@query("w16_budget_by_blocks", ORACLE["w16_budget_packing"])
def w16b(spark, d):
    """Units taken in order while the budget lasts, a source's units over many tasks."""
    docs = Ordered.of(load(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], 2_000)
    return docs.within_budget("n_chars", 20_000).select("source", "doc_id", "taken")


@query("w12_shift_by_blocks", ORACLE["w12_topic_shift"])
def w12b(spark, d):
    """Segments of a label, whose vectors lie over many tasks: the row before, then a running sum."""
    e = Ordered.of(load(spark, d, "embeddings").select("vec_id", "label", "embedding"), ["label"], ["vec_id"], 2_000)
    p = e.previous(["embedding"])
    cut = F.when(~F.col("_first") & (F.round(cosine(F.col("embedding"), F.col("prev_embedding")), 6) < 0.35), 1).otherwise(0)
    cuts = Ordered.of(p.select("vec_id", "label", cut.alias("cut")), ["label"], ["vec_id"], 2_000)
    return cuts.running(F.col("cut"), "segment").select("vec_id", "label", "segment")
