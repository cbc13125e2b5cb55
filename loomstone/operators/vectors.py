"""A vector index: stored lists of quantised vectors, searched exactly.

Vectors of unit length are dealt to the lists of their nearest centroids (fitted to a sample of SAMPLE
vectors; the centroids decide what is read, not what is found).  A list's rows hold the angle to the
centroid, the vector as 8-bit codes with its step, and the length of what the codes leave out; the vectors
themselves are columns and files of their own, read for a shortlist only.

Two facts make a search exact.  Angles are a metric, so a vector's angle to the query is at least the
difference of their angles to a centroid: lists, and stretches of lists, whose bound is below the k-th best
are not read or not scored.  And a product with the codes is off by at most what they leave out (Cauchy and
Schwarz, the query has unit length), so each scored vector has a lower and an upper bound; the k-th greatest
lower bound is a threshold, and exact products are computed for what may reach it.

A query meets the list of its nearest centroid first, which gives the threshold, and then the lists that can
beat it.  Lists are split into parts of at most PART vectors, and queries of one list into chunks of at most
CHUNK, so neither a popular centroid nor a popular query direction makes a large task.  A vector is sent once
for each chunk of queries that may need its list.

Appending adds files and touches none.  Vectors of another width than the index's are left out, as are null
ids; a vector of zeros has a similarity of 0 with everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import ORACLE, load, query
from ..sources.mirror import work_folder
from .retrieval import dot
from .search import generation

SAMPLE, LISTS = 8192, 256
PART, CHUNK = 16384, 2048
ANGLE = 1e-6  # what rounding can add to an angle between doubles
CLOSE = 2e-6  # similarities are compared to six places
CODES = "vec_id long, list int, part int, theta double, step double, err double, code binary, unit array<double>"
BOUNDS = "query long, vec_id long, low double, high double, scored long"


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; the sample's rows are in a fixed order, so it gives the same again."""
    x = np.unique(unit(sample), axis=0)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.eye(1, sample.shape[1])
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit(sums), c)
    return c


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("f8")


def scan(theta_q: np.ndarray, q: np.ndarray, qid: np.ndarray, floor: np.ndarray, rows: pd.DataFrame, k: int, own: bool) -> Iterator[pd.DataFrame]:
    """Bounds (see BOUNDS) of the rows of one list that may be among each query's ``k`` best and reach its ``floor``.

    ``own``: a query doesn't find the vector of its own id.
    """
    rows = rows.sort_values(["theta", "vec_id"], ignore_index=True)
    theta, ids = rows["theta"].to_numpy(), rows["vec_id"].to_numpy()
    step, err = rows["step"].to_numpy(), rows["err"].to_numpy()
    codes = np.frombuffer(b"".join(rows["code"]), "i1").reshape(len(rows), -1)
    reach = np.arccos(np.clip(floor, -1.0, 1.0)) + ANGLE  # a vector that is further off in angle is below the floor
    begin = np.searchsorted(theta, theta_q - reach, "left")
    end = np.searchsorted(theta, theta_q + reach, "right")
    begin, end = np.where(floor > 1 + CLOSE, end, begin), end
    for at in range(0, len(q), 64):
        strip = np.arange(at, min(at + 64, len(q)))
        left, right = begin[strip].min(), end[strip].max()
        if left >= right:
            continue
        s = (q[strip] @ codes[left:right].T.astype("f8")) * step[left:right]
        low, high = s - err[left:right], s + err[left:right]
        for i, lo, hi in zip(strip, low, high):
            b, e = begin[i] - left, end[i] - left
            lo, hi, own_ids = lo[b:e], hi[b:e], ids[begin[i] : end[i]]
            fit = own_ids != qid[i] if own else np.ones(len(lo), bool)
            least = floor[i]
            if fit.sum() > k:
                least = max(least, np.partition(lo[fit], fit.sum() - k)[fit.sum() - k])
            fit &= hi >= least - CLOSE
            yield pd.DataFrame({"query": qid[i], "vec_id": own_ids[fit], "low": lo[fit], "high": hi[fit], "scored": np.where(np.arange(fit.sum()) == 0, e - b, 0)})


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    centroids: np.ndarray  # LISTS of them at most
    counted: tuple | None = None  # sizes and ranges of the lists, until the next append

    @classmethod
    def build(cls, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", lists: int = LISTS, least: int = 512, folder: str | None = None) -> VectorIndex:
        """Fit centroids to a sample of the most common width, and store the vectors.  ``lists`` is cut to one for each ``least`` vectors."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(embedding).cast("array<double>").alias("e")).where(F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x)))
        width = rows.groupBy(F.size("e").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
        if width is None:
            index = cls(spark, folder or work_folder(spark, "lists"), np.eye(1, 1))
        else:
            sample = rows.where(F.size("e") == width.w).orderBy(F.xxhash64("e")).limit(SAMPLE).collect()
            index = cls(spark, folder or work_folder(spark, "lists"), fit_centroids(np.array([r.e for r in sample], "f8"), max(1, min(lists, width.n // least))))
        index.append(vectors, vec_id, embedding)
        return index

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def _units(self, vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
        e = F.col(embedding).cast("array<double>")
        ok = F.col(vec_id).isNotNull() & e.isNotNull() & (F.size(e) == self.width) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x))
        rows = vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e"))
        length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
        return rows.select("vec_id", F.transform("e", lambda x: F.when(length > 0, x / length).otherwise(0.0)).alias("unit"))

    def append(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> None:
        """Store more vectors; ids must be new."""
        self.counted = None
        self._units(vectors, vec_id, embedding).write.mode("append").parquet(f"{self.folder}/units")
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.array(batch.column("unit").to_pylist(), "f8")
                a = angles(x, centroids)
                near = a.argmin(1)
                step = np.abs(x).max(1) / 127
                codes = np.rint(np.divide(x, step[:, None], out=np.zeros_like(x), where=step[:, None] > 0)).astype("i1")
                err = np.linalg.norm(x - codes * step[:, None], axis=1) + 1e-9
                ids = batch.column("vec_id")
                part = (pd.util.hash_array(ids.to_numpy()) % 1024).astype("i4")
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (near.astype("i4"), part, a[np.arange(len(x)), near], step, err)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("unit")], names=[c.split()[0] for c in CODES.split(", ")])

        new = self._units(vectors, vec_id, embedding).mapInArrow(run, CODES)
        files = max(1, min(16, vectors.count() // (len(centroids) * PART)))  # of a list
        new.repartition(min(len(centroids) * files, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "list", F.col("part") % files).sortWithinPartitions("list", "theta").write.mode("append").partitionBy("list").parquet(f"{self.folder}/lists")

    def lists(self) -> DataFrame:
        return self.spark.read.schema(CODES).parquet(f"{self.folder}/lists")

    def units(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, unit array<double>").parquet(f"{self.folder}/units")

    def ranges(self) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        """Sizes of the lists that have vectors, and of each list the least and greatest angle to its centroid."""
        if self.counted is None:
            rows = self.lists().groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("theta").alias("near"), F.max("theta").alias("far")).collect()  # LISTS rows at most
            near = np.full(len(self.centroids), math.inf)
            far = near.copy()
            for r in rows:
                near[r.list], far[r.list] = r.near, r.far
            self.counted = ({r.list: r.n for r in rows}, near, far)
        return self.counted

    def nearest_of(self, vector: list[float], k: int, above: float = -1.0) -> DataFrame:
        """``vec_id, sim`` of the ``k`` nearest of one vector: two scans, of its own list and of stretches of others.

        The second reads partitions and row groups of the lists and angles that can reach what the first found.
        """
        q = unit(np.array(vector, "f8"))
        sizes, near, far = self.ranges()
        none = self.spark.createDataFrame([], "vec_id long, sim double")
        if not sizes or len(q) != self.width:
            return none
        a = angles(q[None], self.centroids)[0]
        home = min(sizes, key=lambda l: (a[l], l))

        def bounds(floor: float, exact: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    codes = np.frombuffer(b"".join(b.column("code").to_pylist()), "i1").reshape(b.num_rows, -1)
                    s, err = (codes.astype("f8") @ q) * b.column("step").to_numpy(), b.column("err").to_numpy()
                    low = s - err
                    least = max(floor, np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -2.0)
                    fit = np.flatnonzero(s + err >= least - CLOSE)
                    value = np.array([np.dot(x, q) for x in b.column("unit").take(pa.array(fit)).to_pylist()], "f8") if exact else low[fit]
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(fit)), pa.array(value)], names=["vec_id", "sim"])

            return run

        columns = ["vec_id", "step", "err", "code"]
        first = self.lists().where(F.col("list") == home).select(*columns).mapInArrow(bounds(float(above), False), "vec_id long, sim double")
        kth = first.orderBy(F.desc("sim")).limit(k).agg(F.min("sim").alias("s"), F.count(F.lit(1)).alias("n")).first()
        floor = max(float(above), kth.s if kth.n == k else -1.0)
        reach = math.acos(max(-1.0, min(1.0, floor))) + ANGLE
        some = [l for l in sizes if math.cos(min(math.pi, max(0.0, a[l] - far[l], near[l] - a[l]) - ANGLE)) >= floor - CLOSE]
        hit = F.lit(False)
        for l in some:  # constants, so partitions and row groups are pruned by them
            hit = hit | ((F.col("list") == l) & F.col("theta").between(float(a[l] - reach - CLOSE), float(a[l] + reach + CLOSE)))
        found = self.lists().where(hit).select(*columns, "unit").mapInArrow(bounds(floor, True), "vec_id long, sim double")
        sim = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "sim")), 6)
        return found.select("vec_id", sim.alias("sim")).where(F.col("sim") > F.lit(float(above))).orderBy(F.desc("sim"), "vec_id").limit(k)

    def nearest(self, queries: DataFrame, k: int, query_id: str = "vec_id", embedding: str = "embedding", own: bool = False, above: float = -1.0) -> DataFrame:
        """``query, vec_id, sim, rank``: each query's ``k`` nearest of similarity over ``above``, by six places, ties by id."""
        return self.nearest_with_report(queries, k, query_id, embedding, own, above)[0]

    def nearest_with_report(self, queries: DataFrame, k: int, query_id: str = "vec_id", embedding: str = "embedding", own: bool = False, above: float = -1.0) -> tuple[DataFrame, DataFrame]:
        """The same, and ``query, scored, shortlist``: how many vectors of each query were scored by codes and how many exactly."""
        centroids, spark = self.centroids, self.spark
        sizes, near, far = self.ranges()
        parts = {l: max(1, -(-n // PART)) for l, n in sizes.items()}
        stored = np.isfinite(near)
        asked = self._units(queries, query_id, embedding).withColumnRenamed("vec_id", "query")
        folder = work_folder(spark, "asked")
        empty = spark.createDataFrame([], "query long, vec_id long, sim double, rank int")
        if not sizes:
            return empty, spark.createDataFrame([], "query long, scored long, shortlist long")

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    a = angles(np.array(b.column("unit").to_pylist(), "f8"), centroids)
                    own_list = np.where(stored, a, 9.0).argmin(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own_list.astype("i4")), pa.array(a[np.arange(len(a)), own_list])], names=["query", "unit", "list", "theta_q"])

        asked.mapInArrow(home, "query long, unit array<double>, list int, theta_q double").write.parquet(f"{folder}/home")
        asked = spark.read.parquet(f"{folder}/home")
        first = self._scan(asked.withColumn("floor", F.lit(float(above))), parts, k, own)
        first.write.parquet(f"{folder}/first")
        first = spark.read.parquet(f"{folder}/first")
        order = Window.partitionBy("query").orderBy(F.desc("low"), "vec_id")
        kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", F.col("low").alias("kth"))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query and list that may hold something that reaches the query's floor."""
            for b in batches:
                if not b.num_rows:
                    continue
                x, floor = np.array(b.column("unit").to_pylist(), "f8"), b.column("floor").to_numpy()
                a = angles(x, centroids)
                gap = np.maximum(0.0, np.maximum(a - far, near - a) - ANGLE)
                hit = stored & (np.cos(np.minimum(gap, math.pi)) >= floor[:, None] - CLOSE)
                hit[np.arange(len(x)), b.column("list").to_numpy()] = False
                i, l = np.nonzero(hit)
                for at in range(0, len(i), 4096):
                    j, m = i[at : at + 4096], l[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(j)), b.column("unit").take(pa.array(j)), pa.array(m.astype("i4")), pa.array(a[j, m]), pa.array(floor[j])], names=["query", "unit", "list", "theta_q", "floor"])

        floors = asked.join(kth, "query", "left").select("query", "unit", "list", F.greatest(F.coalesce("kth", F.lit(-1.0)), F.lit(float(above))).alias("floor"))
        rest = self._scan(floors.mapInArrow(others, "query long, unit array<double>, list int, theta_q double, floor double"), parts, k, own)
        rest.write.parquet(f"{folder}/rest")
        both = first.unionByName(spark.read.parquet(f"{folder}/rest"))
        least = F.col("kth") - CLOSE
        kth = both.where("vec_id IS NOT NULL").withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", F.col("low").alias("kth"))
        short = both.where("vec_id IS NOT NULL").join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("high") >= least)).select("query", "vec_id")
        exact = short.join(self.units().withColumnRenamed("unit", "u"), "vec_id").join(asked.select("query", "unit"), "query")
        sims = exact.select("query", "vec_id", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("u"), F.col("unit")))), 6).alias("sim")).where(F.col("sim") > F.lit(above))
        ranked = sims.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id"))).where(F.col("rank") <= k)
        counts = short.groupBy("query").agg(F.count(F.lit(1)).alias("shortlist"))
        return ranked, both.groupBy("query").agg(F.sum("scored").alias("scored")).join(counts, "query", "left")

    def _scan(self, asked: DataFrame, parts: dict[int, int], k: int, own: bool) -> DataFrame:
        """BOUNDS of ``query, unit, list, theta_q, floor`` against the lists they name."""
        counted = {r.list: r.n for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # LISTS rows at most
        if not counted:
            return self.spark.createDataFrame([], BOUNDS)
        of = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))[F.col("list")]
        chunks = {l: max(1, -(-n // CHUNK)) for l, n in counted.items()}
        every = lambda d: F.explode(F.sequence(F.lit(0), of(d) - 1))
        rows = self.lists().drop("unit").where(F.col("list").isin(list(counted))).withColumn("p", F.col("part") % of(parts)).withColumn("c", every(chunks))
        few = asked.withColumn("c", F.pmod(F.xxhash64("query"), of(chunks)).cast("int")).withColumn("p", every({l: parts.get(l, 1) for l in counted}))

        def run(rows: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(few):
                return pd.DataFrame({"query": [], "vec_id": [], "low": [], "high": [], "scored": []})
            found = list(scan(few["theta_q"].to_numpy(), matrix(few["unit"]), few["query"].to_numpy(), few["floor"].to_numpy(), rows, k, own))
            return pd.concat(found) if found else pd.DataFrame({"query": [], "vec_id": [], "low": [], "high": [], "scored": []})

        return rows.groupBy("list", "p", "c").cogroup(few.groupBy("list", "p", "c")).applyInPandas(run, BOUNDS)


_built: dict[tuple, VectorIndex] = {}


def index_of_vectors(spark: SparkSession, d: str) -> VectorIndex:
    """The index of ``embeddings``, stored in two appends and used again until the table's files change."""
    key = generation(spark, f"{d}/embeddings.parquet")
    if key not in _built:
        e = load(spark, d, "embeddings")
        index = VectorIndex.build(e.where("vec_id % 3 > 0"))
        index.append(e.where("vec_id % 3 = 0"))
        _built[key] = index
    return _built[key]


@query("v9_lists_of_queries", ORACLE["v9_knn_of_queries"])
def v9l(spark, d):
    """V9: the ten nearest of every hundredth vector, from stored lists."""
    found = index_of_vectors(spark, d).nearest(load(spark, d, "embeddings").where("vec_id % 100 = 0"), 10, own=True)
    return found.select("query", "vec_id", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


_SIM = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[])/sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))/sqrt(list_dot_product(q.embedding::DOUBLE[],q.embedding::DOUBLE[]))"


@query("w2_lists_topk", f"SELECT vec_id, sim FROM (SELECT a.vec_id, round({_SIM}, 6) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=3) q) WHERE sim > 0.1 ORDER BY sim DESC, vec_id LIMIT 25")
def w2l(spark, d):
    """The 25 nearest above 0.1 of one vector, from stored lists."""
    q = load(spark, d, "embeddings").where("vec_id = 3").select("embedding").first()
    return index_of_vectors(spark, d).nearest_of(q.embedding, 25, above=0.1)
