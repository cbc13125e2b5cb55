"""Full-text index: postings stored by term, so a search reads the terms of its question and nothing else.

The index is Parquet in the shared folder, partitioned by a hash of the term and sorted by term within
files; very common terms are dealt over several files by document.  It is built once from one
tokenisation of the corpus and used again in the session until the source's files change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.mirror import work_folder

K1, B = 1.2, 0.75  # fixed values of the ranking function
WORD = r"[a-zàâäçéèêëîïôöùûüßáíóúñ]+"
BUCKETS, DEALT = 64, 4  # at most so many buckets; files of a bucket
BUCKET_ROWS = 500  # documents for each bucket, up to that
_built: dict[tuple, Index] = {}


@dataclass
class Index:
    postings: DataFrame  # term, doc, tf, dl, head (once for each document), bucket
    n: int
    mean: float
    buckets: int

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        """Index a table: one tokenisation, one shuffle with map-side combining, one by term."""
        spark = docs.sparkSession
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
        split = docs.select(F.col(doc_id).alias("doc"), words.alias("w")).select("doc", F.size("w").alias("dl"), F.posexplode_outer("w").alias("i", "term"))
        counted = split.groupBy("doc", "dl", "term").agg(F.count("term").alias("tf"), (F.min(F.coalesce("i", F.lit(0))) == 0).alias("head"))
        buckets = max(1, min(BUCKETS, docs.count() // BUCKET_ROWS))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        dealt = counted.withColumn("bucket", bucket).repartition(max(buckets, _partitions(spark) if buckets == BUCKETS else 1), "bucket", F.pmod(F.xxhash64("doc"), F.lit(DEALT)))
        folder = work_folder(spark, "terms")
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(folder)
        postings = spark.read.parquet(folder)
        s = postings.where("head").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
        return cls(postings, s.n, s.mean or 0.0, buckets)

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of a bounded list of terms: partitions by bucket, row groups by term."""
        hit = F.lit(False)
        for t in terms:  # constants, so the optimiser prunes partitions by them
            hit = hit | (F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int"))
        return self.postings.where(hit & F.col("term").isin(terms))

    def bm25(self, terms: list[str]) -> DataFrame:
        """``doc, score`` of documents that have any of the terms."""
        p = self.of(terms).select("term", "doc", "tf", "dl")
        df = F.broadcast(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # one row for each term asked for
        idf = F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.mean)))
        return p.join(df, "term").groupBy("doc").agg(F.sum(part).alias("score")).where("score > 0")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def index_of(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of a table's text column, built when it is first asked for and again when its files changed."""
    key = (*generation(spark, path), doc_id, text)
    if key not in _built:
        _built[key] = Index.build(spark.read.parquet(path), doc_id, text)
    return _built[key]


def generation(spark: SparkSession, path: str) -> tuple:
    """The session, the path and the state of its files: their number and a sum of hashes of names, times and lengths."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    return (spark.sparkContext.applicationId, path, *state)


_vectors: dict[tuple, DataFrame] = {}


def unit_vectors(spark: SparkSession, path: str, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, unit``: vectors of unit length, written once and used again until the table's files change."""
    key = (*generation(spark, path), vec_id, embedding)
    if key not in _vectors:
        folder = work_folder(spark, "vectors")
        v = F.transform(embedding, lambda x: x.cast("double"))
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        rows = spark.read.parquet(path).select(F.col(vec_id).alias("vec_id"), F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0)).alias("unit"))
        rows.write.parquet(folder)
        _vectors[key] = spark.read.parquet(folder)
    return _vectors[key]
