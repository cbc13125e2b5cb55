"""Jobs claimed by many workers that share nothing but a folder: leases with fencing tokens.

A job's n-th claim is a file ``tokens/<job>/<n>`` that is put only if it is absent, so of two workers that want the
same claim one wins.  The number n is the fencing token: it rises with every claim, and only the holder of the
highest one may finish the job.  A lease runs out ``lease_seconds`` after it was put or last renewed (a renewal is
a file of its own); then anybody may claim the next number, and after ``most_attempts`` claims the job has failed.

Finishing is one put-if-absent of ``done/<job>``, which names the token and the result.  Before it the worker puts
the token that would follow its own: once that is taken, no one can claim over it, and if someone has, the commit
is refused, as it is once the lease ran out.  So two workers never hold one job, and one that slept through its
lease can't publish.  A worker that dies between the two files leaves a token without a lease; it is given one when
another worker sees it, and the job is claimed again after that.

``ready`` and ``states`` are DataFrames: the queue is filtered and joined by Spark, whatever its length, and what a
worker collects is the head of its own share.  ``claim`` orders by job and takes the lowest that it wins.

Times are the callers' seconds (``now``); clocks that differ by less than the lease's slack do no harm, because
claims are settled by files and not by times.  Jobs are integers; null ones are never ready.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import load, query
from .mirror import work_folder


class Files:
    """Small files in a shared folder; ``put`` is atomic: true for one caller only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.local = spark, "://" not in folder
        self.root = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder.rstrip("/")
        if folder.startswith("file:"):
            self.local = True

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def put(self, name: str, text: str) -> bool:
        if self.local:
            full = f"{self.root}/{name}"
            os.makedirs(os.path.dirname(full), exist_ok=True)
            part = f"{full}.{uuid.uuid4().hex}.part"
            with open(part, "w") as f:
                f.write(text)
            try:
                os.link(part, full)  # fails if the name is there
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(part)
        fs, path = self._hadoop(name)
        try:
            out = fs.create(path, False)  # not over another's
        except Exception as e:
            if fs.exists(path):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def names(self, name: str) -> list[str]:
        if self.local:
            full = f"{self.root}/{name}"
            return [f for f in os.listdir(full) if not f.endswith(".part")] if os.path.isdir(full) else []
        fs, path = self._hadoop(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def has(self, name: str) -> bool:
        if self.local:
            return os.path.exists(f"{self.root}/{name}")
        fs, path = self._hadoop(name)
        return fs.exists(path)


@dataclass(frozen=True)
class Lease:
    job: int
    token: int
    until: float


class Queue:
    """Claims over ``jobs(job, task, run_after, depends_on)``; ``run_after`` in seconds."""

    def __init__(self, jobs: DataFrame, folder: str, lease_seconds: float = 900, most_attempts: int = 20, clock: Callable[[], float] = time.time):
        self.jobs, self.folder, self.files = jobs, folder, Files(jobs.sparkSession, folder)
        self.seconds, self.most, self.clock = lease_seconds, most_attempts, clock

    def _last(self, job: int) -> tuple[int, float]:
        """The highest token of a job and when its lease runs out."""
        tokens: dict[int, float] = {}
        for name in self.files.names(f"leases/{job:020d}"):
            n, _, at = name.split("-")
            tokens[int(n)] = max(tokens.get(int(n), 0.0), float(at))
        last = max(tokens, default=0)
        return last, tokens.get(last, 0.0)

    def _put(self, job: int, token: int, until: float, worker: str) -> bool:
        """The file whose name is the token alone settles who holds it; a second one tells until when."""
        if not self.files.put(f"tokens/{job:020d}/{token:06d}", worker):
            return False
        self.files.put(f"leases/{job:020d}/{token:06d}-lease-{until!r}", worker)
        return True

    def take(self, job: int, worker: str) -> Lease | None:
        """The job's next lease, unless it is done, held, has failed, or another worker wins it."""
        if self.files.has(f"done/{job:020d}"):
            return None
        now = self.clock()
        taken = max((int(n) for n in self.files.names(f"tokens/{job:020d}")), default=0)
        last, until = self._last(job)
        if last == taken and until > now or taken >= self.most:
            return None
        if last < taken and not self._forsaken(job, taken, now):
            return None
        if not self._put(job, taken + 1, now + self.seconds, worker):
            return None
        return Lease(job, taken + 1, now + self.seconds)

    def _forsaken(self, job: int, token: int, now: float) -> bool:
        """A token whose holder died before it said until when is given a lease from when it is first seen."""
        self.files.put(f"leases/{job:020d}/{token:06d}-seen-{now + self.seconds!r}", "")
        return False

    def renew(self, lease: Lease, worker: str) -> Lease | None:
        """A longer lease, unless it ran out or was claimed by another."""
        now = self.clock()
        if now >= lease.until or max(int(n) for n in self.files.names(f"tokens/{lease.job:020d}")) != lease.token:
            return None
        self.files.put(f"leases/{lease.job:020d}/{lease.token:06d}-renewed-{now + self.seconds!r}", worker)
        return Lease(lease.job, lease.token, now + self.seconds)

    def finish(self, lease: Lease, worker: str, result: str = "") -> bool:
        """Publish the result; false if the lease ran out, another claimed the job since, or it is done."""
        if self.clock() >= lease.until or not self.files.put(f"tokens/{lease.job:020d}/{lease.token + 1:06d}", f"finished by {worker}"):
            return False
        return self.files.put(f"done/{lease.job:020d}", json.dumps({"job": lease.job, "token": lease.token, "worker": worker, "result": result}))

    def states(self) -> DataFrame:
        """``job, tokens, until, done`` of every job that was ever claimed, read from the names of files."""
        spark = self.jobs.sparkSession
        read = lambda part: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.folder}/{part}").select("path")
        empty = spark.createDataFrame([], "path string")
        have = lambda part: read(part) if self.files.has(part) else empty
        number = lambda pattern, kind: F.regexp_extract("path", pattern, 1).cast(kind)
        rows = have("tokens").select(number(r"/(\d+)/\d+$", "long").alias("job"), number(r"/(\d+)$", "int").alias("token"), F.lit(None).cast("double").alias("until"), F.lit(False).alias("done"))
        rows = rows.union(have("leases").select(number(r"/(\d+)/[^/]*$", "long"), number(r"/(\d+)-[a-z]+-[^/]*$", "int"), number(r"-([0-9.]+)$", "double"), F.lit(False)))
        rows = rows.union(have("done").select(number(r"/(\d+)$", "long"), F.lit(0), F.lit(None).cast("double"), F.lit(True)))
        best = F.max(F.struct("token", "until"))
        return rows.groupBy("job").agg(F.max("token").alias("tokens"), best["until"].alias("until"), F.max("done").alias("done"))

    def ready(self, tasks: list[str] | None = None) -> DataFrame:
        """Jobs that are due, whose dependency is done, and that nobody holds, has done or used up."""
        now, s = self.clock(), self.states()
        due = self.jobs.where("job IS NOT NULL").where(F.col("run_after").isNull() | (F.col("run_after") <= now))
        if tasks is not None:
            due = due.where(F.col("task").isin(tasks))
        gone = s.where(F.col("done") | (F.coalesce("until", F.lit(0.0)) > now) | (F.col("tokens") >= self.most)).select("job")
        met = s.where("done").select(F.col("job").alias("depends_on"), F.lit(True).alias("_met"))
        out = due.join(gone, "job", "left_anti").join(met, "depends_on", "left").where("depends_on IS NULL OR _met")
        return out.select(self.jobs.columns)

    def claim(self, worker: str, n: int = 1, tasks: list[str] | None = None) -> list[Lease]:
        """Leases on the lowest ready jobs that this worker wins, up to ``n``; jobs that others win are passed over."""
        out: list[Lease] = []
        rows = self.ready(tasks)
        after = None
        while len(out) < n:
            page = rows if after is None else rows.where(F.col("job") > after)
            ids = [r.job for r in page.select("job").distinct().orderBy("job").limit(max(16, 2 * n)).collect()]  # a page of ids
            if not ids:
                break
            for job in ids:
                after = job
                lease = self.take(job, worker) if len(out) < n else None
                if lease:
                    out.append(lease)
        return out


@query("l4_leases", """WITH j AS (SELECT event_id AS job, (json_extract_string(props, '$.k'))::BIGINT AS k, event_type AS task FROM events),
  r AS (SELECT job, row_number() OVER (ORDER BY job) AS n FROM j WHERE k % 2 = 0)
  SELECT task, count(*) AS jobs, count(*) FILTER (WHERE r.n <= 40) AS done, count(*) FILTER (WHERE r.n > 40 AND r.n <= 60) AS held FROM j LEFT JOIN r USING (job) GROUP BY task""")
def l4l(spark, d):
    """Two workers claim 40 and 20 of the jobs that are due; one finishes its own, and all jobs are counted by state."""
    k = F.get_json_object("props", "$.k").cast("long")
    jobs = load(spark, d, "events").select(F.col("event_id").alias("job"), F.col("event_type").alias("task"), F.when(k % 2 == 0, 0.0).otherwise(1e12).alias("run_after"), F.lit(None).cast("long").alias("depends_on"))
    queue = Queue(jobs, work_folder(spark, "leases"))
    for lease in queue.claim("first", 40):
        queue.finish(lease, "first")
    queue.claim("second", 20)
    s, now = queue.states(), queue.clock()
    held = ~F.col("done") & (F.col("until") > now)
    return jobs.join(s, "job", "left").groupBy("task").agg(F.count(F.lit(1)).alias("jobs"), F.count_if("done").alias("done"), F.count_if(held).alias("held"))
