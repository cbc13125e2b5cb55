"""A foreign table as a stream with two stored cursors, and a sink that publishes each batch once.

The source ``foreign_rows`` reads a Parquet table that others write to, through ``pyarrow.dataset`` in the tasks.
Its offset is ``mark`` (rows with a greater key are new) and ``lap, cursor`` (how far the rows up to the mark have
been read again, which is how changed rows are noticed).  A batch takes about ``budget`` rows: new ones first, then
older ones with what is left.  A batch is all rows between two offsets, so a repeated batch has the same keys, and
rows with equal keys stay together even if that passes the budget.

Spark's checkpoint decides what has been read.  A reader that starts isn't told the checkpoint's offset, so each
planned batch also stores its end in the folder ``state``, from where the next reader goes on; ranges are always
taken from the offsets that Spark gives, so a stale store delays rows but never skips them.  With ``availableNow``
a run is one batch: one bounded sweep, or the repeated batch after a crash.

The sink ``foreign_batches`` writes a file for each task and then one manifest for the batch, named by ``writer``
and the batch's number.  A batch that is repeated after a crash finds its manifest and removes its own files;
``published`` reads the files of manifests only, so what a dead task left is never seen.

Keys are integers; rows with a null key can't be placed by a cursor and are never read.  An empty table gives no
rows.  A column named ``_kind`` in the table is refused.  Paths are local or what ``pyarrow.fs`` opens; all must be
shared by driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..plans.registry import query
from .mirror import work_folder

FIRST = -(1 << 63)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def put(path: str, text: str) -> None:
    """Write a small file whole: under another name first, then moved."""
    fs, p = file_system(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    part = f"{p}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(text.encode())
    fs.move(part, p)


def get(path: str) -> str | None:
    fs, p = file_system(path)
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(p) as f:
        return f.read().decode()


def rows_of(path: str) -> pads.Dataset:
    fs, p = file_system(path)
    return pads.dataset(p, filesystem=fs, format="parquet")


@dataclass
class Stretch(InputPartition):
    """Keys above ``low`` up to ``high``."""

    low: int
    high: int
    kind: str

    def __init__(self, low: int, high: int, kind: str):
        super().__init__((low, high, kind))
        self.low, self.high, self.kind = low, high, kind


def between(key: str, low: int, high: int | None) -> pads.Expression:
    out = pads.field(key) > low
    return out if high is None else out & (pads.field(key) <= high)


def nth_key(data: pads.Dataset, key: str, low: int, high: int | None, n: int) -> tuple[int | None, int]:
    """The n-th smallest key above ``low`` (the greatest if there are fewer) and how many of n there are; holds n keys and a batch."""
    best = np.empty(0, "i8")
    for batch in data.to_batches(columns=[key], filter=between(key, low, high), use_threads=False):
        best = np.concatenate([best, batch.column(0).to_numpy(zero_copy_only=False).astype("i8")])
        if len(best) > n:
            best = np.partition(best, n - 1)[:n]
    return (int(best.max()), len(best)) if len(best) else (None, 0)


class RowStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.key = options["path"], options["key"]
        self.budget, self.parts = int(options.get("budget", 100_000)), int(options.get("parts", 8))
        if self.budget < 1 or self.parts < 1:
            raise ValueError("budget and parts are 1 or more")
        self.store = f"{options['state'].rstrip('/')}/cursors.json"
        stored = get(self.store)
        self.at = json.loads(stored) if stored else {"mark": FIRST, "lap": 0, "cursor": FIRST}

    def initialOffset(self) -> dict:
        """Always the beginning: a first batch that is repeated after a crash starts here too, wherever the store is."""
        return {"mark": FIRST, "lap": 0, "cursor": FIRST}

    def latestOffset(self) -> dict:
        data, at = rows_of(self.path), dict(self.at)
        ceiling = at["mark"]
        mark, used = nth_key(data, self.key, ceiling, None, self.budget)
        if mark is not None:
            at["mark"] = mark
        left = self.budget - used
        if left > 0 and ceiling > FIRST:
            cursor, n = nth_key(data, self.key, at["cursor"], ceiling, left)
            if n < left or cursor == ceiling:  # the lap is done
                at["lap"], at["cursor"] = at["lap"] + 1, FIRST
            else:
                at["cursor"] = cursor
        self.at = at
        return dict(at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        stretches = [(start["mark"], end["mark"], "new")]
        if end["lap"] == start["lap"]:
            stretches.append((start["cursor"], end["cursor"], "rescan"))
        else:
            stretches += [(start["cursor"], start["mark"], "rescan"), (FIRST, end["cursor"], "rescan")]
        order = lambda o: (o["mark"], o["lap"], o["cursor"])
        self.at = max(dict(end), self.at, key=order)
        put(self.store, json.dumps(end))
        data = rows_of(self.path)
        out = []
        for low, high, kind in stretches:
            if high <= low:
                continue
            least, _ = nth_key(data, self.key, low, high, 1)  # the first key there is, so that stretches are of even width
            if least is None:
                continue
            cuts = [least - 1 + (high - least + 1) * k // self.parts for k in range(self.parts + 1)]
            out += [Stretch(a, b, kind) for a, b in zip(cuts, cuts[1:]) if b > a]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(self.path).to_batches(filter=between(self.key, partition.low, partition.high), use_threads=False):
            if batch.num_rows:
                yield batch.append_column("_kind", pa.array([partition.kind] * batch.num_rows))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class BatchSink(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.writer = options["path"].rstrip("/"), options["writer"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        name, out = f"data/{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def _remove(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/{m.file}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        manifest = f"{self.path}/manifest/{self.writer}-{batchId:012d}.json"
        if get(manifest) is not None:  # published before a crash
            self._remove(messages)
            return
        put(manifest, json.dumps([m.file for m in messages if m is not None and m.file]))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._remove(messages)


class ForeignRows(DataSource):
    """Options: ``path``, ``key``, ``state`` (a folder), ``budget`` rows a batch, ``parts`` tasks a stretch."""

    @classmethod
    def name(cls) -> str:
        return "foreign_rows"

    def schema(self) -> StructType:
        schema = rows_of(self.options["path"]).schema
        if "_kind" in schema.names:
            raise ValueError("the table has a column _kind")
        return from_arrow_schema(schema.append(pa.field("_kind", pa.string())), prefer_timestamp_ntz=True)

    def streamReader(self, schema: StructType) -> RowStream:
        return RowStream(self.options)


class ForeignBatches(DataSource):
    """Options: ``path`` and ``writer``, a name that stays with the stream's checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "foreign_batches"

    def streamWriter(self, schema: StructType, overwrite: bool) -> BatchSink:
        return BatchSink(self.options)


def register(spark: SparkSession) -> None:
    for source in (ForeignRows, ForeignBatches):
        spark.dataSource.register(source)


def published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches that were published."""
    root = path.rstrip("/")
    fs, p = file_system(f"{root}/manifest")
    if fs.get_file_info(p).type != pafs.FileType.Directory:
        return spark.createDataFrame([], schema)
    lists = spark.read.option("pathGlobFilter", "*.json").text(f"{root}/manifest").select(F.explode(F.from_json("value", "array<string>")).alias("f"))
    files = [f"{root}/{r.f}" for r in lists.collect()]  # names of files, as any listing of a table has them
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def sweep_once(spark: SparkSession, path: str, key: str, folder: str, budget: int = 100_000, parts: int = 8) -> dict[str, Any]:
    """One bounded sweep into ``folder``; returns the cursors after it."""
    register(spark)
    rows = spark.readStream.format("foreign_rows").options(path=path, key=key, state=f"{folder}/state", budget=str(budget), parts=str(parts)).load()
    out = rows.writeStream.format("foreign_batches").option("path", f"{folder}/rows").option("writer", "sweep").option("checkpointLocation", f"{folder}/checkpoint")
    q = out.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return json.loads(get(f"{folder}/state/cursors.json") or "null") or {"mark": FIRST, "lap": 0, "cursor": FIRST}


def changed(swept: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose content, by its hash, differs between sweeps: ``key, versions``."""
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return swept.groupBy(key).agg(F.count_distinct(content).alias("versions")).where("versions > 1")


@query("s26_two_cursors", "SELECT event_id, 1::BIGINT AS fresh, 1::BIGINT AS again FROM events")
def s26b(spark, d):
    """Bounded sweeps over a foreign table until all rows came as new and one lap read them again."""
    path, folder, budget = f"{d}/events.parquet", work_folder(spark, "foreign"), 2_000_000
    at = sweep_once(spark, path, "event_id", folder, budget)
    while at["lap"] < 1 and at["mark"] > FIRST:
        at = sweep_once(spark, path, "event_id", folder, budget)
    rows = published(spark, f"{folder}/rows", ForeignRows({"path": path}).schema())
    return rows.groupBy("event_id").agg(F.count_if(F.col("_kind") == "new").alias("fresh"), F.count_if(F.col("_kind") == "rescan").alias("again"))
