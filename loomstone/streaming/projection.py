"""The projection kept up as the log grows: snapshots of partial aggregates plus a suffix, and a keyed stream.

A belief's state is made of maxima by (time, sequence) and of counts, and both can be merged.  ``Projection``
keeps the log as parts, one for each append, and now and then a snapshot: the partial aggregates of all parts
up to one.  A read merges the newest snapshot with the partial aggregates of the parts after it, so it folds
the suffix and not the log.  Order doesn't matter to maxima, so late events need nothing special; events that
come again are dropped on append, where only parts whose range of sequence numbers meets the batch's are
read.  A read as of a time starts from the newest snapshot that has nothing later.

A manifest of one small file for each version names the parts and snapshots that count.

``stream_beliefs`` is the same fold as a stream: a map of partial aggregates by predicate for each entity, the
sequence numbers seen by day, and a timer that forgets a day once the watermark has passed it; rows older than
the watermark don't reach the fold, so what was forgotten can't come again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.eventlog import clamp_to_ceiling, raw_confidence
from ..operators.folding import AS_OF, KLOG, _state_sql, klog, knowledge_log
from ..operators.search import generation
from ..plans.registry import query
from ..sources.mirror import work_folder
from .sweeps import stream

#: What the last event of some types leaves (fixed values): types, and the column that counts.
LATEST = {
    "value": ("asserted corrected", "value"),
    "last": ("asserted corrected retracted", "type"),
    "fidelity": ("decayed", "value"),
    "last_seen": ("rehearsed", "ts"),
    "verification": ("verified", "value"),
}
COUNTS = {"supports": "asserted", "confirms": "confirmed", "contradictions": "contradicted"}
KEYS = ["entity", "predicate"]
DAY_MS = 86_400_000


def partials(log: DataFrame) -> DataFrame:
    """Partial aggregates of a part of the log, by entity and predicate."""
    among = lambda types: F.col("type").isin(*types.split())
    latest = [F.max(F.when(among(t), F.struct("ts", "seq", F.col(c).alias("x")))).alias(name) for name, (t, c) in LATEST.items()]
    return log.groupBy(*KEYS).agg(*latest, *(F.count_if(F.col("type") == t).alias(name) for name, t in COUNTS.items()))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Partial aggregates of several parts as those of all of them."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*KEYS).agg(*(F.max(c).alias(c) for c in LATEST), *(F.sum(c).alias(c) for c in COUNTS))


def confidence(confirms: Column, contradictions: Column, supports: Column, verified: Column) -> Column:
    return clamp_to_ceiling(raw_confidence(F.lit(0.6), confirms, contradictions), F.least(F.lit(4), supports).cast("int"), verified)


def beliefs(state: DataFrame) -> DataFrame:
    """The projection's rows from whole aggregates."""
    s = state.where("value IS NOT NULL AND value.x IS NOT NULL")
    c = confidence(F.col("confirms"), F.col("contradictions"), F.col("supports"), F.col("verification.x").isNotNull())
    return s.select(
        *KEYS, F.col("value.x").alias("value"), F.when(F.col("last.x") == "retracted", "retracted").otherwise("active").alias("status"), *COUNTS,
        F.round(c, 6).alias("confidence"), F.col("fidelity.x").alias("fidelity"), F.col("last_seen.x").alias("last_seen"), F.col("verification.x").alias("verification"),
    )


@dataclass(frozen=True)
class Part:
    folder: str
    low: int
    high: int


@dataclass(frozen=True)
class Snapshot:
    folder: str
    parts: int  # it holds the first so many parts
    until: str  # the latest time in it


@dataclass(frozen=True)
class State:
    version: int = 0
    parts: tuple[Part, ...] = ()
    snapshots: tuple[Snapshot, ...] = ()


@dataclass
class Projection:
    spark: SparkSession
    folder: str
    state: State = field(default_factory=State)

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None) -> Projection:
        p = cls(spark, folder or work_folder(spark, "projection"))
        p._publish(State())
        return p

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Projection:
        m = json.loads(spark.read.text(f"{folder}/manifest").orderBy(F.desc("v")).first().value)
        return cls(spark, folder, State(m["version"], tuple(Part(**x) for x in m["parts"]), tuple(Snapshot(**x) for x in m["snapshots"])))

    def _publish(self, s: State) -> None:
        line = json.dumps({"version": s.version, "parts": [x.__dict__ for x in s.parts], "snapshots": [x.__dict__ for x in s.snapshots]})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("error").text(f"{self.folder}/manifest/v={s.version:09d}")
        self.state = s

    def append(self, log: DataFrame) -> int:
        """Add events (``seq, ts, entity, predicate, value, type``); those whose sequence number is known are dropped.

        Gives the number of events added.  Of rows with one number in the batch the greatest is kept.
        """
        s, name = self.state, f"{self.folder}/log/{self.state.version + 1}"
        columns = ["seq", "ts", *KEYS, "value", "type"]
        rows = log.where("seq IS NOT NULL").select(F.struct(*columns).alias("r")).groupBy(F.col("r.seq").alias("k")).agg(F.max("r").alias("r")).select("r.*")
        rows.write.parquet(f"{name}-offered")
        rows = self.spark.read.parquet(f"{name}-offered")
        span = rows.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
        if span.low is None:
            return 0
        old = [p.folder for p in s.parts if p.low <= span.high and p.high >= span.low]
        if old:
            rows = rows.join(self.spark.read.parquet(*old).select("seq"), "seq", "left_anti").select(*columns)
        rows.write.parquet(name)
        new = self.spark.read.parquet(name).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
        if new.n:
            self._publish(State(s.version + 1, (*s.parts, Part(name, new.low, new.high)), s.snapshots))
        else:
            self._publish(replace(s, version=s.version + 1))
        return new.n

    def _log(self, parts: tuple[Part, ...]) -> DataFrame:
        return self.spark.read.parquet(*(p.folder for p in parts))

    def snapshot(self) -> None:
        """Write the aggregates of all parts; the parts since the last snapshot are read, and that snapshot."""
        s = self.state
        if not s.parts or (s.snapshots and s.snapshots[-1].parts == len(s.parts)):
            return
        name = f"{self.folder}/snapshot/{s.version + 1}"
        self._aggregates(None).write.parquet(name)
        until = self._log(s.parts[s.snapshots[-1].parts if s.snapshots else 0 :]).agg(F.max("ts").cast("string").alias("t")).first().t
        until = max([x for x in (until, s.snapshots[-1].until if s.snapshots else None) if x], default="")
        self._publish(State(s.version + 1, s.parts, (*s.snapshots, Snapshot(name, len(s.parts), until))))

    def start(self, as_of: str | None) -> Snapshot | None:
        """The snapshot that a read begins with."""
        fit = [x for x in self.state.snapshots if as_of is None or x.until <= as_of]
        return fit[-1] if fit else None

    def _aggregates(self, as_of: str | None) -> DataFrame:
        base = self.start(as_of)
        suffix = self.state.parts[base.parts if base else 0 :]
        parts = [self.spark.read.parquet(base.folder)] if base else []
        if suffix:
            log = self._log(suffix)
            parts.append(partials(log if as_of is None else log.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))))
        return merged(parts) if len(parts) > 1 else parts[0]

    def read(self, as_of: str | None = None) -> DataFrame:
        """All beliefs, or those as of a time ``YYYY-MM-DD hh:mm:ss``."""
        if not self.state.parts:
            return beliefs(partials(self.spark.createDataFrame([], "seq long, ts timestamp_ntz, entity long, predicate long, value long, type string")))
        return beliefs(self._aggregates(as_of))


class Fold(StatefulProcessor):
    """An entity's beliefs by predicate; rows come in any order and may come again."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        latest = ", ".join(f"{n}_ts long, {n}_seq long, {n}_x {'string' if n == 'last' else 'long'}" for n in LATEST)
        self.fields = [f"{n}_{p}" for n in LATEST for p in ("ts", "seq", "x")] + [*COUNTS, "n"]
        self.beliefs = handle.getMapState("beliefs", "predicate long", f"{latest}, {', '.join(f'{c} long' for c in COUNTS)}, n long")
        self.seen = handle.getMapState("seen", "day long", "seqs array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen: dict[int, set[int]] = {}
        states: dict[int, dict] = {}
        for batch in rows:
            for seq, ms, predicate, value, type_ in zip(batch["seq"], batch["ms"], batch["predicate"], batch["value"], batch["type"]):
                seq, ms, predicate, value = int(seq), int(ms), int(predicate), None if pd.isna(value) else int(value)
                day = ms // (1000 * DAY_MS)
                if day not in seen:
                    seen[day] = set(self.seen.getValue((day,))[0]) if self.seen.containsKey((day,)) else set()
                if seq in seen[day]:
                    continue
                seen[day].add(seq)
                if predicate not in states:
                    have = self.beliefs.getValue((predicate,)) if self.beliefs.containsKey((predicate,)) else [None] * (3 * len(LATEST)) + [0] * (len(COUNTS) + 1)
                    states[predicate] = dict(zip(self.fields, have))
                s = states[predicate]
                s["n"] += 1
                for name, t in COUNTS.items():
                    s[name] += type_ == t
                for name, (types, column) in LATEST.items():
                    if type_ in types.split() and (s[f"{name}_ts"] is None or (ms, seq) > (s[f"{name}_ts"], s[f"{name}_seq"])):
                        s[f"{name}_ts"], s[f"{name}_seq"], s[f"{name}_x"] = ms, seq, {"value": value, "type": type_, "ts": ms}[column]
        for day, seqs in seen.items():
            self.seen.updateValue((day,), (sorted(seqs),))
            self.handle.registerTimer((day + 1) * DAY_MS + self.delay_ms)
        for predicate, s in states.items():
            self.beliefs.updateValue((predicate,), tuple(s[f] for f in self.fields))
        if states:
            yield pd.DataFrame([{"entity": key[0], "predicate": p, "n": s["n"], **{c: s[c] for c in COUNTS}, **{c: s[f"{c}_x"] for c in LATEST}} for p, s in states.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        for (day,) in list(self.seen.keys()):
            if (day + 1) * DAY_MS <= past:
                self.seen.removeKey((day,))
        return iter(())

    def close(self) -> None:
        pass


FOLDED = "entity long, predicate long, n long, supports long, confirms long, contradictions long, value long, last string, fidelity long, last_seen long, verification long"


def stream_beliefs(log: DataFrame, folder: str, late: str = "2 days", delay_ms: int = DAY_MS) -> DataFrame:
    """Fold what is new in a stream of the log (``seq, ts, entity, predicate, value, type``), and read the projection.

    Runs again on the same ``folder`` go on where the last ended.  Null sequence numbers and entities are left out.
    """
    spark = log.sparkSession
    rows = log.where("seq IS NOT NULL AND entity IS NOT NULL AND predicate IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = rows.select("seq", "at", F.unix_micros("at").alias("ms"), "entity", "predicate", "value", "type")
    folded = rows.groupBy("entity").transformWithStateInPandas(Fold(delay_ms), FOLDED, "Append", "EventTime")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = folded.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    finally:
        spark.conf.set(provider, before)
    q.awaitTermination()
    out = spark.read.schema(FOLDED).parquet(f"{folder}/out")
    newest = out.groupBy(*KEYS).agg(F.max_by(F.struct(*(c for c in out.columns if c not in KEYS)), "n").alias("s")).select(*KEYS, "s.*").where("value IS NOT NULL")
    c = confidence(F.col("confirms"), F.col("contradictions"), F.col("supports"), F.col("verification").isNotNull())
    status = F.when(F.col("last") == "retracted", "retracted").otherwise("active")
    seen = F.timestamp_micros("last_seen").cast("timestamp_ntz")
    return newest.select(*KEYS, "value", status.alias("status"), *COUNTS, F.round(c, 6).alias("confidence"), "fidelity", seen.alias("last_seen"), "verification")


_kept: dict[tuple, Projection] = {}


def kept_up(spark: SparkSession, d: str) -> Projection:
    """The projection of ``events``, appended in four batches out of order that overlap, with two snapshots between."""
    key = generation(spark, f"{d}/events.parquet")
    if key not in _kept:
        log, p = klog(spark, d), Projection.create(spark)
        part = F.pmod(F.xxhash64("seq"), F.lit(4))
        for k in range(4):
            p.append(log.where((part == k) | ((part == k - 1) & (F.col("seq") % 3 == 0))))
            if k in (0, 2):
                p.snapshot()
        _kept[key] = p
    return _kept[key]


@query("r2_snapshot_and_suffix", f"WITH {KLOG}, {_state_sql()} SELECT * FROM state")
def r2s(spark, d):
    """The projection from a snapshot and the events after it, some late and some repeated."""
    return kept_up(spark, d).read()


@query("r2_snapshot_as_of", f"WITH {KLOG}, {_state_sql(AS_OF)} SELECT * FROM state")
def r2a(spark, d):
    """R2: the same as of a time, from the newest snapshot that has nothing later (or the log)."""
    return kept_up(spark, d).read("2024-01-15 00:00:00")


@query("r4_stream_beliefs", f"WITH {KLOG}, {_state_sql()} SELECT * FROM state")
def r4b(spark, d):
    """The projection as a keyed stream with map state and timers."""
    return stream_beliefs(knowledge_log(stream(spark, d, "events")), work_folder(spark, "beliefs"))
