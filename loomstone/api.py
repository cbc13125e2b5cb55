"""Façade: one object over a log of events; reads return DataFrames, writes return an engine over a longer log.

The log has the columns ``event_id, type, actor, owner, entity, predicate, value, text, ref, occurred_at,
recorded_at``.  Nothing is changed in place: ``remember``, ``correct``, ``forget`` and the like append
events, and every read is a fold of the log, so ``as_of`` works for all of them.  A write adds files to the
log's folder under the shared one; an engine reads the files that were there when it was made, in one scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import content_id
from .operators.answering import RULES, best_sentence
from .operators.curation import roots
from .operators.eventlog import append, latest
from .operators.retrieval import top
from .operators.segments import SegmentedIndex
from .sources.mirror import work_folder

SCHEMA = (
    "event_id string, type string, actor string, owner string, entity string, predicate string, value string, text string, "
    "ref string, occurred_at timestamp, recorded_at timestamp"
)


class Engine:
    """Reads and writes over one log, for one principal."""

    def __init__(self, log: DataFrame, principal: str = "_user", paths: tuple[str, ...] = ()):
        self.log, self.principal, self.paths = log, principal, paths
        self.disabled: frozenset[str] = frozenset()
        self._index: SegmentedIndex | None = None  # of this log or a shorter one
        self._indexed = False

    @classmethod
    def empty(cls, spark: SparkSession, principal: str = "_user") -> Engine:
        return cls(spark.createDataFrame([], SCHEMA), principal)

    @property
    def spark(self) -> SparkSession:
        return self.log.sparkSession

    # writes: each returns an engine over the longer log

    def append(self, events: DataFrame) -> Engine:
        """Events with content-addressed ids; what the log has already is not added again."""
        names = [c for c in self.log.columns if c != "event_id"]
        rows = events.select(*(F.col(c) if c in events.columns else F.lit(None).cast(self.log.schema[c].dataType).alias(c) for c in names))
        rows = rows.withColumn("event_id", content_id("ev_", *(F.col(c) for c in names if c != "recorded_at"))).select(*self.log.columns)
        paths = self.paths
        if not paths:
            paths = (f"{work_folder(self.spark, 'log')}/0",)
            self.log.write.parquet(paths[0])
        folder = paths[0].rsplit("/", 1)[0]
        new = f"{folder}/{len(paths)}-{uuid.uuid4().hex[:8]}"
        append(self.log, rows).write.parquet(new)
        paths = (*paths, new)
        out = Engine(self.spark.read.schema(self.log.schema).parquet(*paths), self.principal, paths)
        out.disabled = self.disabled
        out._index = self._index
        return out

    def _event(self, type_: str, at: str, **fields: str) -> Engine:
        row = {"type": type_, "actor": "user", "owner": self.principal, **fields}
        df = self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()), F.lit(at).cast("timestamp").alias("occurred_at"), F.lit(at).cast("timestamp").alias("recorded_at"))
        return self.append(df)

    def sync_turn(self, text: str, at: str, actor: str = "user") -> Engine:
        return self._event("observed", at, text=text, actor=actor)

    def remember(self, entity: str, predicate: str, value: str, at: str) -> Engine:
        return self._event("asserted", at, entity=entity, predicate=predicate, value=value)

    def correct(self, entity: str, predicate: str, value: str, at: str) -> Engine:
        return self._event("corrected", at, entity=entity, predicate=predicate, value=value)

    def forget(self, entity: str, predicate: str, at: str) -> Engine:
        return self._event("retracted", at, entity=entity, predicate=predicate)

    def forbid(self, text: str, at: str) -> Engine:
        """Erase: observations with this content are not read any more."""
        return self._event("forbidden", at, ref=self.spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0])

    def grant_read(self, to: str, at: str) -> Engine:
        return self._event("grant", at, ref=to)

    def revoke_read(self, to: str, at: str) -> Engine:
        return self._event("revoke", at, ref=to)

    def note_informed(self, entity: str, predicate: str, at: str) -> Engine:
        return self._event("informed", at, entity=entity, predicate=predicate)

    def merge(self, entity: str, into: str, at: str) -> Engine:
        return self._event("merged", at, entity=entity, ref=into)

    def unmerge(self, entity: str, at: str) -> Engine:
        return self._event("unmerged", at, entity=entity)

    def withdraw_consent(self, at: str) -> Engine:
        """Observations of this principal are not read any more, by anyone."""
        return self._event("consent_withdrawn", at)

    def reflect(self, situation: str, lesson: str, at: str) -> Engine:
        return self._event("reflected", at, text=situation, value=lesson)

    def add_goal(self, text: str, at: str) -> Engine:
        return self._event("goal", at, text=text)

    def pin(self, entity: str, predicate: str, at: str) -> Engine:
        """Facts of this key always go into the context."""
        return self._event("pinned", at, entity=entity, predicate=predicate)

    def unpin(self, entity: str, predicate: str, at: str) -> Engine:
        return self._event("unpinned", at, entity=entity, predicate=predicate)

    def review_link_candidate(self, entity: str, record: str, accept: bool, at: str) -> Engine:
        return self._event("adjudicated", at, entity=entity, ref=record, value="accepted" if accept else "rejected")

    def set_rule_enabled(self, name: str, on: bool) -> Engine:
        out = Engine(self.log, self.principal)
        out.disabled = self.disabled - {name} if on else self.disabled | {name}
        return out

    # reads

    def as_of(self, knowledge: str) -> Engine:
        """The engine as it was at a knowledge time."""
        out = Engine(self.log.where(F.col("recorded_at") <= F.lit(knowledge).cast("timestamp")), self.principal)
        out.disabled = self.disabled
        return out

    def readable(self) -> DataFrame:
        """The log's rows whose owner is this principal or grants it to read (the last grant or revoke decides)."""
        acl = self.log.where("type IN ('grant', 'revoke')").where(F.col("ref") == self.principal)
        open_ = latest(acl.select("owner", "type", "recorded_at", "event_id"), ["owner"], "recorded_at", "event_id").where("type = 'grant'").select("owner")
        mine = self.log.where(F.col("owner") == self.principal)
        return mine.union(self.log.where(F.col("owner") != self.principal).join(open_, "owner", "left_semi").select(*self.log.columns))

    def facts(self) -> DataFrame:
        """Active facts: the last assertion or correction of each key that is not retracted."""
        e = self.readable().where("type IN ('asserted', 'corrected', 'retracted')")
        e = self._merged(e.select("owner", "entity", "predicate", "value", "type", "recorded_at", "event_id"))
        return latest(e, ["owner", "entity", "predicate"], "recorded_at", "event_id").where("type <> 'retracted'").drop("type")

    def _merged(self, rows: DataFrame) -> DataFrame:
        """``rows`` with every entity replaced by the one it was merged into, along chains; the last merge or unmerge decides."""
        links = self.readable().where("type IN ('merged', 'unmerged')").select("entity", "ref", "type", "recorded_at", "event_id")
        links = latest(links, ["entity"], "recorded_at", "event_id").where("type = 'merged' AND entity <> ref").select(F.col("entity").alias("node"), F.col("ref").alias("to"))
        if links.isEmpty():
            return rows
        ends = roots(links).withColumnRenamed("node", "entity")
        return rows.join(ends, "entity", "left").withColumn("entity", F.coalesce("root", "entity")).select(*rows.columns)

    def history(self, entity: str, predicate: str) -> DataFrame:
        e = self.readable().where((F.col("entity") == entity) & (F.col("predicate") == predicate) & F.col("type").isin("asserted", "corrected", "retracted"))
        return e.select("event_id", "type", "value", "recorded_at").orderBy("recorded_at", "event_id")

    def timeline(self, limit: int = 50) -> DataFrame:
        e = self.readable().where("type = 'observed'")
        return e.select("event_id", "actor", "text", "occurred_at").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)

    def observed(self) -> DataFrame:
        gone = self.log.where("type = 'forbidden'").select(F.col("ref").alias("h")).distinct()
        e = self.readable().where("type = 'observed'").withColumn("h", F.sha2("text", 256)).join(gone, "h", "left_anti").drop("h")
        no = self.log.where("type = 'consent_withdrawn'").select("owner").distinct()
        return e.join(no, "owner", "left_anti").select(*self.log.columns)

    def search(self, words: list[str], limit: int = 10) -> DataFrame:
        """Observations by BM25 of a bounded list of words."""
        if not self._indexed:  # what came and what went since the shorter log's index; texts of an id don't change
            index = self._index.fork() if self._index else SegmentedIndex.create(self.spark)
            rows = self.observed().select("event_id", "text")
            if index.manifest.segments:
                index.delete(index.documents().select(F.col("doc").alias("event_id")).join(rows, "event_id", "left_anti"), "event_id")
                rows = rows.join(index.documents().select(F.col("doc").alias("event_id")), "event_id", "left_anti")
            index.append(rows, "event_id", "text")
            self._index, self._indexed = index, True
        return top(self._index.search(words, limit), limit)

    def answer(self, words: list[str], least_score: float = 0.0) -> DataFrame:
        """The best observation's sentence, or no row (abstain)."""
        best = self.search(words, 1).where(F.col("score") > least_score)
        return self.observed().join(F.broadcast(best), F.col("event_id") == F.col("doc")).select("event_id", best_sentence(F.col("text"), words).alias("answer"), "score")

    def ask_about(self, entity: str) -> DataFrame:
        return self.facts().where(F.col("entity") == entity).select("predicate", "value", "recorded_at")

    def list_contradictions(self) -> DataFrame:
        """Keys to which different owners give different values."""
        g = self.facts().groupBy("entity", "predicate").agg(F.count_distinct("value").alias("values"), F.min("event_id").alias("first_id"))
        return g.where("values > 1")

    def explain(self, entity: str, predicate: str) -> DataFrame:
        """The events that a fact rests on, oldest first; no row if it can't be read, as if it were not there."""
        return self.history(entity, predicate).join(self.facts().where((F.col("entity") == entity) & (F.col("predicate") == predicate)).select(F.lit(True).alias("on")).limit(1), how="left_semi")

    def links(self) -> DataFrame:
        """Reviewed links of entities to records: the last decision on each."""
        e = self.readable().where("type = 'adjudicated'").select("entity", "ref", F.col("value").alias("status"), "recorded_at", "event_id")
        return latest(e, ["entity", "ref"], "recorded_at", "event_id").select("entity", "ref", "status")

    def pinned(self) -> DataFrame:
        e = self.readable().where("type IN ('pinned', 'unpinned')").select("entity", "predicate", "type", "recorded_at", "event_id")
        on = latest(e, ["entity", "predicate"], "recorded_at", "event_id").where("type = 'pinned'").select("entity", "predicate")
        return self.facts().join(on, ["entity", "predicate"], "left_semi")

    def reflections(self, word: str, limit: int = 5) -> DataFrame:
        e = self.readable().where("type = 'reflected'").where(F.contains(F.lower("text"), F.lit(word.lower())) | F.contains(F.lower("value"), F.lit(word.lower())))
        return e.select("event_id", F.col("text").alias("situation"), F.col("value").alias("lesson")).orderBy("event_id").limit(limit)

    def goals(self) -> DataFrame:
        return self.readable().where("type = 'goal'").select("event_id", "text", "recorded_at")

    def expand(self, event_id: str) -> DataFrame:
        """The whole text of an observation, by its id."""
        return self.observed().where(F.col("event_id") == event_id).select("event_id", "actor", "text")

    def plan_context(self, words: list[str], budget: int = 1500) -> DataFrame:
        """What bears on a plan: ``kind, ref, text`` of context, pinned facts, reflections and goals."""
        parts = [
            self.get_context(words, budget).select(F.lit("context").alias("kind"), F.col("event_id").alias("ref"), "text"),
            self.pinned().select(F.lit("pinned").alias("kind"), F.col("event_id").alias("ref"), F.concat_ws(" ", "entity", "predicate", "value").alias("text")),
            self.goals().select(F.lit("goal").alias("kind"), F.col("event_id").alias("ref"), "text"),
            *(self.reflections(w).select(F.lit("reflection").alias("kind"), F.col("event_id").alias("ref"), F.col("lesson").alias("text")) for w in words),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def what_user_knows(self) -> DataFrame:
        return self.readable().where("type = 'informed'").groupBy("entity", "predicate").agg(F.count(F.lit(1)).alias("times"))

    def derived(self) -> DataFrame:
        facts = self.facts().select("entity", "predicate", F.col("value").try_cast("double").alias("value"))
        out = self.spark.createDataFrame([], "entity string, predicate string, value string, confidence double")
        for name, f in RULES.items():
            if name not in self.disabled:
                out = out.union(f(facts))
        return out

    def list_derivation_rules(self) -> list[str]:
        return sorted(RULES)

    def get_context(self, words: list[str], budget: int = 1500) -> DataFrame:
        """The best observations in rank order while their characters fit the budget."""
        from pyspark.sql import Window

        hits = self.search(words, 40)
        rows = self.observed().join(F.broadcast(hits), F.col("event_id") == F.col("doc")).select("rank", "event_id", "text")
        used: Column = F.sum(F.length("text")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # 40 rows at most
        return rows.withColumn("used", used).where(F.col("used") <= budget).orderBy("rank")

    def diagnostics(self) -> DataFrame:
        return self.log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner").alias("owners"))
