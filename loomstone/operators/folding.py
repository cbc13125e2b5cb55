"""The fold of the log into beliefs: dispatch, conflict, provenance, identity, access and lifecycle.

``knowledge_log`` reads the table ``events`` as a log of typed knowledge events.  A handler is a branch of
that log; its state is one aggregation over the handler's natural key with map-side combining, in which the
order (recorded_at, seq) decides.  ``rebuild`` folds any prefix of the log, so replay and time travel are the
same function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query
from .curation import roots
from .eventlog import clamp_to_ceiling, raw_confidence

#: What an event of the table stands for in the log, by its type and the number ``k`` it carries.
TYPES = """CASE event_type WHEN 'signup' THEN 'asserted'
  WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'corrected' WHEN 2 THEN 'rehearsed' ELSE 'verified' END
  WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'retracted' ELSE 'decayed' END
  WHEN 'click' THEN CASE k % 6 WHEN 0 THEN 'merged' WHEN 1 THEN 'unmerged' WHEN 2 THEN 'adjudicated' WHEN 3 THEN 'linked' WHEN 4 THEN 'unlinked' ELSE 'derived' END
  ELSE CASE k % 5 WHEN 0 THEN 'informed' WHEN 1 THEN 'grant' WHEN 2 THEN 'revoke' WHEN 3 THEN 'noted' ELSE 'observed' END END"""
KLOG = f"""klog AS (SELECT event_id AS seq, ts, user_id AS entity, k % 5 AS predicate, k AS value, {TYPES} AS type FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))"""
#: Handlers by type (fixed values); what is not here is counted as unknown and left alone.
HANDLERS = {
    "observed": "index", "asserted": "belief", "confirmed": "belief", "contradicted": "belief", "corrected": "belief", "retracted": "belief",
    "derived": "belief", "informed": "communication", "grant": "access", "revoke": "access", "adjudicated": "identity", "merged": "identity",
    "unmerged": "identity", "linked": "identity", "unlinked": "identity", "decayed": "lifecycle", "rehearsed": "lifecycle", "verified": "lifecycle",
}


def knowledge_log(events: DataFrame) -> DataFrame:
    """``seq, ts, entity, predicate, value, type``."""
    rows = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("entity"), (F.col("k") % 5).alias("predicate"), F.col("k").alias("value"), F.expr(TYPES).alias("type"))


def klog(spark, d) -> DataFrame:
    return knowledge_log(load(spark, d, "events"))


def last_of(types: str, value: str) -> Column:
    """The last value among events of some types, in log order; null if there is none."""
    among = F.col("type").isin(*types.split())
    return F.max_by(F.when(among, F.col(value)), F.when(among, F.struct("ts", "seq")))


def count_of(type_: str) -> Column:
    return F.count_if(F.col("type") == type_)


def rebuild(log: DataFrame, until: str | None = None) -> DataFrame:
    """All beliefs of a prefix of the log: value, status, provenance counts, confidence and lifecycle marks."""
    rows = log if until is None else log.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    g = rows.groupBy("entity", "predicate").agg(
        last_of("asserted corrected", "value").alias("value"),
        last_of("asserted corrected retracted", "type").alias("last"),
        count_of("asserted").alias("supports"), count_of("confirmed").alias("confirms"), count_of("contradicted").alias("contradictions"),
        last_of("decayed", "value").alias("fidelity"), last_of("rehearsed", "ts").alias("last_seen"), last_of("verified", "value").alias("verification"),
    )
    g = g.where("value IS NOT NULL")
    confidence = clamp_to_ceiling(raw_confidence(F.lit(0.6), F.col("confirms"), F.col("contradictions")), F.least(F.lit(4), F.col("supports")).cast("int"), F.col("verification").isNotNull())
    return g.select("entity", "predicate", "value", F.when(F.col("last") == "retracted", "retracted").otherwise("active").alias("status"), "supports", "confirms", "contradictions", F.round(confidence, 6).alias("confidence"), "fidelity", "last_seen", "verification")


AS_OF = "ts <= TIMESTAMP '2024-01-15 00:00:00'"


def _state_sql(where: str = "true") -> str:
    among = lambda types: "type IN (" + ", ".join(f"'{t}'" for t in types.split()) + ")"
    last = lambda types, v: f"arg_max({v}, (ts, seq)) FILTER ({among(types)})"
    return f"""g AS (SELECT entity, predicate, {last('asserted corrected', 'value')} AS value, {last('asserted corrected retracted', 'type')} AS last, count(*) FILTER (type='asserted') AS supports,
      count(*) FILTER (type='confirmed') AS confirms, count(*) FILTER (type='contradicted') AS contradictions, {last('decayed', 'value')} AS fidelity, {last('rehearsed', 'ts')} AS last_seen, {last('verified', 'value')} AS verification FROM klog WHERE {where} GROUP BY ALL),
      state AS (SELECT entity, predicate, value, CASE WHEN last='retracted' THEN 'retracted' ELSE 'active' END AS status, supports, confirms, contradictions,
      round(least(greatest(0, least(1, 0.6 + 0.05*least(confirms,5) - 0.10*contradictions)), CASE least(least(4, supports) + (CASE WHEN verification IS NOT NULL THEN 1 ELSE 0 END), 4) WHEN 0 THEN 0.4 WHEN 1 THEN 0.6 WHEN 2 THEN 0.75 WHEN 3 THEN 0.9 ELSE 1.0 END),6)::DOUBLE AS confidence, fidelity, last_seen, verification FROM g WHERE value IS NOT NULL)"""


@query("r1_dispatch", f"WITH {KLOG} SELECT type, CASE type WHEN 'noted' THEN 'unknown' " + " ".join(f"WHEN '{t}' THEN '{h}'" for t, h in HANDLERS.items()) + " END AS handler, count(*) AS n, max(seq) AS last_seq FROM klog GROUP BY ALL")
def r1(spark, d):
    """Every event to the handler of its type; types without one are counted as unknown."""
    handler = F.coalesce(F.create_map(*(F.lit(x) for kv in HANDLERS.items() for x in kv))[F.col("type")], F.lit("unknown"))
    return klog(spark, d).groupBy("type", handler.alias("handler")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query("r2_rebuild", f"WITH {KLOG}, {_state_sql()} SELECT * FROM state")
def r2(spark, d):
    """R2: the whole projection from the whole log."""
    return rebuild(klog(spark, d))


@query("r2_rebuild_as_of", f"WITH {KLOG}, {_state_sql(AS_OF)} SELECT * FROM state")
def r2t(spark, d):
    """R2: the projection as of a knowledge time, by the same fold over a prefix of the log."""
    return rebuild(klog(spark, d), "2024-01-15 00:00:00")


OPERATIONAL = r"\b(ran|exit code|deployed|restarted|tool call)\b"


@query("r3_observed", r"""SELECT conv_id, turn, length(text) > 0 AS indexed, CASE WHEN role='system' THEN 'no_speaker' WHEN role='assistant' AND regexp_matches(lower(text), '\b(ran|exit code|deployed|restarted|tool call)\b') THEN 'operational'
  WHEN conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = 1) THEN 'abandoned' ELSE 'queued' END AS extraction FROM conversations""")
def r3(spark, d):
    """An observation is indexed, and queued for extraction unless it is a run-log, of an abandoned branch or of no speaker."""
    c = load(spark, d, "conversations")
    alone = c.groupBy("conv_id").agg((F.count(F.lit(1)) == 1).alias("alone"))
    why = F.when(F.col("role") == "system", "no_speaker").when((F.col("role") == "assistant") & F.lower("text").rlike(OPERATIONAL), "operational").when(F.col("alone"), "abandoned").otherwise("queued")
    return c.join(alone, "conv_id").select("conv_id", "turn", (F.length("text") > 0).alias("indexed"), why.alias("extraction"))


@query("r6_existing_lookup", f"""WITH {KLOG}, {_state_sql("ts <= TIMESTAMP '2024-01-15 00:00:00'")}, new AS (SELECT * FROM klog WHERE type='asserted' AND ts > TIMESTAMP '2024-01-15 00:00:00')
  SELECT n.seq, s.value AS existing, s.status FROM new n LEFT JOIN state s USING (entity, predicate)""")
def r6(spark, d):
    """The belief that a new assertion's natural key already has."""
    log = klog(spark, d)
    t = "2024-01-15 00:00:00"
    new = log.where((F.col("type") == "asserted") & (F.col("ts") > F.lit(t).cast("timestamp_ntz"))).select("seq", "entity", "predicate")
    return new.join(rebuild(log, t).select("entity", "predicate", F.col("value").alias("existing"), "status"), ["entity", "predicate"], "left").select("seq", "existing", "status")


@query("r8_merge_scope", f"""WITH {KLOG}, s AS (SELECT seq, type, CASE type WHEN 'asserted' THEN 'fact|' || entity || '|' || predicate || '|' || value WHEN 'observed' THEN 'note|' || entity || '|' || value WHEN 'derived' THEN 'derived|' || predicate || '|' || value ELSE 'entity|' || entity END AS scope FROM klog)
  SELECT scope, min(seq) AS kept, count(*) AS n FROM s GROUP BY scope HAVING count(*) > 1""")
def r8(spark, d):
    """Duplicates merge within the columns that their kind's scope names; the first stays."""
    parts = {"asserted": ("fact", "entity", "predicate", "value"), "observed": ("note", "entity", "value"), "derived": ("derived", "predicate", "value")}
    scope = F.concat_ws("|", F.lit("entity"), "entity")
    for kind, (name, *columns) in parts.items():
        scope = F.when(F.col("type") == kind, F.concat_ws("|", F.lit(name), *columns)).otherwise(scope)
    return klog(spark, d).groupBy(scope.alias("scope")).agg(F.min("seq").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("r13_derived", f"""WITH {KLOG}, {_state_sql()} SELECT k.seq, k.entity, count(s.entity) AS premises, round(least(0.75, 0.9*coalesce(min(s.confidence), 0)),6)::DOUBLE AS confidence, CASE WHEN count(s.entity) FILTER (s.status='active') = count(s.entity) AND count(s.entity) > 0 THEN 'active' ELSE 'draft' END AS status
  FROM klog k LEFT JOIN state s ON s.entity=k.entity AND s.predicate <= k.value % 5 WHERE k.type='derived' GROUP BY k.seq, k.entity""")
def r13(spark, d):
    """A derived belief rests on premises of its entity; confidence is 0.9 of the weakest, at most 0.75; without live premises a draft."""
    log = klog(spark, d)
    s = rebuild(log).select(F.col("entity").alias("e"), F.col("predicate").alias("p"), "confidence", "status")
    k = log.where("type = 'derived'").select("seq", "entity", (F.col("value") % 5).alias("top"))
    g = k.join(s, (F.col("entity") == F.col("e")) & (F.col("p") <= F.col("top")), "left").groupBy("seq", "entity")
    g = g.agg(F.count("e").alias("premises"), F.min("confidence").alias("weakest"), F.count_if(F.col("status") == "active").alias("live"))
    return g.select("seq", "entity", "premises", F.round(F.least(F.lit(0.75), 0.9 * F.coalesce("weakest", F.lit(0.0))), 6).alias("confidence"), F.when((F.col("live") == F.col("premises")) & (F.col("premises") > 0), "active").otherwise("draft").alias("status"))


@query("r14_informed", f"WITH {KLOG} SELECT sha256(entity || ':' || value) AS proposition, entity AS owner, count(*) AS times_communicated, min(ts) AS first_told FROM klog WHERE type='informed' GROUP BY entity, value")
def r14(spark, d):
    """How often each proposition was told to its owner."""
    told = klog(spark, d).where("type = 'informed'")
    g = told.groupBy("entity", "value").agg(F.count(F.lit(1)).alias("times_communicated"), F.min("ts").alias("first_told"))
    return g.select(F.sha2(F.concat_ws(":", "entity", "value"), 256).alias("proposition"), F.col("entity").alias("owner"), "times_communicated", "first_told")


@query("r15_grants_folded", f"""WITH {KLOG}, l AS (SELECT entity AS owner, value % 7 AS principal, arg_max(type, (ts, seq)) AS last FROM klog WHERE type IN ('grant','revoke') GROUP BY ALL)
  SELECT owner, list_sort(list(principal) FILTER (last='grant')) AS allow, list_sort(list(principal) FILTER (last='revoke')) AS closed FROM l GROUP BY owner""")
def r15(spark, d):
    """Ordered updates of an access list: the last grant or revoke of each principal decides, then the lists are gathered."""
    g = klog(spark, d).where("type IN ('grant', 'revoke')").groupBy(F.col("entity").alias("owner"), (F.col("value") % 7).alias("principal")).agg(last_of("grant revoke", "type").alias("last"))
    listed = lambda t: F.array_sort(F.collect_list(F.when(F.col("last") == t, F.col("principal"))))
    none = lambda c: F.when(F.size(c) > 0, c)
    return g.groupBy("owner").agg(none(listed("grant")).alias("allow"), none(listed("revoke")).alias("closed"))


@query("r16_adjudicated", f"""WITH {KLOG} SELECT entity, value // 10 AS candidate, CASE arg_max(value, (ts, seq)) % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'deferred' END AS status, count(*) AS reviews FROM klog WHERE type='adjudicated' GROUP BY entity, value // 10""")
def r16(spark, d):
    """An identity candidate has the status of its last review."""
    a = klog(spark, d).where("type = 'adjudicated'").withColumn("candidate", F.expr("value div 10"))
    last = last_of("adjudicated", "value") % 3
    return a.groupBy("entity", "candidate").agg(F.when(last == 0, "accepted").when(last == 1, "rejected").otherwise("deferred").alias("status"), F.count(F.lit(1)).alias("reviews"))


@query("r17_lifecycle_marks", f"""WITH {KLOG} SELECT entity, predicate, arg_max(value % 4, (ts, seq)) FILTER (type='decayed') AS fidelity, max(ts) FILTER (type='rehearsed') AS last_seen, count(*) FILTER (type='rehearsed') AS rehearsals,
  arg_max(value % 2 = 0, (ts, seq)) FILTER (type='verified') AS verified FROM klog WHERE type IN ('decayed','rehearsed','verified') GROUP BY ALL""")
def r17(spark, d):
    """Fidelity, last seen and verification are what the last event of each kind says."""
    m = klog(spark, d).where("type IN ('decayed', 'rehearsed', 'verified')").withColumn("v4", F.col("value") % 4).withColumn("even", F.col("value") % 2 == 0)
    return m.groupBy("entity", "predicate").agg(last_of("decayed", "v4").alias("fidelity"), last_of("rehearsed", "ts").alias("last_seen"), count_of("rehearsed").alias("rehearsals"), last_of("verified", "even").alias("verified"))


MERGES = f"{KLOG}, links AS (SELECT entity, arg_max(type, (ts, seq)) AS last, arg_max(value % (entity + 1), (ts, seq)) AS target FROM klog WHERE type IN ('merged','unmerged') GROUP BY entity), l AS (SELECT entity AS node, target AS nxt FROM links WHERE last='merged' AND target < entity)"


def merges(log: DataFrame) -> DataFrame:
    """``node, to``: entities whose last merge or unmerge is a merge, into a smaller one."""
    m = log.where("type IN ('merged', 'unmerged')").withColumn("target", F.col("value") % (F.col("entity") + 1))
    last = m.groupBy("entity").agg(last_of("merged unmerged", "type").alias("last"), last_of("merged unmerged", "target").alias("to"))
    return last.where("last = 'merged' AND to < entity").select(F.col("entity").alias("node"), "to")


@query("r18_merged", f"WITH RECURSIVE {MERGES}, w AS (SELECT node, nxt AS root FROM l UNION ALL SELECT w.node, l.nxt FROM w JOIN l ON l.node=w.root) SELECT node, min(root) AS root FROM w GROUP BY node")
def r18(spark, d):
    """The entity each merged one ends in, along chains of last merges."""
    return roots(merges(klog(spark, d)))


@query("r18_facts_after_merges", f"""WITH RECURSIVE {MERGES}, w AS (SELECT node, nxt AS root FROM l UNION ALL SELECT w.node, l.nxt FROM w JOIN l ON l.node=w.root), e AS (SELECT node, min(root) AS root FROM w GROUP BY node)
  SELECT coalesce(e.root, k.entity) AS entity, predicate, arg_max(value, (ts, seq)) AS value, count(*) AS supports FROM klog k LEFT JOIN e ON e.node=k.entity WHERE type='asserted' GROUP BY ALL""")
def r18f(spark, d):
    """Facts of a merged family are facts of its root."""
    log = klog(spark, d)
    facts = log.where("type = 'asserted'").join(roots(merges(log)).withColumnRenamed("node", "entity"), "entity", "left").withColumn("entity", F.coalesce("root", "entity"))
    return facts.groupBy("entity", "predicate").agg(last_of("asserted", "value").alias("value"), count_of("asserted").alias("supports"))


@query("r19_federated_links", f"WITH {KLOG}, l AS (SELECT entity, value % 4 AS provider, arg_max(type, (ts, seq)) AS last, arg_max(value, (ts, seq)) AS record FROM klog WHERE type IN ('linked','unlinked') GROUP BY ALL) SELECT entity, provider, record FROM l WHERE last='linked'")
def r19(spark, d):
    """The record of a provider that an entity is linked to, unless it was unlinked last."""
    m = klog(spark, d).where("type IN ('linked', 'unlinked')").withColumn("provider", F.col("value") % 4)
    g = m.groupBy("entity", "provider").agg(last_of("linked unlinked", "type").alias("last"), last_of("linked unlinked", "value").alias("record"))
    return g.where("last = 'linked'").select("entity", "provider", "record")


@query("r20_recomputed_confidence", f"WITH {KLOG}, {_state_sql()} SELECT status, count(*) AS n, round(avg(confidence),6) AS mean, round(min(confidence),6)::DOUBLE AS low, round(max(confidence),6)::DOUBLE AS high, sum(supports)::BIGINT AS supports FROM state GROUP BY status")
def r20(spark, d):
    """Confidence recomputed from supports, confirmations and contradictions, under its ceiling; by status."""
    s = rebuild(klog(spark, d))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.sum("supports").alias("supports"))


@query("r23_truncate_and_replay", f"WITH {KLOG}, {_state_sql()} SELECT count(*) AS beliefs, true AS same FROM state")
def r23(spark, d):
    """The projection is dropped and folded anew from the log; nothing is lost or changed."""
    log = klog(spark, d)
    one, two = rebuild(log), rebuild(log.where("type <> 'noted'"))
    digest = lambda s: s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("entity", "predicate", "value", "status", "confidence").cast("decimal(38,0)")).alias("h"))
    return digest(one).alias("a").join(digest(two).alias("b")).select(F.col("a.n").alias("beliefs"), ((F.col("a.h") == F.col("b.h")) & (F.col("a.n") == F.col("b.n"))).alias("same"))  # one row each


@query("s5_type_scan", f"WITH {KLOG} SELECT seq, entity, value FROM klog WHERE type='asserted' AND seq > 100")
def s5(spark, d):
    """All events of a type after a sequence number."""
    return klog(spark, d).where("type = 'asserted' AND seq > 100").select("seq", "entity", "value")


@query("a28_inferred_merges", f"WITH {KLOG} SELECT count(*) FILTER (value % 12 = 0) AS inferred, count(*) AS merges FROM klog WHERE type='merged'")
def a28(spark, d):
    """How many merges were inferred from an exact name."""
    return klog(spark, d).where("type = 'merged'").agg(F.count_if(F.col("value") % 12 == 0).alias("inferred"), F.count(F.lit(1)).alias("merges"))


@query("j20_supersede_chains", f"""WITH {KLOG}, f AS (SELECT seq, entity, predicate, value, ts, row_number() OVER (PARTITION BY entity, predicate ORDER BY ts, seq) AS i FROM klog WHERE type IN ('asserted','corrected'))
  SELECT entity, predicate, list(seq ORDER BY i) AS chain FROM f WHERE i <= 10 GROUP BY ALL HAVING count(*) > 1""")
def j20(spark, d):
    """The chain of facts that superseded each other under a key, by date, at most ten."""
    w = Window.partitionBy("entity", "predicate").orderBy("ts", "seq")
    f = klog(spark, d).where("type IN ('asserted', 'corrected')").withColumn("i", F.row_number().over(w)).where("i <= 10")
    g = f.groupBy("entity", "predicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "seq"))), lambda x: x["seq"]).alias("chain"))
    return g.where(F.size("chain") > 1)


@query("j21_history_walk", f"""WITH {KLOG}, f AS (SELECT seq, entity, predicate, value, value % 6 <> 5 AS readable, row_number() OVER (PARTITION BY entity, predicate ORDER BY ts DESC, seq DESC) AS hop FROM klog WHERE type IN ('asserted','corrected')),
  r AS (SELECT *, min(readable::INT) OVER (PARTITION BY entity, predicate ORDER BY hop ROWS UNBOUNDED PRECEDING) AS ok FROM f WHERE hop <= 100) SELECT entity, predicate, hop::BIGINT AS hop, seq, value FROM r WHERE ok = 1""")
def j21(spark, d):
    """From the newest fact back through what it superseded, at most 100 hops, up to the first that can't be read."""
    w = Window.partitionBy("entity", "predicate").orderBy(F.desc("ts"), F.desc("seq"))
    f = klog(spark, d).where("type IN ('asserted', 'corrected')").withColumn("hop", F.row_number().over(w)).where("hop <= 100")
    ok = F.min((F.col("value") % 6 != 5).cast("int")).over(Window.partitionBy("entity", "predicate").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("ok", ok).where("ok = 1").select("entity", "predicate", F.col("hop").cast("long").alias("hop"), "seq", "value")


@query("j22_dependents", f"WITH {KLOG} SELECT p.seq AS support, count(*) AS dependents, min(x.seq) AS first_dependent FROM klog p JOIN klog x ON x.entity=p.entity AND x.value=p.value AND x.type='derived' WHERE p.type='asserted' GROUP BY p.seq")
def j22(spark, d):
    """What rests directly on each fact."""
    log = klog(spark, d)
    on = log.where("type = 'derived'").groupBy("entity", "value").agg(F.count(F.lit(1)).alias("dependents"), F.min("seq").alias("first_dependent"))
    return log.where("type = 'asserted'").select(F.col("seq").alias("support"), "entity", "value").join(on, ["entity", "value"]).select("support", "dependents", "first_dependent")


@query("a1_reinforcement", f"WITH {KLOG} SELECT entity, round(greatest(0, least(1, (CASE entity % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.6 ELSE 0.5 END) + 0.05*least(count(*) FILTER (type='confirmed'),5) - 0.10*count(*) FILTER (type='contradicted'))),6)::DOUBLE AS confidence FROM klog GROUP BY entity")
def a1(spark, d):
    """A1: confidence by the base of its source, plus confirmations (at most five), less contradictions."""
    g = klog(spark, d).groupBy("entity").agg(count_of("confirmed").alias("c"), count_of("contradicted").alias("x"))
    base = F.element_at(F.array(F.lit(0.8), F.lit(0.6), F.lit(0.5)), (F.col("entity") % 3 + 1).cast("int"))
    return g.select("entity", F.round(raw_confidence(base, F.col("c"), F.col("x")), 6).alias("confidence"))


@query("a5_calibration_counters", f"WITH {KLOG} SELECT entity % 3 AS source, CAST(floor(least(0.999, greatest(0, value/100.0))*10)/10 AS DECIMAL(3,1))::VARCHAR AS bucket, count(*) AS n, count(*) FILTER (type='confirmed') AS correct FROM klog WHERE type IN ('confirmed','contradicted') GROUP BY ALL")
def a5(spark, d):
    """A4/A5: counters of tries and hits by source and bucket of score."""
    bucket = F.format_number(F.floor(F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("value") / 100.0)) * 10) / 10, 1)
    rows = klog(spark, d).where("type IN ('confirmed', 'contradicted')")
    return rows.groupBy((F.col("entity") % 3).alias("source"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), count_of("confirmed").alias("correct"))


@query("a11_bad_derivation_rate", f"WITH {KLOG} SELECT round(1 - (count(*) FILTER (type='confirmed'))/count(*)::DOUBLE,6) AS rate FROM klog WHERE type IN ('confirmed','contradicted')")
def a11(spark, d):
    """One less the share of derivations that were confirmed."""
    return klog(spark, d).where("type IN ('confirmed', 'contradicted')").agg(F.round(1 - F.try_divide(count_of("confirmed"), F.count(F.lit(1))), 6).alias("rate"))


@query("a14_active_unjustified", f"WITH {KLOG}, {_state_sql()} SELECT count(*) AS n FROM state s WHERE status='active' AND NOT EXISTS (SELECT 1 FROM klog k WHERE k.type IN ('confirmed','verified') AND k.entity=s.entity AND k.predicate=s.predicate)")
def a14(spark, d):
    """Active beliefs that nothing justifies."""
    log = klog(spark, d)
    why = log.where("type IN ('confirmed', 'verified')").select("entity", "predicate")
    return rebuild(log).where("status = 'active'").join(why, ["entity", "predicate"], "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("a24_rule_disable", f"WITH {KLOG} SELECT predicate AS rule, count(*) AS n, round((count(*) FILTER (type='confirmed'))/count(*)::DOUBLE,6) AS precision, count(*) >= 10 AND (count(*) FILTER (type='confirmed'))/count(*)::DOUBLE < 0.6 AS disabled FROM klog WHERE type IN ('confirmed','contradicted') GROUP BY predicate")
def a24(spark, d):
    """Rules that were tried ten times and are right less than six times in ten are disabled."""
    g = klog(spark, d).where("type IN ('confirmed', 'contradicted')").groupBy(F.col("predicate").alias("rule")).agg(F.count(F.lit(1)).alias("n"), count_of("confirmed").alias("c"))
    p = F.try_divide(F.col("c"), F.col("n"))
    return g.select("rule", "n", F.round(p, 6).alias("precision"), ((F.col("n") >= 10) & (p < 0.6)).alias("disabled"))


@query("a27_profile_map", f"""WITH {KLOG}, f AS (SELECT entity, CASE WHEN predicate < 2 THEN 'static' ELSE 'dynamic' END AS part, predicate, arg_max(value, (ts, seq)) AS v FROM klog WHERE type IN ('asserted','corrected') GROUP BY ALL)
  SELECT entity, part, string_agg(predicate || '=' || v, ';' ORDER BY predicate) AS profile FROM f GROUP BY ALL""")
def a27(spark, d):
    """An owner's profile: the latest value of each attribute, static and dynamic apart."""
    g = klog(spark, d).where("type IN ('asserted', 'corrected')").groupBy("entity", F.when(F.col("predicate") < 2, "static").otherwise("dynamic").alias("part"), "predicate").agg(last_of("asserted corrected", "value").alias("v"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("predicate", "v"))), lambda x: F.concat_ws("=", x["predicate"], x["v"]))  # five attributes at most
    return g.groupBy("entity", "part").agg(F.array_join(items, ";").alias("profile"))


@query("u4_two_active", f"""WITH {KLOG}, {_state_sql()}, c AS (SELECT seq, entity, predicate AS a, value % 5 AS b FROM klog WHERE type='contradicted')
  SELECT c.seq, CASE WHEN EXISTS (SELECT 1 FROM state s WHERE s.status='active' AND s.entity=c.entity AND s.predicate=c.a) AND EXISTS (SELECT 1 FROM state s WHERE s.status='active' AND s.entity=c.entity+1 AND s.predicate=c.b) THEN 'open' ELSE 'closed' END AS status FROM c""")
def u4(spark, d):
    """A contradiction stays open while both its sides are active."""
    log = klog(spark, d)
    on = rebuild(log).where("status = 'active'").select("entity", "predicate")
    c = log.where("type = 'contradicted'").select("seq", "entity", F.col("predicate").alias("a"), (F.col("value") % 5).alias("b"), (F.col("entity") + 1).alias("other"))
    both = c.join(on.select("entity", F.col("predicate").alias("a"), F.lit(True).alias("x")), ["entity", "a"], "left").join(on.select(F.col("entity").alias("other"), F.col("predicate").alias("b"), F.lit(True).alias("y")), ["other", "b"], "left")
    return both.select("seq", F.when(F.col("x") & F.col("y"), "open").otherwise("closed").alias("status"))


@query("t23_contradictions", f"""WITH {KLOG}, {_state_sql()} SELECT a.entity, a.predicate AS p, b.predicate AS q FROM state a JOIN state b ON a.entity=b.entity AND a.predicate < b.predicate AND a.value=b.value WHERE a.status='active' AND b.status='active' AND a.value % 6 <> 5 ORDER BY a.entity, p, q LIMIT 50""")
def t23(spark, d):
    """Open contradictions of which both sides can be read, at most 50."""
    s = rebuild(klog(spark, d)).where("status = 'active' AND value % 6 <> 5").select("entity", "predicate", "value")
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.predicate") < F.col("b.predicate")))
    return j.select("a.entity", F.col("a.predicate").alias("p"), F.col("b.predicate").alias("q")).orderBy("entity", "p", "q").limit(50)


@query("f56_confidence_summary", f"WITH {KLOG}, {_state_sql()} SELECT entity, predicate, round(confidence,3)::VARCHAR || ' from ' || supports || ' sources, confirmed ' || confirms || ', contradicted ' || contradictions AS summary, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS trust FROM state")
def f56(spark, d):
    """what a belief's confidence rests on, in words."""
    s = rebuild(klog(spark, d))
    text = F.format_string("%s from %d sources, confirmed %d, contradicted %d", F.round("confidence", 3).cast("string"), "supports", "confirms", "contradictions")
    return s.select("entity", "predicate", text.alias("summary"), F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low").alias("trust"))


@query("t18_metacognitive_gate", f"WITH {KLOG}, {_state_sql()} SELECT entity, count(*) AS facts, CASE WHEN count(*) FILTER (status='active') = 0 THEN 'no_support' WHEN max(confidence) < 0.5 THEN 'weak_lead' WHEN arg_max(status, (confidence, -predicate)) <> 'active' THEN 'draft_lead' ELSE 'proceed' END AS gate FROM state GROUP BY entity")
def t18(spark, d):
    """Verify before acting where nothing supports, the lead is weak, or the lead isn't active."""
    g = rebuild(klog(spark, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("status") == "active").alias("live"), F.max("confidence").alias("best"), F.max_by("status", F.struct("confidence", -F.col("predicate"))).alias("lead"))
    return g.select("entity", "facts", F.when(F.col("live") == 0, "no_support").when(F.col("best") < 0.5, "weak_lead").when(F.col("lead") != "active", "draft_lead").otherwise("proceed").alias("gate"))


@query("t19_epistemic", f"""WITH {KLOG}, {_state_sql()}, told AS (SELECT DISTINCT entity, value FROM klog WHERE type='informed') SELECT s.entity, s.predicate, CASE WHEN t.entity IS NOT NULL THEN 'likely_forgotten' WHEN s.confidence >= 0.6 THEN 'never_told' END AS note FROM state s LEFT JOIN told t ON t.entity=s.entity AND t.value=s.value""")
def t19(spark, d):
    """What was told and may be forgotten, and what matters and was never told."""
    log = klog(spark, d)
    told = log.where("type = 'informed'").select("entity", "value", F.lit(True).alias("told")).distinct()
    j = rebuild(log).join(told, ["entity", "value"], "left")
    return j.select("entity", "predicate", F.when(F.col("told"), "likely_forgotten").when(F.col("confidence") >= 0.6, "never_told").alias("note"))


@query("l12_unlearn", f"""WITH {KLOG}, {_state_sql()}, gone AS (SELECT DISTINCT entity, value FROM klog WHERE type='retracted') SELECT s.entity, s.predicate, s.value FROM state s WHERE status='active' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.entity=s.entity AND g.value=s.value)""")
def l12(spark, d):
    """Unlearning is a tombstone of the content and a retraction; neither the belief nor equal content stays."""
    log = klog(spark, d)
    gone = log.where("type = 'retracted'").select("entity", "value")
    return rebuild(log).where("status = 'active'").join(gone, ["entity", "value"], "left_anti").select("entity", "predicate", "value")


@query("j18_merge_family", f"""WITH RECURSIVE {MERGES}, w AS (SELECT node, nxt AS root FROM l UNION ALL SELECT w.node, l.nxt FROM w JOIN l ON l.node=w.root), e AS (SELECT node, min(root) AS root FROM w GROUP BY node)
  SELECT root, count(*) AS members, min(node) AS first_member, max(node) AS last_member FROM e GROUP BY root""")
def j18(spark, d):
    """The family of a survivor: all entities that merges lead to it, at any depth."""
    return roots(merges(klog(spark, d))).groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first_member"), F.max("node").alias("last_member"))


def bucket_of(score: Column) -> Column:
    """A4: the tenth a score falls in, as text; scores are held between 0 and 0.999."""
    return F.format_string("%.1f", F.floor(F.least(F.lit(0.999), F.greatest(F.lit(0.0), score)) * 10) / 10)


@query("a4_buckets", "SELECT event_id, printf('%.1f', floor(least(0.999, greatest(0.0, value/50.0 - 0.2))*10)/10) AS bucket FROM events WHERE value IS NOT NULL")
def a4(spark, d):
    """A4: the bucket of every score, also of those below 0 and above 1."""
    return load(spark, d, "events").where("value IS NOT NULL").select("event_id", bucket_of(F.col("value") / 50.0 - 0.2).alias("bucket"))


@query("f27_row_ids", f"""WITH {KLOG}, {_state_sql()} SELECT entity, predicate, 'fact_' || substr(sha256(entity || '|' || predicate || '|' || substr(sha256('verification=' || coalesce(verification::VARCHAR, '')), 1, 16)), 1, 24) AS id FROM state""")
def f27(spark, d):
    """a projected row's id: a prefix and the hash of its natural key, in which qualifiers stand as 16 places of their own hash."""
    s = rebuild(klog(spark, d))
    qualifiers = F.substring(F.sha2(F.concat(F.lit("verification="), F.coalesce(F.col("verification").cast("string"), F.lit(""))), 256), 1, 16)
    key = F.concat_ws("|", F.col("entity").cast("string"), F.col("predicate").cast("string"), qualifiers)
    return s.select("entity", "predicate", F.concat(F.lit("fact_"), F.substring(F.sha2(key, 256), 1, 24)).alias("id"))


@query("t24_directives", f"""WITH {KLOG}, {_state_sql()}, l AS (SELECT entity AS owner, value % 7 AS principal, arg_max(type, (ts, seq)) AS last FROM klog WHERE type IN ('grant','revoke') GROUP BY ALL)
  SELECT s.entity, s.value FROM state s WHERE s.predicate = 4 AND s.status = 'active' AND (s.entity % 7 = 1 OR EXISTS (SELECT 1 FROM l WHERE l.owner = s.entity AND l.principal = 1 AND l.last = 'grant')) ORDER BY s.entity LIMIT 50""")
def t24(spark, d):
    """The first 50 standing notes (predicate 4) that are active and that principal 1 owns or was granted."""
    log = klog(spark, d)
    lists = log.where("type IN ('grant', 'revoke') AND value % 7 = 1").groupBy("entity").agg((last_of("grant revoke", "type") == "grant").alias("granted"))
    notes = rebuild(log.where("predicate = 4")).where("status = 'active'").join(lists, "entity", "left")
    return notes.where((F.col("entity") % 7 == 1) | F.coalesce("granted", F.lit(False))).select("entity", "value").orderBy("entity").limit(50)


@query("w1_rank_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value) DESC NULLS LAST, event_id) AS rank FROM events QUALIFY rank <= 20")
def w1(spark, d):
    """The one rule for ties in ranked lists: score descending, then id; the 20 best of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last(F.round("value")), "event_id")
    return load(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 20")
