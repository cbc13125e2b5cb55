"""Lifecycle: the queue, leases, retention, sessions, schedules, compaction, policies, vectors' upkeep.

Jobs are derived from ``events`` (``jobs``), sessions are the conversations of ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import LEVEL_SQL, NORM_SQL, SCORE_SQL, criticality, excerpts, keep, standing_instruction
from ..plans.registry import load, query

NOW = "2024-01-20 00:00:00"
JOBS = """jobs AS (SELECT event_id AS job, event_type AS task, user_id AS payload, CASE k % 5 WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'pending' END AS status, ts + INTERVAL 1 DAY * (k % 3) AS run_after, CASE WHEN k % 7 = 0 THEN event_id - 1 END AS depends_on, k % 25 AS attempts, ts AS updated
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))"""


def jobs(spark, d) -> DataFrame:
    """``job, task, payload, status, run_after, depends_on, attempts, updated``."""
    k = F.col("k")
    e = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    status = F.when(k % 5 == 1, "running").when(k % 5 == 2, "done").when(k % 5 == 3, "failed").otherwise("pending")
    return e.select(
        F.col("event_id").alias("job"), F.col("event_type").alias("task"), F.col("user_id").alias("payload"), status.alias("status"), (F.col("ts") + F.make_dt_interval(k.cast("int") % 3)).alias("run_after"),
        F.when(k % 7 == 0, F.col("event_id") - 1).alias("depends_on"), (k % 25).alias("attempts"), F.col("ts").alias("updated"),
    )


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


READY_SQL = f"""ready AS (SELECT j.* FROM jobs j LEFT JOIN jobs p ON p.job = j.depends_on WHERE j.status = 'pending' AND j.run_after <= TIMESTAMP '{NOW}' AND (j.depends_on IS NULL OR p.status = 'done'))"""


def ready(all_: DataFrame) -> DataFrame:
    """Pending jobs that are due and whose dependency is done."""
    done = all_.where("status = 'done'").select(F.col("job").alias("depends_on"), F.lit(True).alias("met"))
    due = all_.where((F.col("status") == "pending") & (F.col("run_after") <= now()))
    return due.join(done, "depends_on", "left").where("depends_on IS NULL OR met").drop("met")


@query("l4_claim", f"WITH {JOBS}, {READY_SQL} SELECT task, min(job) AS job, count(*) AS waiting FROM ready GROUP BY task")
def l4(spark, d):
    """L4: the job that each class of tasks claims next: the lowest id that is ready."""
    return ready(jobs(spark, d)).groupBy("task").agg(F.min("job").alias("job"), F.count(F.lit(1)).alias("waiting"))


@query("l6_fair_drain", f"WITH {JOBS}, {READY_SQL}, r AS (SELECT job, task, row_number() OVER (PARTITION BY task ORDER BY job) AS turn FROM ready) SELECT job, task, turn FROM r ORDER BY turn, task LIMIT 60")
def l6(spark, d):
    """Jobs drained in turns: each class gives one a turn, and what a class leaves goes to the others."""
    r = ready(jobs(spark, d)).withColumn("turn", F.row_number().over(Window.partitionBy("task").orderBy("job")).cast("long")).where("turn <= 60")
    return r.select("job", "task", "turn").orderBy("turn", "task").limit(60)


@query("l7_lease_reclaim", f"WITH {JOBS} SELECT job, CASE WHEN attempts >= 20 THEN 'failed' ELSE 'pending' END AS status, attempts + 1 AS attempts FROM jobs WHERE status = 'running' AND updated < TIMESTAMP '{NOW}' - INTERVAL 900 SECOND ORDER BY job LIMIT 200")
def l7(spark, d):
    """Leases that ran out go back to pending, or fail after twenty tries; at most 200 a run."""
    old = jobs(spark, d).where((F.col("status") == "running") & (F.col("updated") < now() - F.expr("INTERVAL 900 SECONDS")))
    return old.select("job", F.when(F.col("attempts") >= 20, "failed").otherwise("pending").alias("status"), (F.col("attempts") + 1).alias("attempts")).orderBy("job").limit(200)


@query("l8_retention", f"""WITH {JOBS}, o AS (SELECT job FROM jobs WHERE status IN ('done','failed') AND updated < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND job NOT IN (SELECT job FROM jobs WHERE status IN ('done','failed') ORDER BY job DESC LIMIT 50)) SELECT job FROM o WHERE job NOT IN (SELECT depends_on FROM jobs WHERE depends_on IS NOT NULL AND status = 'pending')""")
def l8(spark, d):
    """Finished jobs older than seven days go, but for the newest 50 and those that pending ones wait for."""
    all_ = jobs(spark, d)
    finished = all_.where("status IN ('done', 'failed')").select("job", "updated")
    newest = F.broadcast(finished.select("job").orderBy(F.desc("job")).limit(50))
    used = all_.where("status = 'pending' AND depends_on IS NOT NULL").select(F.col("depends_on").alias("job"))
    return finished.where(F.col("updated") < now() - F.expr("INTERVAL 7 DAYS")).select("job").join(newest, "job", "left_anti").join(used, "job", "left_anti")


@query("l2_distinct_page", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events WHERE user_id > 3 ORDER BY user_id LIMIT 5)")
def l2(spark, d):
    """L2: a page of whole groups: the next five values, with all their rows."""
    e = load(spark, d, "events").select("event_id", "user_id")
    page = e.where("user_id > 3").select("user_id").distinct().orderBy("user_id").limit(5)
    return e.join(F.broadcast(page), "user_id", "left_semi").select("event_id", "user_id")


@query("l3_commit", f"WITH {JOBS} SELECT task, max(job) FILTER (status = 'done') AS cursor, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY task")
def l3(spark, d):
    """L3: what a commit stores of a sweep: its cursor and its report."""
    by = lambda s: F.count_if(F.col("status") == s)
    return jobs(spark, d).groupBy("task").agg(F.max(F.when(F.col("status") == "done", F.col("job"))).alias("cursor"), by("done").alias("done"), by("failed").alias("failed"))


@query("l15_embed_jobs", f"WITH {JOBS}, v AS (SELECT vec_id, label % 3 AS tag, len(embedding) AS width FROM embeddings) SELECT job, CASE WHEN v.tag = 0 AND v.width = 64 THEN 'skip' WHEN attempts >= 20 THEN 'give_up' WHEN v.vec_id IS NULL THEN 'defer' ELSE 'embed' END AS action, CASE WHEN v.vec_id IS NULL AND attempts < 20 THEN least(3600, 30 * (attempts + 1)) END AS backoff FROM jobs LEFT JOIN v ON v.vec_id = job WHERE status = 'pending'")
def l15(spark, d):
    """What a deferred embedding does: nothing if the vector is current, else embed, wait longer each time, or give up."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("job"), (F.col("label") % 3).alias("tag"), F.size("embedding").alias("width"))
    j = jobs(spark, d).where("status = 'pending'").join(v, "job", "left")
    action = F.when((F.col("tag") == 0) & (F.col("width") == 64), "skip").when(F.col("attempts") >= 20, "give_up").when(F.col("tag").isNull(), "defer").otherwise("embed")
    return j.select("job", action.alias("action"), F.when(F.col("tag").isNull() & (F.col("attempts") < 20), F.least(F.lit(3600), 30 * (F.col("attempts") + 1))).alias("backoff"))


@query("l10_finalise", "SELECT c.conv_id, count(*) AS queued, min(c.turn) AS first_turn FROM conversations c JOIN (SELECT conv_id, max(turn) // 2 AS mark FROM conversations GROUP BY 1) m USING (conv_id) WHERE c.turn > m.mark AND c.role <> 'system' GROUP BY c.conv_id")
def l10(spark, d):
    """When a session ends, its turns past the last extracted one are queued."""
    c = load(spark, d, "conversations")
    mark = c.groupBy("conv_id").agg(F.expr("max(turn) div 2").alias("mark"))
    return c.join(mark, "conv_id").where("turn > mark AND role <> 'system'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("queued"), F.min("turn").alias("first_turn"))


EPISODES = "ep AS (SELECT conv_id, turn, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM conversations)"


def episodes(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "conversations").select("conv_id", "turn", "text", F.sum((F.col("role") == "user").cast("int")).over(w).alias("episode"))


@query("w13_slices", f"WITH {EPISODES} SELECT conv_id, episode, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM ep GROUP BY ALL")
def w13(spark, d):
    """Consecutive runs between boundaries."""
    return episodes(spark, d).groupBy("conv_id", "episode").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


@query("l13_summaries", f"WITH {EPISODES}, l AS (SELECT conv_id, episode, string_agg(substr(split_part(text, chr(10), 1), 1, 60), ' / ' ORDER BY turn) AS line FROM ep GROUP BY ALL) SELECT conv_id, string_agg(substr(line, 1, 120), chr(10) ORDER BY episode) AS summary FROM l WHERE episode <= 8 GROUP BY conv_id")
def l13(spark, d):
    """A session's summary: one capped line for each of its first eight episodes."""
    line = lambda order, text: F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("x")))), lambda s: s["x"])
    head = F.substring(F.substring_index("text", "\n", 1), 1, 60)
    per = episodes(spark, d).where("episode <= 8").groupBy("conv_id", "episode").agg(F.array_join(line("turn", head), " / ").alias("line"))
    return per.groupBy("conv_id").agg(F.array_join(line("episode", F.substring("line", 1, 120)), "\n").alias("summary"))


@query("l17_backfill", "SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY conv_id")
def l17(spark, d):
    """Ended sessions that have no row in the index."""
    done = load(spark, d, "labels").select(F.col("doc_id").alias("conv_id"))
    return load(spark, d, "conversations").join(done, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


CRONS = {"weekly": "30 6 * * 1", "either": "0 */6 1,15 * 3", "monthly": "15 9 13 2-11 *"}


def cron_field(text: str, lo: int, hi: int) -> list[int]:
    """F32: the values of one field: stars, lists, ranges and steps."""
    out = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, b = (lo, hi) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span or not step else hi)
        out |= set(range(a, b + 1, int(step or 1)))
    return sorted(x for x in out if lo <= x <= hi)


def cron_prev(spec: str, at: Column, days: int = 400) -> Column:
    """F32: the last time at or before ``at`` (UTC) that a five-field schedule fires; null if none within ``days``.

    If both day fields are restricted either may match.
    """
    fields = spec.split()
    minutes, hours, doms, months, dows = (cron_field(f, *r) for f, r in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))))
    dows = sorted({x % 7 for x in dows})
    times = sorted((h * 60 + m for h in hours for m in minutes), reverse=True)

    def matches(day):
        dom, dow = F.dayofmonth(day).isin(doms), (F.dayofweek(day) - 1).isin(dows)
        either = (dom | dow) if fields[2] != "*" and fields[4] != "*" else (dom & dow)
        return F.month(day).isin(months) & either

    today = at.cast("date")
    minute = F.hour(at) * 60 + F.minute(at)
    last = F.lit(times[0])
    upto = F.get(F.filter(F.array(*map(F.lit, times)), lambda t: t <= minute), F.lit(0))
    day = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda n: F.date_sub(today, n)), matches), F.lit(0))
    fire = lambda d, m: d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))
    return F.when(matches(today) & upto.isNotNull(), fire(today, upto)).otherwise(fire(day, last))


_CAL = "cal AS (SELECT day, day + INTERVAL 1 MINUTE * m AS fire, m FROM (SELECT unnest(generate_series(DATE '1990-12-01', DATE '2003-01-31', INTERVAL 1 DAY)) AS day), (SELECT unnest(range(0, 1440, 15)) AS m))"
_CRON_SQL = {
    "weekly": "m = 390 AND dayofweek(day) = 1",
    "either": "m % 360 = 0 AND (day(day) IN (1, 15) OR dayofweek(day) = 3)",
    "monthly": "m = 555 AND day(day) = 13 AND month(day) BETWEEN 2 AND 11",
}


@query("f32_cron_prev", f"WITH {_CAL}, f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, fire FROM cal WHERE {w}" for k, w in _CRON_SQL.items()) + "), o AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS at, n.name FROM orders, (SELECT DISTINCT name FROM f) n) SELECT o.o_orderkey, o.name, f.fire FROM o ASOF JOIN f ON o.name = f.name AND o.at >= f.fire")
def f32(spark, d):
    """F32: when three schedules fired last before each order; the SQL looks them up in a calendar."""
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    fires = F.array(*(F.struct(F.lit(k).alias("name"), cron_prev(s, F.col("at")).alias("fire")) for k, s in CRONS.items()))
    return load(spark, d, "orders").select("o_orderkey", at.alias("at")).select("o_orderkey", F.explode(fires).alias("f")).select("o_orderkey", "f.name", "f.fire")


@query("l18_due", f"WITH {_CAL}, f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, fire FROM cal WHERE {w}" for k, w in _CRON_SQL.items()) + "), r AS (SELECT o_custkey, max(o_orderdate) AS last_run FROM orders GROUP BY 1), x AS (SELECT r.o_custkey, f.name, max(f.fire) AS fire FROM r, f WHERE f.fire <= TIMESTAMP '2002-01-15 12:00:00' AND f.fire > r.last_run GROUP BY ALL) SELECT o_custkey, arg_min(name, (fire, name)) AS due FROM x GROUP BY 1")
def l18(spark, d):
    """Of the schedules of an owner that fired since its last run, the one to run now: at most one a call."""
    r = load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_run"))
    fires = F.array(*(F.struct(cron_prev(s, F.lit("2002-01-15 12:00:00").cast("timestamp_ntz")).alias("fire"), F.lit(k).alias("name")) for k, s in CRONS.items()))
    x = r.withColumn("due", F.array_min(F.filter(fires, lambda f: f["fire"] > F.col("last_run"))))
    return x.where("due IS NOT NULL").select("o_custkey", F.col("due.name").alias("due"))


BUDGET, HEAD, TAIL = 1500, 1, 2


def compact(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, fate``: head and tail are protected, critical turns and norms are never evicted, the rest is kept by
    worth while the budget of characters lasts, and folded beyond it.  One session is one window partition."""
    w = Window.partitionBy("conv_id")
    c = turns.withColumn("i", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("last", F.max("turn").over(w))
    never = (criticality(F.col("text"))["level"] != "normal") | standing_instruction(F.col("text"))
    c = c.select("conv_id", "turn", F.length("text").alias("cost"), keep(F.col("text"), (F.col("turn") + 1) / (F.col("last") + 1)).alias("score"), ((F.col("i") <= HEAD) | (F.col("i") > F.col("n") - TAIL)).alias("ends"), never.alias("never"))
    free = ~F.col("ends") & ~F.col("never")
    used = F.sum(F.when(free, F.col("cost")).otherwise(0)).over(w.orderBy(F.desc("score"), "turn").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("used", used).select("conv_id", "turn", F.when(F.col("ends"), "protected").when(F.col("never"), "never_evict").when(F.col("used") <= BUDGET, "kept").otherwise("folded").alias("fate"))


FATE_SQL = f"""t AS (SELECT conv_id, turn, text, length(text) AS cost, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  s AS (SELECT conv_id, turn, text, cost, {SCORE_SQL}::DOUBLE AS score, i <= {HEAD} OR i > n - {TAIL} AS ends, {LEVEL_SQL} <> 'normal' OR {NORM_SQL} AS never FROM t),
  u AS (SELECT *, sum(CASE WHEN ends OR never THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY score DESC, turn ROWS UNBOUNDED PRECEDING) AS used FROM s),
  fate AS (SELECT conv_id, turn, text, CASE WHEN ends THEN 'protected' WHEN never THEN 'never_evict' WHEN used <= {BUDGET} THEN 'kept' ELSE 'folded' END AS fate FROM u)"""


@query("l19_compaction", f"WITH {FATE_SQL} SELECT conv_id, turn, fate FROM fate")
def l19(spark, d):
    """What becomes of each turn when a session is compacted."""
    return compact(load(spark, d, "conversations"))


@query("l19_handoff", f"WITH {FATE_SQL} SELECT conv_id, count(*) FILTER (fate = 'folded') AS folded, 'fold_' || substr(sha256(coalesce(string_agg(sha256(text), '' ORDER BY turn) FILTER (fate = 'folded'), '')), 1, 12) AS fold_id, sum(length(text)) FILTER (fate <> 'folded')::BIGINT AS left_chars FROM fate GROUP BY conv_id")
def l19h(spark, d):
    """The audit row of a compaction: how much was folded, under which digest, and what is left."""
    c = load(spark, d, "conversations")
    j = compact(c).join(c.select("conv_id", "turn", F.length("text").alias("n"), F.sha2("text", 256).alias("h")), ["conv_id", "turn"])
    gone = F.col("fate") == "folded"
    hashes = F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct("turn", "h")))), lambda x: x["h"])  # hashes, never texts
    g = j.groupBy("conv_id").agg(F.count_if(gone).alias("folded"), F.array_join(hashes, "").alias("hs"), F.sum(F.when(~gone, F.col("n"))).alias("left_chars"))
    return g.select("conv_id", "folded", F.concat(F.lit("fold_"), F.substring(F.sha2("hs", 256), 1, 12)).alias("fold_id"), "left_chars")


@query("l21_durable", "SELECT conv_id, turn, sha256(text) AS h, true AS whole FROM conversations")
def l21(spark, d):
    """Every turn stored in chunks with span ids of their own; joined in order they are the turn."""
    c = load(spark, d, "conversations")
    spans = c.select("conv_id", "turn", F.posexplode(excerpts(F.col("text"), 200)).alias("i", "chunk"))
    spans = spans.withColumn("span_id", F.substring(F.sha2(F.concat_ws("-", "conv_id", "turn", "i"), 256), 1, 16))
    whole = spans.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk"))), lambda x: x["chunk"]), "").alias("t"), (F.count_distinct("span_id") == F.count(F.lit(1))).alias("whole"))  # chunks of one turn
    return whole.select("conv_id", "turn", F.sha2("t", 256).alias("h"), "whole")


@query("l25_policy", """WITH w AS (SELECT event_type, round(avg(value) FILTER (event_id % 2 = 0)/200,6) AS champion, round(avg(value) FILTER (event_id % 2 = 1)/200,6) AS challenger FROM events GROUP BY 1), n AS (SELECT *, round(champion + greatest(-0.15, least(0.15, challenger - champion)),6) AS next FROM w), t AS (SELECT sum(next) > sum(champion) AS beats FROM (SELECT * FROM n ORDER BY abs(challenger - champion) DESC, event_type LIMIT 8))
  SELECT event_type, champion, next, CASE WHEN beats THEN next ELSE champion END AS active FROM (SELECT * FROM n ORDER BY abs(challenger - champion) DESC, event_type LIMIT 8), t""")
def l25(spark, d):
    """A challenger's weights move by at most 0.15 each and eight at a time, and take over only if they beat the champion's."""
    half = lambda r: F.round(F.avg(F.when(F.col("event_id") % 2 == r, F.col("value"))) / 200, 6)
    w = load(spark, d, "events").groupBy("event_type").agg(half(0).alias("champion"), half(1).alias("challenger"))
    delta = F.col("challenger") - F.col("champion")
    n = w.withColumn("next", F.round(F.col("champion") + F.greatest(F.lit(-0.15), F.least(F.lit(0.15), delta)), 6)).orderBy(F.desc(F.abs(delta)), "event_type").limit(8)
    beats = n.agg((F.sum("next") > F.sum("champion")).alias("beats"))  # one row
    return n.join(F.broadcast(beats)).select("event_type", "champion", "next", F.when(F.col("beats"), F.col("next")).otherwise(F.col("champion")).alias("active"))


# vectors' upkeep

TAGGED = "tagged AS (SELECT vec_id, CASE label % 4 WHEN 0 THEN 'Hash-Embed@2' WHEN 1 THEN 'hash_embed@2' WHEN 2 THEN 'hash_embed@1' ELSE 'other/Model v3' END AS tag, len(embedding) AS width, embedding FROM embeddings)"
CANON_SQL = "regexp_replace(regexp_replace(lower(split_part(tag, '@', 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def tagged(spark, d) -> DataFrame:
    tag = F.when(F.col("label") % 4 == 0, "Hash-Embed@2").when(F.col("label") % 4 == 1, "hash_embed@2").when(F.col("label") % 4 == 2, "hash_embed@1").otherwise("other/Model v3")
    return load(spark, d, "embeddings").select("vec_id", tag.alias("tag"), F.size("embedding").alias("width"), "embedding")


def model_id(tag: Column) -> Column:
    """V8: the model's stable name: lowered, other characters to one underscore, without its version."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(tag, "@", 1)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


@query("v8_model_ids", f"WITH {TAGGED} SELECT tag, {CANON_SQL} AS model, nullif(split_part(tag, '@', 2), '') AS version, count(*) AS n FROM tagged GROUP BY ALL")
def v8(spark, d):
    """V8: tags of models under one stable name, with their version."""
    g = tagged(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return g.select("tag", model_id(F.col("tag")).alias("model"), F.when(F.instr("tag", "@") > 0, F.substring_index("tag", "@", -1)).alias("version"), "n")


@query("a12_census", f"WITH {TAGGED} SELECT tag, width::BIGINT AS width, count(*) AS n FROM tagged GROUP BY ALL")
def a12(spark, d):
    """Vectors by model and width."""
    return tagged(spark, d).groupBy("tag", F.col("width").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("a13_mismatches", f"WITH {TAGGED} SELECT tag, width::BIGINT AS width, count(*) AS n FROM tagged WHERE NOT (tag = 'hash_embed@2' AND width = 64) GROUP BY ALL")
def a13(spark, d):
    """Groups that are not of the active model and width."""
    return tagged(spark, d).where("NOT (tag = 'hash_embed@2' AND width = 64)").groupBy("tag", F.col("width").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n"))


ACTION_SQL = f"CASE WHEN width <> 64 THEN 'reembed' WHEN tag = 'hash_embed@2' THEN 'ok' WHEN {CANON_SQL} = 'hash_embed' AND (split_part(tag, '@', 2) = '2') THEN 'retag' ELSE 'reembed' END"


def vector_action(tag: Column, width: Column) -> Column:
    """What a vector's tag and width call for: nothing, a new tag (the model is the same by its id), or a new vector."""
    same = (model_id(tag) == "hash_embed") & (F.substring_index(tag, "@", -1) == "2")
    return F.when(width != 64, "reembed").when(tag == "hash_embed@2", "ok").when(same, "retag").otherwise("reembed")


@query("v22_tag_classes", f"WITH {TAGGED} SELECT vec_id, {ACTION_SQL} AS action FROM tagged")
def v22(spark, d):
    """The class of every vector."""
    return tagged(spark, d).select("vec_id", vector_action(F.col("tag"), F.col("width")).alias("action"))


@query("v21_heal", f"WITH {TAGGED} SELECT vec_id, {ACTION_SQL} AS action FROM tagged WHERE {ACTION_SQL} <> 'ok' ORDER BY vec_id LIMIT 500")
def v21(spark, d):
    """A bounded run of repairs, the lowest ids first."""
    a = tagged(spark, d).select("vec_id", vector_action(F.col("tag"), F.col("width")).alias("action"))
    return a.where("action <> 'ok'").orderBy("vec_id").limit(500)


@query("v7_wrong_width", f"WITH {TAGGED} SELECT count(*) FILTER (width <> 64) AS wrong, count(*) AS n FROM tagged")
def v7(spark, d):
    """V7: how many vectors can't be compared with the query's width."""
    return tagged(spark, d).agg(F.count_if(F.col("width") != 64).alias("wrong"), F.count(F.lit(1)).alias("n"))


# interaction patterns

PHRASES = {"correction": ["no that", "not what", "the and"], "thanks": ["thank you", "to the"], "request": ["can you", "could you", "in the"]}
MINE_SQL = " UNION ALL ".join(f"SELECT '{k}' AS category, conv_id, turn FROM t WHERE " + " OR ".join(f"contains(' ' || text || ' ', ' {p} ')" for p in v) for k, v in PHRASES.items())


@query("a22_pattern_mining", f"WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations WHERE role <> 'assistant'), h AS ({MINE_SQL}) SELECT category, count(*) AS support, count(DISTINCT conv_id) AS sessions, round(least(0.95, 0.50 + 0.08*count(*) + 0.03*count(DISTINCT conv_id)),6)::DOUBLE AS confidence FROM h GROUP BY category HAVING count(*) >= 2")
def a22(spark, d):
    """Whole phrases of each category in what people say; support by turn, confidence by support and sessions."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9']+", " "), r"\s+", " "))
    t = load(spark, d, "conversations").where("role <> 'assistant'").select("conv_id", F.concat(F.lit(" "), text, F.lit(" ")).alias("t"))
    hit = F.array(*(F.when(F.exists(F.array(*(F.lit(f" {p} ") for p in v)), lambda p: F.contains("t", p)), F.lit(k)) for k, v in PHRASES.items()))
    g = t.select("conv_id", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("support"), F.count_distinct("conv_id").alias("sessions")).where("support >= 2")
    return g.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.50 + 0.08 * F.col("support") + 0.03 * F.col("sessions")), 6))
