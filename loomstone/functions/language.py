"""Language rules over utterances: facts, speakers, criticality, literals, passages, dates, keys and cards.

Rules are tables of patterns that become one column expression each.  ``said`` derives utterances from
``customer`` and ``nation``, so that every rule has something to say at any size of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query
from .text import decimalize, phone_key, sentences, stem

SAY = """CASE c % 10 WHEN 0 THEN 'My name is Customer ' || c || '. I live in ' || n || '.' WHEN 1 THEN 'I work at Brand ' || c || '. Fine.'
  WHEN 2 THEN 'I am allergic to ' || seg || '. Is that a problem?' WHEN 3 THEN 'My brother is called Customer ' || c || '. Do you like ' || seg || '?'
  WHEN 4 THEN 'I take ' || c || ' mg of ' || seg || ' daily.' WHEN 5 THEN 'My dog is called Rex. I like ' || seg || '.'
  WHEN 6 THEN 'Never call me after 9 pm. See /etc/hosts and http://h.example/' || c || ' now.' WHEN 7 THEN 'If I lived in ' || n || ' I would like ' || seg || '.'
  WHEN 8 THEN 'I decided to wait. It took ' || c || ' days, --force and "some words".' ELSE 'My email is customer' || c || '@example.org and my phone is 1-555-010-' || (1000 + c % 9000) || '.' END"""
SAID = f"said AS (SELECT c, n, seg, {SAY} AS text FROM (SELECT c_custkey AS c, n_name AS n, lower(c_mktsegment) AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey))"


def said(spark, d) -> DataFrame:
    """``c, n, seg, text``: an utterance of every customer."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("n"))  # 25 rows
    rows = load(spark, d, "customer").join(F.broadcast(n), "c_nationkey").select(F.col("c_custkey").alias("c"), "n", F.lower("c_mktsegment").alias("seg"))
    return rows.withColumn("text", F.expr(SAY))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# facts

#: Predicate and pattern of its value in a sentence of the first person.
FACTS = {
    "name": r"\b[Mm]y name is ([A-Z]\w*(?: \w+)*)",
    "lives_in": r"\bI live in ([A-Z]\w*(?: \w+)*)",
    "works_at": r"\bI work at ([A-Z]\w*(?: \w+)*)",
    "allergy": r"\bI am allergic to ([a-z]+)",
    "sibling": r"\b[Mm]y (?:brother|sister) is called ([A-Z]\w*(?: \w+)*)",
    "pet": r"\b[Mm]y (?:dog|cat) is called ([A-Z]\w*)",
    "medication": r"\bI take (\d+ mg of [a-z]+)",
    "preference": r"\bI like ([a-z]+)",
    "email": r"\b[Mm]y email is ([\w.]+@[\w.]+\w)",
    "phone": r"\bmy phone is ([\d-]+\d)",
    "decision": r"\bI decided to (\w+)",
}
HYPOTHETICAL = r"\b(?:[Ii]f|would|might)\b"
MOST_FACTS = 8  # of a sentence


def sentence_facts(sentence: Column) -> Column:
    """``array<struct<predicate, value>>`` of every pattern that fires; a question or hypothesis asserts nothing."""
    found = F.array(*(F.struct(F.lit(p).alias("predicate"), F.regexp_extract(sentence, rx, 1).alias("value")) for p, rx in FACTS.items()))
    quiet = sentence.endswith("?") | sentence.rlike(HYPOTHETICAL)
    return F.when(quiet, F.array().cast("array<struct<predicate:string,value:string>>")).otherwise(F.slice(F.filter(found, lambda x: x["value"] != ""), 1, MOST_FACTS))


LINES = r"unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)))"
PATTERNS = "p(predicate, rx) AS (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in FACTS.items()) + ")"
FACT_SQL = f"{SAID}, s AS (SELECT c, {LINES} AS s FROM said), {PATTERNS}, facts AS (SELECT c, predicate, regexp_extract(s, rx, 1) AS value FROM s, p WHERE NOT ends_with(s, '?') AND NOT regexp_matches(s, {q(HYPOTHETICAL)}) AND regexp_extract(s, rx, 1) <> '')"


def facts_of(rows: DataFrame) -> DataFrame:
    """``c, predicate, value`` of all sentences of ``text``."""
    s = rows.select("c", F.explode(sentences(F.col("text"))).alias("s"))
    return s.select("c", F.explode(sentence_facts(F.col("s"))).alias("f")).select("c", "f.predicate", "f.value")


@query("f49_sentence_facts", f"WITH {FACT_SQL} SELECT c, predicate, value FROM facts")
def f49(spark, d):
    """facts that sentences assert, one row each."""
    return facts_of(said(spark, d))


@query("l16_extract_job", f"""WITH {FACT_SQL}, done AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'P'), human AS (SELECT c FROM said WHERE seg <> 'machinery')
  SELECT DISTINCT c, 'asserted' AS type, predicate, value, substr(sha256('1|' || c || '|' || predicate || '|' || value), 1, 16) AS event FROM facts WHERE c IN (SELECT c FROM human) AND c NOT IN (SELECT c FROM done)""")
def l16(spark, d):
    """Asserted events of texts without an extraction at this version and with a human speaker; an event's id is of its content, so a job run twice adds nothing."""
    done = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c"))
    f = facts_of(said(spark, d).where("seg <> 'machinery'").join(done, "c", "left_anti")).distinct()
    event = F.substring(F.sha2(F.concat_ws("|", F.lit("1"), F.col("c").cast("string"), "predicate", "value"), 256), 1, 16)
    return f.select("c", F.lit("asserted").alias("type"), "predicate", "value", event.alias("event"))


@query("f48_extract_facts", f"WITH {FACT_SQL} SELECT c, count(*) AS facts, string_agg(predicate || '=' || value, '; ' ORDER BY predicate) AS listed FROM facts GROUP BY c")
def f48(spark, d):
    """What an extractor returns for a text: its facts, gathered."""
    g = facts_of(said(spark, d)).groupBy("c").agg(F.count(F.lit(1)).alias("facts"), F.array_sort(F.collect_list(F.struct("predicate", "value"))).alias("l"))  # eight a sentence at most
    return g.select("c", "facts", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["predicate"], x["value"])), "; ").alias("listed"))


@query("t10_promoted", f"WITH {FACT_SQL} SELECT c, value, 0.6 AS confidence, 'read_and_answer' AS source FROM facts WHERE predicate IN ('works_at', 'decision')")
def t10(spark, d):
    """Facts read from a span become assertions of moderate confidence."""
    f = facts_of(said(spark, d)).where("predicate IN ('works_at', 'decision')")
    return f.select("c", "value", F.lit(0.6).alias("confidence"), F.lit("read_and_answer").alias("source"))


CANON = {"signup": ("joined", "single"), "purchase": ("bought", "multi"), "click": ("interacted", "multi")}


@query("f47_canonical_predicates", "SELECT event_type, user_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in CANON.items()) + " ELSE regexp_replace(lower(event_type), '[^a-z]+', '_', 'g') END AS predicate, CASE event_type WHEN 'signup' THEN 'single' ELSE 'multi' END AS cardinality, count(*) AS n FROM events GROUP BY ALL")
def f47(spark, d):
    """surface forms to canonical predicates with their cardinality; unknown ones are tidied."""
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in CANON.items() for x in (k, v[i])))[F.col("event_type")]
    g = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "user_id", F.coalesce(pick(0), F.regexp_replace(F.lower("event_type"), "[^a-z]+", "_")).alias("predicate"), F.coalesce(pick(1), F.lit("multi")).alias("cardinality"), "n")


@query("a7_canonicalised", "WITH m AS (SELECT event_type, max(n) > 1 AS multi FROM (SELECT event_type, user_id, count(DISTINCT props) AS n FROM events GROUP BY ALL) GROUP BY 1) SELECT event_type AS predicate, CASE WHEN event_type='signup' THEN 'single' WHEN multi THEN 'multi' ELSE 'single' END AS cardinality FROM m")
def a7(spark, d):
    """Cardinality of each predicate from the seed map, else from what its entities hold."""
    g = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count_distinct("props").alias("n")).groupBy("event_type").agg((F.max("n") > 1).alias("multi"))
    return g.select(F.col("event_type").alias("predicate"), F.when(F.col("event_type") == "signup", "single").when(F.col("multi"), "multi").otherwise("single").alias("cardinality"))


# criticality, tiers, literals

#: Levels, categories and keywords in order (fixed values).
RULES = [
    ("critical", "safety", ["allerg", "anaphyla", "epipen", "do not resuscitate", "suicid", "overdose"]),
    ("critical", "medical", ["medication", "dosage", "prescription", "diagnos", "blood type", "insulin"]),
    ("high", "legal", ["nda", "contract", "lawsuit", "liabilit", "confidential", "gdpr", "hipaa"]),
    ("high", "financial", ["account number", "routing", "ssn", "tax id", "salary", "bank", "wire transfer"]),
    ("high", "boundary", ["must not", "boundary", "off-limits"]),
    ("high", "identity", ["legal name", "passport", "date of birth", "national id", "license number"]),
    ("high", "security", ["password", "api key", "secret", "private key", "credential", "2fa", "mfa"]),
]
IMPERATIVE = ["never ", "do not ", "don't ", "always ask"]  # fixed values
NORM = r"^\s*(?:please )?(?:never|always|do not|don't|from now on|make sure|remember to)\b"


def standing_instruction(text: Column) -> Column:
    """Begins as a norm and is no question."""
    return F.lower(text).rlike(NORM) & ~F.rtrim(text).endswith("?")


def criticality(text: Column) -> Column:
    """struct of level and category: the first rule of the highest level; an imperative norm is a boundary."""
    t = F.lower(text)
    has = lambda words: F.lit(False) if not words else t.rlike("|".join(w.replace("|", r"\|") for w in words))
    out = F.when(has(RULES[0][2]), F.struct(F.lit(RULES[0][0]).alias("level"), F.lit(RULES[0][1]).alias("category")))
    for level, category, words in RULES[1:]:
        out = out.when(has(words), F.struct(F.lit(level).alias("level"), F.lit(category).alias("category")))
    out = out.when(has(IMPERATIVE) & standing_instruction(text), F.struct(F.lit("high").alias("level"), F.lit("boundary").alias("category")))
    return out.otherwise(F.struct(F.lit("normal").alias("level"), F.lit("").alias("category")))


def _has_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in words) + ")"


NORM_SQL = f"(regexp_matches(lower(text), {q(NORM)}) AND NOT ends_with(rtrim(text), '?'))"
LEVEL_SQL = "CASE " + " ".join(f"WHEN {_has_sql(w)} THEN '{lv}'" for lv, _, w in RULES) + f" WHEN {_has_sql(IMPERATIVE)} AND {NORM_SQL} THEN 'high' ELSE 'normal' END"
CATEGORY_SQL = "CASE " + " ".join(f"WHEN {_has_sql(w)} THEN '{c}'" for _, c, w in RULES) + f" WHEN {_has_sql(IMPERATIVE)} AND {NORM_SQL} THEN 'boundary' ELSE '' END"
TALK = f"{SAID}, talk AS (SELECT 'c' || c AS id, text FROM said UNION ALL SELECT conv_id || '-' || turn, text FROM conversations)"


def talk(spark, d) -> DataFrame:
    """``id, text`` of utterances and of the turns of ``conversations``."""
    a = said(spark, d).select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("id"), "text")
    return a.union(load(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"))


@query("f11_criticality", f"WITH {TALK} SELECT id, {LEVEL_SQL} AS level, {CATEGORY_SQL} AS category FROM talk")
def f11(spark, d):
    """level and category of every text by seven rules and the imperative gate."""
    return talk(spark, d).select("id", criticality(F.col("text")).alias("c")).select("id", "c.level", "c.category")


@query("p17_standing_instructions", f"WITH {TALK} SELECT id FROM talk WHERE {NORM_SQL}")
def p17(spark, d):
    """Texts that set a standing norm."""
    return talk(spark, d).where(standing_instruction(F.col("text"))).select("id")


#: Exact literals that a summary must not reword, in order of preference.
LITERAL = r"""https?://[^\s"']+|\d+\.\d+\.\d+\.\d+|[\w.]+@[\w.]+\w|(?:/[\w.-]+){2,}|--[a-z][\w-]*|"[^"\n]+"|\b[0-9a-f]{12,}\b|\b\d+ ?(?:mg|km|pm|am|days|%)|\b\d{4}-\d{2}-\d{2}\b"""
DECISION = r"\b(?:decided|decision|going to|chose|agreed|instead of|root cause|because|therefore|turns out)\b"
LITERALS_SQL = f"regexp_extract_all(text, {q(LITERAL)})"


def literals(text: Column) -> Column:
    """exact literals in order; one alternation, so that they never overlap."""
    return F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))


@query("f12_involatile", f"WITH {TALK} SELECT id, array_to_string({LITERALS_SQL}, '|') AS literals, list_sum(list_transform({LITERALS_SQL}, lambda x: length(x)))::BIGINT AS chars FROM talk WHERE len({LITERALS_SQL}) > 0")
def f12(spark, d):
    """the spans of a text that must stay as they are."""
    t = talk(spark, d).select("id", literals(F.col("text")).alias("l")).where(F.size("l") > 0)
    return t.select("id", F.array_join("l", "|").alias("literals"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


TIER_SQL = f"CASE WHEN trim(text) = '' THEN 'pointer' WHEN {NORM_SQL} THEN 'critical' WHEN len({LITERALS_SQL}) > 0 THEN 'involatile' WHEN regexp_matches(lower(text), {q(DECISION)}) THEN 'critical' ELSE 'context' END"


def tier(text: Column) -> Column:
    """how a unit may be kept: as a pointer, whole, with its literals, or in other words."""
    return (
        F.when(F.trim(text) == "", "pointer").when(standing_instruction(text), "critical").when(F.size(literals(text)) > 0, "involatile")
        .when(F.lower(text).rlike(DECISION), "critical").otherwise("context")
    )


@query("f13_tiers", f"WITH {TALK} SELECT id, {TIER_SQL} AS tier FROM talk")
def f13(spark, d):
    """retention tiers."""
    return talk(spark, d).select("id", tier(F.col("text")).alias("tier"))


CAP = 60
SHORT_SQL = f"CASE WHEN length(text) <= {CAP} THEN text ELSE substr(text, 1, {CAP // 3}) || ' [' || substr(array_to_string({LITERALS_SQL}, ' '), 1, {CAP // 3}) || '] ' || substr(text, length(text) - {CAP // 3 - 4}) END"


def shorten(text: Column, cap: int = CAP) -> Column:
    """a third for the head, a third for the literals, the rest for the tail."""
    third = cap // 3
    short = F.concat(F.substring(text, 1, third), F.lit(" ["), F.substring(F.array_join(literals(text), " "), 1, third), F.lit("] "), F.right(text, F.lit(third - 3)))
    return F.when(F.length(text) <= cap, text).otherwise(short)


@query("f14_shortened", f"WITH {TALK} SELECT id, {SHORT_SQL} AS short FROM talk")
def f14(spark, d):
    """texts shortened with their literals kept."""
    return talk(spark, d).select("id", shorten(F.col("text")).alias("short"))


FOCUS = ("allergic", "email", "brother", "name", "decided")
SCORE_SQL = f"""round(least(1.0, 0.20*(turn + 1)/(last + 1) + 0.35*len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), {list(FOCUS)}))/{len(FOCUS)}.0 + 0.20*(CASE WHEN len({LITERALS_SQL}) > 0 THEN 1 ELSE 0 END) + 0.20*(CASE {LEVEL_SQL} WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.5 ELSE 0 END)),6)"""


def keep(text: Column, recency: Column) -> Column:
    """recency, focus, literals and criticality of the text itself, at most 1."""
    shared = F.size(F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, FOCUS)))) / float(len(FOCUS))
    level = criticality(text)["level"]
    worth = F.when(level == "critical", 1.0).when(level == "high", 0.5).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.20 * recency + 0.35 * shared + 0.20 * (F.size(literals(text)) > 0).cast("int") + 0.20 * worth), 6)


@query("f10_keep_score", f"WITH {SAID}, t AS (SELECT c AS turn, max(c) OVER () AS last, text FROM said UNION ALL SELECT turn, max(turn) OVER (PARTITION BY conv_id), text FROM conversations) SELECT turn, sha256(text) AS h, {SCORE_SQL}::DOUBLE AS score FROM t")
def f10(spark, d):
    """What each unit is worth keeping."""
    a = said(spark, d)
    a = a.select(F.col("c").alias("turn"), "text").join(F.broadcast(a.agg(F.max("c").alias("last"))))  # one row
    c = load(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    t = a.union(c.join(last, "conv_id").select("turn", "text", "last"))
    return t.select("turn", F.sha2("text", 256).alias("h"), keep(F.col("text"), (F.col("turn") + 1) / (F.col("last") + 1)).alias("score"))


@query("w15_salience_rank", f"WITH t AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), s AS (SELECT conv_id, turn, {SCORE_SQL}::DOUBLE AS score FROM t) SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM s")
def w15(spark, d):
    """A session's turns by what they are worth, then by place."""
    c = load(spark, d, "conversations")
    s = c.join(c.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    s = s.select("conv_id", "turn", keep(F.col("text"), (F.col("turn") + 1) / (F.col("last") + 1)).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")).cast("long"))


@query("l23_rescued", f"WITH {TALK}, r AS (SELECT id, {LEVEL_SQL} AS level, {CATEGORY_SQL} AS category FROM talk) SELECT id, category, CASE WHEN level='critical' THEN 'active' ELSE 'draft' END AS status FROM r WHERE level <> 'normal'")
def l23(spark, d):
    """Critical turns are saved as observations with a note before a session is cut."""
    r = talk(spark, d).select("id", criticality(F.col("text")).alias("c")).where("c.level <> 'normal'")
    return r.select("id", "c.category", F.when(F.col("c.level") == "critical", "active").otherwise("draft").alias("status"))


# speakers

SPOKEN = """CASE turn % 3 WHEN 0 THEN upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text WHEN 1 THEN '[note: ' || role || '] ' || text ELSE text END"""
LABEL = r"^(User|Assistant|System|Tool): "
FRAME = r"\[note: [^\]]*\]\s*"
SPOKEN_SQL = f"""spoken AS (SELECT conv_id, turn, role, {SPOKEN} AS payload FROM conversations), ls AS (SELECT conv_id, turn, role, unnest(string_split(payload, chr(10))) AS line, generate_subscripts(string_split(payload, chr(10)), 1) AS i FROM spoken),
  who AS (SELECT conv_id, turn, i, upper(coalesce(last_value(nullif(regexp_extract(line, {q(LABEL)}, 1), '') IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING), role)) AS speaker, regexp_replace(line, {q(LABEL)}, '') AS line FROM ls)"""


def spoken(spark, d) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", "role", F.expr(SPOKEN).alias("payload"))


def attributed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, i, speaker, line`` of every line: a label holds until the next one."""
    lines = rows.select("conv_id", "turn", "role", F.posexplode(F.split("payload", "\n")).alias("i", "line"))
    label = F.regexp_extract("line", LABEL, 1)
    w = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    who = F.upper(F.coalesce(F.last(F.when(label != "", label), ignorenulls=True).over(w), F.col("role")))
    return lines.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("i"), who.alias("speaker"), F.regexp_replace("line", LABEL, "").alias("line"))


@query("f44_attributed_lines", f"WITH {SPOKEN_SQL} SELECT conv_id, turn, i::BIGINT AS i, speaker, line FROM who")
def f44(spark, d):
    """every line of a turn with its speaker."""
    return attributed(spoken(spark, d))


@query("f45_reader_text", f"WITH {SPOKEN_SQL} SELECT conv_id, turn, string_agg(speaker || ': ' || line, chr(10) ORDER BY i) AS text FROM who WHERE speaker NOT IN ('SYSTEM','TOOL') GROUP BY ALL")
def f45(spark, d):
    """what a reader sees of a turn: labelled lines without those of the system and of tools."""
    g = attributed(spoken(spark, d)).where("speaker NOT IN ('SYSTEM', 'TOOL')").groupBy("conv_id", "turn")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "speaker", "line"))), lambda x: F.concat_ws(": ", x["speaker"], x["line"]))  # of one turn
    return g.agg(F.array_join(lines, "\n").alias("text"))


@query("f43_speaker_spans", f"WITH {SPOKEN_SQL} SELECT conv_id, turn, length(payload) - length(regexp_replace(payload, {q(FRAME)}, '', 'g')) AS system_chars, length(regexp_replace(payload, {q(FRAME)}, '', 'g')) AS own_chars, len(regexp_extract_all(payload, {q(FRAME)})) AS frames FROM spoken")
def f43(spark, d):
    """the host's framing within a message belongs to the system, the rest to its side."""
    own = F.length(F.regexp_replace("payload", FRAME, "")).cast("long")
    return spoken(spark, d).select("conv_id", "turn", (F.length("payload") - own).cast("long").alias("system_chars"), own.alias("own_chars"), F.size(F.regexp_extract_all("payload", F.lit(FRAME), F.lit(0))).cast("long").alias("frames"))


@query("p11_automation", "SELECT source, count(*) AS n FROM documents WHERE NOT (starts_with(source, 'src1') OR starts_with(source, 'src2')) GROUP BY source")
def p11(spark, d):
    """Sessions of automation are left out by their prefixes."""
    auto = F.col("source").startswith("src1") | F.col("source").startswith("src2")
    return load(spark, d, "documents").where(~auto).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


PARTS = """CASE turn % 2 WHEN 0 THEN '[{"type":"text","text":"' || role || ' ' || turn || '"},{"type":"image_url"},{"type":"file"}]' ELSE '[{"type":"text","text":"' || role || '"},{"type":"other"}]' END"""
MARKS = {"image_url": "[image]", "image": "[image]", "input_image": "[image]", "input_audio": "[audio]", "audio": "[audio]", "file": "[file]", "input_file": "[file]"}  # fixed values


@query("f57_message_text", f"""WITH p AS (SELECT conv_id, turn, {PARTS} AS content FROM conversations), x AS (SELECT conv_id, turn, unnest(from_json(content, '[{{"type":"VARCHAR","text":"VARCHAR"}}]')) AS part FROM p)
  SELECT conv_id, turn, string_agg(coalesce(part.text, CASE part.type WHEN 'image_url' THEN '[image]' WHEN 'file' THEN '[file]' ELSE '[attachment]' END), chr(10)) AS text FROM x GROUP BY ALL""")
def f57(spark, d):
    """content in parts becomes text with marks for what is no text."""
    parts = F.from_json(F.expr(PARTS), "array<struct<type:string,text:string>>")
    mark = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    text = F.transform(parts, lambda p: F.coalesce(p["text"], mark[p["type"]], F.lit("[attachment]")))
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(text, "\n").alias("text"))


@query("f46_interaction_text", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM conversations")
def f46(spark, d):
    """lowered, letters, digits and apostrophes only, squeezed."""
    return load(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9']+", " "), r"\s+", " ")).alias("text"))


# words

STOPS = ("the", "of", "and", "with", "for", "that", "this", "from")
CONTENT_SQL = r"list_distinct(list_transform(list_filter(regexp_extract_all(lower(regexp_replace(text, 'https?://\S+', ' ', 'g')), '[a-z]{3,}'), lambda w: NOT list_contains(" + str(list(STOPS)) + r", w)), lambda w: CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END))"


def content_words(text: Column) -> Column:
    """distinct stems of the words that say something; addresses are left out."""
    w = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"https?://\S+", " ")), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(w, lambda x: ~x.isin(*STOPS)), stem))


@query("f7_content_words", f"SELECT doc_id, len({CONTENT_SQL}) AS n, list_min({CONTENT_SQL}) AS first_word FROM documents")
def f7(spark, d):
    """how many words of content a document has."""
    w = load(spark, d, "documents").select("doc_id", content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_min("w").alias("first_word"))


@query("f4_content_units", "SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS latin, len(list_distinct(list_transform(range(1, length(text)), lambda i: CASE WHEN regexp_matches(substr(text, i::BIGINT, 2), '^[一-龥]{2}$') THEN substr(text, i::BIGINT, 2) END)[1:0])) AS pairs FROM benchmark")
def f4(spark, d):
    """units of content: words of four letters or more, pairs of neighbours in runs of ideographs."""
    runs = F.regexp_extract_all("text", F.lit("[一-龥]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return load(spark, d, "benchmark").select("item_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).cast("long").alias("latin"), F.size(F.array_distinct(pairs)).cast("long").alias("pairs"))


ENDINGS = ("s", "es", "ed", "ing", "er", "ly")


@query("f6_inflections", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark), e(e) AS (VALUES " + ", ".join(f"('{e}')" for e in ENDINGS) + ") SELECT a.w AS base, b.w AS inflected FROM w a, e JOIN w b ON b.w = a.w || e.e")
def f6(spark, d):
    """Pairs of words that are one word up to its ending: bases take each ending, then an equality joins."""
    w = load(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).distinct()
    longer = w.select(F.col("w").alias("base"), F.explode(F.array(*map(F.lit, ENDINGS))).alias("e")).select("base", F.concat("base", "e").alias("inflected"))
    return longer.join(w.withColumnRenamed("w", "inflected"), "inflected").select("base", "inflected")


@query("f8_focus", """WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS x, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{3,}'), 1) AS i FROM benchmark), g AS (SELECT item_id, lower(x) AS word, count(*) + 2 * max((regexp_matches(x, '^[A-Z]') AND i > 1)::INT) AS weight, min(i) AS i FROM w GROUP BY item_id, lower(x))
  SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, length(word) DESC, i) AS rank FROM g QUALIFY rank <= 24""")
def f8(spark, d):
    """The 24 most telling words of a question: by count (two more for names), length and place."""
    w = load(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("i", "x"))
    g = w.groupBy("item_id", F.lower("x").alias("word")).agg((F.count(F.lit(1)) + 2 * F.max((F.col("x").rlike("^[A-Z]") & (F.col("i") > 0)).cast("int"))).alias("weight"), F.min("i").alias("i"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("weight"), F.desc(F.length("word")), "i"))
    return g.withColumn("rank", rank.cast("long")).where("rank <= 24").select("item_id", "word", "rank")


@query("u6_focus_units", f"WITH b AS (SELECT item_id, {CONTENT_SQL} AS w FROM benchmark), dd AS (SELECT doc_id, {CONTENT_SQL} AS w FROM documents WHERE n_chars > 0), bw AS (SELECT item_id, unnest(w) AS w FROM b), dw AS (SELECT doc_id, unnest(w) AS w FROM dd) SELECT item_id, doc_id, count(*) AS shared FROM bw JOIN dw USING (w) GROUP BY ALL HAVING count(*) >= 12")
def u6(spark, d):
    """Documents that share twelve or more words of content with a question, by an equality join on words."""
    words = lambda t, k: load(spark, d, t).select(k, F.explode(content_words(F.col("text"))).alias("w"))
    return words("benchmark", "item_id").join(words("documents", "doc_id"), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 12")


@query("t12_relevance", f"WITH t AS (SELECT doc_id, len(list_intersect({CONTENT_SQL}, ['keit','thtion','wher','ent','lich','des','ment'])) AS shared FROM documents) SELECT doc_id, shared FROM t WHERE shared >= 2")
def t12(spark, d):
    """Relevant is what shares two words of a question of more than three."""
    need = F.array(*map(F.lit, ["keit", "thtion", "wher", "ent", "lich", "des", "ment"]))
    return load(spark, d, "documents").select("doc_id", F.size(F.array_intersect(content_words(F.col("text")), need)).cast("long").alias("shared")).where("shared >= 2")


@query("p15_substance", f"WITH {SAID}, s AS (SELECT c, {LINES} AS text FROM said) SELECT c, text FROM s WHERE (len({LITERALS_SQL}) > 0 OR regexp_matches(text, ' [A-Z]')) AND NOT regexp_matches(text, '^(Fine|Re:|Fwd:)')")
def p15(spark, d):
    """Statements that name something: a literal or a name, and no subject line."""
    s = said(spark, d).select("c", F.explode(sentences(F.col("text"))).alias("text"))
    return s.where(((F.size(literals(F.col("text"))) > 0) | F.col("text").rlike(" [A-Z]")) & ~F.col("text").rlike("^(Fine|Re:|Fwd:)"))


@query("p16_plausible_names", r"""WITH n AS (SELECT 'c' || c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Ann of Customer' WHEN 1 THEN c_name WHEN 2 THEN 'please call her later today or tomorrow' ELSE 'Bob Brown' END AS name FROM customer)
  SELECT id, name FROM n WHERE length(name) BETWEEN 2 AND 60 AND len(string_split(name, ' ')) <= 5 AND regexp_matches(name, '^[A-Z]') AND NOT regexp_matches(name, '[#0-9]{3,}')""")
def p16(spark, d):
    """Names as people and things have them: short, capitalised, no ids."""
    k = F.col("c_custkey") % 4
    n = load(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(k == 0, "Ann of Customer").when(k == 1, F.col("c_name")).when(k == 2, "please call her later today or tomorrow").otherwise("Bob Brown").alias("name"))
    return n.where(F.length("name").between(2, 60) & (F.size(F.split("name", " ")) <= 5) & F.col("name").rlike("^[A-Z]") & ~F.col("name").rlike("[#0-9]{3,}"))


# time

WHEN = """CASE o_orderkey % 14 WHEN 0 THEN 'on 1997-03-05 it rained' WHEN 1 THEN 'since March 5, 1997' WHEN 2 THEN 'the 5 March 1997 one' WHEN 3 THEN 'in Feb 1996' WHEN 4 THEN 'back in 1995' WHEN 5 THEN 'yesterday' WHEN 6 THEN 'only today'
  WHEN 7 THEN '' || (o_custkey % 40) || ' days ago' WHEN 8 THEN 'three weeks ago' WHEN 9 THEN '2 months ago' WHEN 10 THEN 'last week' WHEN 11 THEN 'this month' WHEN 12 THEN 'last year' ELSE 'some day' END"""
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def time_window(text: Column, now: Column) -> Column:
    """struct of the first and last day that a phrase means, the narrowest reading first; null if it means none.

    ISO day, "March 5, 1997", "5 March 1997", "March 1997", a year; then, from ``now``: yesterday, today, N days, weeks
    or months ago (digits or words), last or this week (Monday to Sunday), month, year.
    """
    t = F.lower(text)
    at = lambda rx, i: F.regexp_extract(t, rx, i)
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(m, 1, 3)).cast("int")
    span = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    day = lambda x: span(x, x)
    make = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d")).cast("date")  # noqa: E731  null if there is no such day
    num = lambda x: F.when(x != "", x.try_cast("int"))
    iso, mdy, dmy, my, yr = r"\b(\d{4})-(\d{2})-(\d{2})\b", rf"\b{MONTH} (\d{{1,2}}),? (\d{{4}})\b", rf"\b(\d{{1,2}}) {MONTH},? (\d{{4}})\b", rf"\b{MONTH} (\d{{4}})\b", r"\b((?:19|20)\d{2})\b"
    ago = rf"\b(\d+|{'|'.join(NUMBERS)}) (day|week|month)s? ago\b"
    n = F.coalesce(num(at(ago, 1)), F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), at(ago, 1)), F.lit(0)).cast("int"))
    today = now.cast("date")
    monday, first = F.trunc(today, "week"), F.trunc(today, "month")
    out = F.when(at(iso, 1) != "", day(make(num(at(iso, 1)), num(at(iso, 2)), num(at(iso, 3)))))
    out = out.when(at(mdy, 1) != "", day(make(num(at(mdy, 3)), month(at(mdy, 1)), num(at(mdy, 2)))))
    out = out.when(at(dmy, 2) != "", day(make(num(at(dmy, 3)), month(at(dmy, 2)), num(at(dmy, 1)))))
    start = make(num(at(my, 2)), month(at(my, 1)), F.lit(1))
    out = out.when(at(my, 1) != "", span(start, F.last_day(start)))
    out = out.when(at(yr, 1) != "", span(make(num(at(yr, 1)), F.lit(1), F.lit(1)), make(num(at(yr, 1)), F.lit(12), F.lit(31))))
    out = out.when(t.rlike(r"\byesterday\b"), day(F.date_sub(today, 1))).when(t.rlike(r"\btoday\b"), day(today))
    out = out.when(at(ago, 2) == "day", day(F.date_sub(today, n))).when(at(ago, 2) == "week", day(F.date_sub(today, n * 7))).when(at(ago, 2) == "month", day(F.add_months(today, -n)))
    out = out.when(t.rlike(r"\blast week\b"), span(F.date_sub(monday, 7), F.date_sub(monday, 1))).when(t.rlike(r"\bthis week\b"), span(monday, F.date_add(monday, 6)))
    out = out.when(t.rlike(r"\blast month\b"), span(F.add_months(first, -1), F.date_sub(first, 1))).when(t.rlike(r"\bthis month\b"), span(first, F.last_day(first)))
    year = F.trunc(today, "year")
    return out.when(t.rlike(r"\blast year\b"), span(F.add_months(year, -12), F.date_sub(year, 1)))


@query("f30_time_window", """SELECT o_orderkey, lo, hi FROM (SELECT o_orderkey, CASE o_orderkey % 14 WHEN 0 THEN DATE '1997-03-05' WHEN 1 THEN DATE '1997-03-05' WHEN 2 THEN DATE '1997-03-05' WHEN 3 THEN DATE '1996-02-01' WHEN 4 THEN DATE '1995-01-01' WHEN 5 THEN t - 1 WHEN 6 THEN t WHEN 7 THEN t - (o_custkey % 40)::INT WHEN 8 THEN t - 21 WHEN 9 THEN (t - INTERVAL 2 MONTH)::DATE
    WHEN 10 THEN date_trunc('week', t)::DATE - 7 WHEN 11 THEN date_trunc('month', t)::DATE WHEN 12 THEN (date_trunc('year', t) - INTERVAL 1 YEAR)::DATE END AS lo,
  CASE o_orderkey % 14 WHEN 3 THEN DATE '1996-02-29' WHEN 4 THEN DATE '1995-12-31' WHEN 10 THEN date_trunc('week', t)::DATE - 1 WHEN 11 THEN last_day(t) WHEN 12 THEN date_trunc('year', t)::DATE - 1 END AS hi0, coalesce(hi0, lo) AS hi FROM (SELECT *, o_orderdate::DATE AS t FROM orders)) WHERE lo IS NOT NULL""")
def f30(spark, d):
    """days that phrases mean; the SQL computes them from what the phrases were made of."""
    o = load(spark, d, "orders").select("o_orderkey", time_window(F.expr(WHEN), F.col("o_orderdate")).alias("w"))
    return o.where("w.lo IS NOT NULL").select("o_orderkey", "w.lo", "w.hi")


@query("f53_freshness", "SELECT o_orderkey, round(greatest(0, least(1, (90 - date_diff('day', o_orderdate, TIMESTAMP '1998-01-01'))/90.0)),6)::DOUBLE AS fresh FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'")
def f53(spark, d):
    """a hint fades from 1 to 0 over its 90 days."""
    from .text import freshness

    o = load(spark, d, "orders").where("o_orderdate <= TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    days = lambda c: F.unix_date(c)
    made = days(F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", F.round(freshness(made, made + 90, days(F.lit("1998-01-01").cast("date"))), 6).alias("fresh"))


# keys, ids, cards

@query("f34_typed_keys", rf"""WITH {SAID}, k AS (SELECT c, 'e:' || unnest(regexp_extract_all(lower(text), '[a-z0-9._]+@[a-z0-9.]+[a-z]')) AS key FROM said UNION ALL SELECT c, 'g:' || regexp_extract(text, '@([a-z.]+[a-z])', 1) FROM said WHERE regexp_matches(text, '@[a-z]') UNION ALL SELECT c, 'w:' || regexp_extract(text, 'https?://([a-z.]+)', 1) FROM said WHERE regexp_matches(text, 'https?://[a-z]')
  UNION ALL SELECT c, 'p:' || substr(regexp_replace(regexp_extract(text, '1-555-[0-9-]+[0-9]'), '[^0-9]', '', 'g'), 2) FROM said WHERE regexp_matches(text, '1-555-')) SELECT c, key FROM k""")
def f34(spark, d):
    """typed keys of a text: e: address, g: its domain, w: web host, p: phone."""
    t = F.col("text")
    mails = F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9._]+@[a-z0-9.]+[a-z]"), F.lit(0))
    keys = F.concat(
        F.transform(mails, lambda m: F.concat(F.lit("e:"), m)),
        F.transform(mails, lambda m: F.concat(F.lit("g:"), F.substring_index(m, "@", -1))),
        F.transform(F.regexp_extract_all(t, F.lit(r"https?://([a-z.]+)"), F.lit(1)), lambda m: F.concat(F.lit("w:"), m)),
        F.transform(F.regexp_extract_all(t, F.lit(r"1-555-[0-9-]+[0-9]"), F.lit(0)), lambda m: F.concat(F.lit("p:"), phone_key(m))),
    )
    return said(spark, d).select("c", F.explode(keys).alias("key"))


KINDS = {"widget": "product", "bolt": "part", "gear": "part", "nut": "part"}


@query("f37_entity_kinds", "SELECT p_partkey, coalesce(CASE split_part(p_name, ' ', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END, CASE WHEN p_name LIKE '%s' THEN 'group' END, 'thing') AS kind FROM part")
def f37(spark, d):
    """an entity's kind by its type word, the last first, else by its suffix."""
    words = F.reverse(F.split("p_name", " "))
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    by_word = F.get(F.filter(F.transform(F.slice(words, 1, 1), lambda w: kinds[w]), lambda k: k.isNotNull()), F.lit(0))
    return load(spark, d, "part").select("p_partkey", F.coalesce(by_word, F.when(F.col("p_name").endswith("s"), "group"), F.lit("thing")).alias("kind"))


@query("f22_canonical_json", """SELECT o_orderkey, '{"custkey":' || o_custkey || ',"orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","total":"' || CAST(CAST(o_totalprice AS DECIMAL(38,6)) AS VARCHAR) || '"}' AS json FROM orders""")
def f22(spark, d):
    """JSON with sorted keys and no floats: reals are strings of six places."""
    total = F.col("o_totalprice").cast("decimal(38,6)").cast("string")
    row = F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), total.alias("total"))
    return load(spark, d, "orders").select("o_orderkey", F.to_json(row).alias("json"))


@query("f23_decimals", "SELECT event_id, CASE WHEN value = floor(value) THEN CAST(floor(value)::BIGINT AS VARCHAR) ELSE CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR) END AS x FROM events")
def f23(spark, d):
    """an integer if integral, else six places."""
    return load(spark, d, "events").select("event_id", decimalize(F.col("value")).alias("x"))


@query("f26_belief_ids", "WITH s AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS supports FROM lineitem GROUP BY 1) SELECT l_orderkey, 'b_' || sha256('fact' || chr(31) || l_orderkey || chr(31) || supports) AS id, 'f_' || substr(sha256(l_orderkey || ''), 1, 16) AS row_id FROM s")
def f26(spark, d):
    """a belief's id from its kind, key and sorted supports; a projection row's from its key."""
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("s"))  # seven lines at most
    key = F.col("l_orderkey").cast("string")
    return g.select("l_orderkey", F.concat(F.lit("b_"), F.sha2(F.concat_ws("\x1f", F.lit("fact"), key, "s"), 256)).alias("id"), F.concat(F.lit("f_"), F.substring(F.sha2(key, 256), 1, 16)).alias("row_id"))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 64 bits over ASCII, in decimals, as a string of digits."""
    wide = lambda x: x.cast("decimal(38,0)")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")

    def step(h, c):
        low = (h % 256).cast("int")
        mixed = wide(h - low + low.bitwiseXOR(F.ascii(c)))
        return wide((mixed.cast("decimal(20,0)") * F.lit(1099511628211).cast("decimal(13,0)")) % two64)

    start = F.lit("14695981039346656037").cast("decimal(38,0)")
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step).cast("string")


@query("f28_fnv", "SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT), lambda h, b: ((h - h % 256 + xor((h % 256)::INT, b::INT)) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT)::VARCHAR AS h FROM part")
def f28(spark, d):
    """the 64-bit hash of names."""
    return load(spark, d, "part").select("p_partkey", fnv1a(F.col("p_name")).alias("h"))


@query("f39_folder_card", r"WITH p AS (SELECT regexp_extract(url, '://[^/]+/([^/?#]*)', 1) AS folder, regexp_extract(url, '[^/]+$', 0) AS name FROM pages), n AS (SELECT folder, list_sort(list_distinct(list(name)))[1:8] AS names, count(*) AS n FROM p GROUP BY folder) SELECT folder, n, array_to_string(names, ', ') AS names FROM n")
def f39(spark, d):
    """a folder's card: how many it holds and its first eight names; names are cut to eight before they are gathered."""
    p = load(spark, d, "pages").select(F.regexp_extract("url", "://[^/]+/([^/?#]*)", 1).alias("folder"), F.regexp_extract("url", "[^/]+$", 0).alias("name"))
    n = p.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("folder").orderBy("name")
    first = p.distinct().withColumn("r", F.row_number().over(w)).where("r <= 8").groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return n.join(first, "folder")


@query("f41_record_cards", "SELECT p_partkey, substr('[part] ' || p_name || ' -- brand: ' || p_brand || '; type: ' || p_type || '; size: ' || p_size, 1, 1200) AS card FROM part")
def f41(spark, d):
    """a record as a line: provider, name, then its fields."""
    fields = F.concat_ws("; ", *(F.concat_ws(": ", F.lit(k), F.col(c).cast("string")) for k, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))))
    return load(spark, d, "part").select("p_partkey", F.substring(F.concat(F.lit("[part] "), F.col("p_name"), F.lit(" -- "), fields), 1, 1200).alias("card"))


@query("f59_row_search_text", "SELECT s_suppkey, lower(s_name || ' ' || n_name || ' ' || r_name) AS text FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def f59(spark, d):
    """the text of a row that full-text search reads."""
    n, r = load(spark, d, "nation"), load(spark, d, "region")  # 25 and 5 rows
    where = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    j = load(spark, d, "supplier").join(F.broadcast(where), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", F.lower(F.concat_ws(" ", "s_name", "n_name", "r_name")).alias("text"))


@query("f55_segments", r"WITH s AS (SELECT page_id, unnest(string_split(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '/')) AS seg FROM pages) SELECT page_id, seg, CASE WHEN regexp_matches('2012', '^\d{4}$') AND regexp_matches(seg, '^\d{4}$') THEN seg = '2012' ELSE contains(lower(seg), 'es') END AS hit FROM s")
def f55(spark, d):
    """a token meets a path segment: years exactly, others as a part, in either case."""
    segs = F.split(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/")
    s = load(spark, d, "pages").select("page_id", F.explode(segs).alias("seg"))
    return s.select("page_id", "seg", F.when(F.col("seg").rlike(r"^\d{4}$"), F.col("seg") == "2012").otherwise(F.contains(F.lower("seg"), F.lit("es"))).alias("hit"))


@query("f51_answer_sentence", r"""WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), 'license') OR contains(lower(x), 'keit') OR contains(lower(x), 'tion')) AS hits FROM documents) SELECT doc_id, sha256(coalesce(hits[1], substr(string_split(text, chr(10))[1], 1, 200))) AS h FROM s""")
def f51(spark, d):
    """the first sentence with a word of focus, else the first line."""
    has = lambda x: F.contains(F.lower(x), F.lit("license")) | F.contains(F.lower(x), F.lit("keit")) | F.contains(F.lower(x), F.lit("tion"))
    hit = F.get(F.filter(F.split("text", r"(?<=[.!?])\s+"), has), F.lit(0))
    return load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce(hit, F.substring(F.substring_index("text", "\n", 1), 1, 200)), 256).alias("h"))


# passages

LEVELS = ((r"\n\s*\n", "\n\n"), (r"\n", "\n"), (r"(?<=[.!?])\s+", " "), (r"\s+", " "))


def passages(text: Column, size: int = 900) -> Column:
    """passages of at most ``size`` characters: paragraphs where they fit, else lines, sentences, words, hard cuts; packed greedily."""
    kind = "array<struct<sep:string,t:string>>"
    piece = lambda sep, t: F.struct(sep.alias("sep"), t.alias("t"))
    pieces = F.array(piece(F.lit(""), F.trim(text))).cast(kind)

    def split(rx, sep):
        def finer(p):
            parts = F.filter(F.transform(F.split(p["t"], rx), lambda x: F.trim(x)), lambda x: x != "")
            return F.when(F.length(p["t"]) <= size, F.array(p).cast(kind)).otherwise(F.transform(parts, lambda x, i: piece(F.when(i == 0, p["sep"]).otherwise(F.lit(sep)), x)).cast(kind))

        return finer

    for rx, sep in LEVELS:
        pieces = F.flatten(F.transform(pieces, split(rx, sep)))
    hard = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.length(p["t"]) - 1, F.lit(0)), F.lit(size)), lambda a: piece(F.when(a == 0, p["sep"]).otherwise(F.lit("")), F.substring(p["t"], a + 1, F.lit(size)))).cast(kind)
    pieces = F.flatten(F.transform(pieces, hard))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def pack(a, p):
        joined = F.concat(a["cur"], p["sep"], p["t"])
        fits = F.length(joined) <= size
        return F.struct(
            F.when((a["cur"] == "") | fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))).alias("out"),
            F.when(a["cur"] == "", p["t"]).when(fits, joined).otherwise(p["t"]).alias("cur"),
        )

    return F.aggregate(pieces, zero, pack, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


@query("f15_passages")
def f15(spark, d):
    """passages of every whole document (recursive, so no SQL; tested by brute force)."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(passages(F.col("text"))).alias("i", "passage"))


@query("f17_embedding_cap", "SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS letters FROM documents WHERE length(text) > 0")
def f17(spark, d):
    """pieces of at most 512 tokens of three characters; no letter is lost."""
    p = load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.explode_outer(passages(F.col("text"), 512 * 3)).alias("p"))
    return p.groupBy("doc_id").agg(F.sum(F.coalesce(F.length(F.regexp_replace("p", r"\s+", "")), F.lit(0))).alias("letters"))


@query("f16_excerpts", "SELECT doc_id, sha256(text) AS h FROM documents")
def f16(spark, d):
    """Chunks that end at a message, else a sentence, else anywhere; joined again they are the text."""
    g = load(spark, d, "documents").select("doc_id", excerpts(F.col("text"), 1200).alias("c"))
    return g.where(F.forall("c", lambda x: F.length(x) <= 1200)).select("doc_id", F.sha2(F.array_join("c", ""), 256).alias("h"))


def excerpts(text: Column, cap: int) -> Column:
    """F16: lossless chunks of at most ``cap`` characters; units end after a sentence or line, longer ones are cut."""
    units = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?\n]*(?:[.!?\n]+\s*|\z)"), F.lit(0))
    cut = F.flatten(F.transform(F.filter(units, lambda u: u != ""), lambda u: F.transform(F.sequence(F.lit(0), F.length(u) - 1, F.lit(cap)), lambda a: F.substring(u, a + 1, F.lit(cap)))))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def pack(a, u):
        fits = F.length(a["cur"]) + F.length(u) <= cap
        return F.struct(F.when(fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))).alias("out"), F.when(fits, F.concat(a["cur"], u)).otherwise(u).alias("cur"))

    return F.aggregate(cut, zero, pack, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))
