"""Many phrases in one pass over a text: an automaton in the tasks that read the rows.

The phrases become one Aho-Corasick automaton, which every Python worker builds once from a broadcast list; a text
is then read once, however many phrases there are.  All occurrences count, overlapping and nested ones too.

Texts and phrases are compared as ``folded`` gives them (lower case; runs of anything but letters, digits and
apostrophes are one space) or, with ``fold=False``, as they are.  With ``whole=True`` a phrase must not touch a
letter, digit, underscore or apostrophe on either side.  Positions are code points of the compared text.

Null and empty texts have no occurrence; null and empty phrases match nothing; a phrase that is listed under several
categories counts for each, and once for a category however often it is listed.  The list of phrases is a parameter
of at most ``MOST`` entries, not a table that grows with the data: ``phrases_of`` checks that.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import load, query

MOST = 1_000_000
_GAP = re.compile(r"[^\w']+|_+")
_built: dict[str, ahocorasick.Automaton] = {}  # in a worker, the last list's automaton, by the list's name


def folded(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def phrases_of(rows: DataFrame) -> list[tuple[str, str]]:
    """``category, phrase`` of a table of at most MOST rows."""
    got = rows.select("category", "phrase").where("phrase IS NOT NULL").distinct().limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"over {MOST} phrases")
    return [(r.category, r.phrase) for r in got]


def automaton(phrases: Iterable[tuple[str, str]], fold: bool) -> ahocorasick.Automaton:
    listed: dict[str, set[str]] = {}
    for category, phrase in phrases:
        p = folded(phrase) if fold else phrase
        if p:
            listed.setdefault(p, set()).add(category)
    out = ahocorasick.Automaton()
    for p, categories in listed.items():
        out.add_word(p, (p, sorted(categories)))
    if listed:
        out.make_automaton()
    return out


def _part(c: str) -> bool:
    return c.isalnum() or c in "_'"


def occurrences(found: ahocorasick.Automaton, text: str, whole: bool) -> Iterator[tuple[str, str, int]]:
    """``category, phrase, start`` of every occurrence in a compared text."""
    if not len(found):
        return
    for last, (p, categories) in found.iter(text):
        s = last + 1 - len(p)
        if whole and (s > 0 and _part(text[s - 1]) or last + 1 < len(text) and _part(text[last + 1])):
            continue
        for c in categories:
            yield c, p, s


def find_phrases(rows: DataFrame, text: str, phrases: Iterable[tuple[str, str]], *, whole: bool = True, fold: bool = True) -> DataFrame:
    """``rows`` without ``text``, a row for each occurrence, with ``_category``, ``_phrase`` and ``_start``."""
    spark, listed = rows.sparkSession, sorted(set(phrases))
    if len(listed) > MOST:
        raise ValueError(f"over {MOST} phrases")
    shared = spark.sparkContext.broadcast(listed)
    number = uuid.uuid4().hex
    others = [c for c in rows.columns if c != text]
    taken = {"_category", "_phrase", "_start"} & set(others)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are of the result")
    schema = rows.select(*others, F.lit("").alias("_category"), F.lit("").alias("_phrase"), F.lit(0).cast("long").alias("_start")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _built.get(number)
        if found is None:
            _built.clear()
            found = _built[number] = automaton(shared.value, fold)
        for batch in batches:
            at, category, phrase, start = [], [], [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for c, p, s in occurrences(found, folded(t) if fold else t, whole) if t else ():
                    at.append(i), category.append(c), phrase.append(p), start.append(s)
            if at:
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(category, pa.string()), pa.array(phrase, pa.string()), pa.array(start, pa.int64())],
                    names=[*part.schema.names[:-1], "_category", "_phrase", "_start"],
                )

    return rows.select(*others, text).mapInArrow(run, schema)


def mined(turns: DataFrame, phrases: Iterable[tuple[str, str]], least_support: int = 2) -> DataFrame:
    """``category, support, sessions, confidence`` over ``session, turn, text``.

    A turn supports a category once however many of its phrases and pieces match.  Confidence is
    0.50 + 0.08 a turn + 0.03 a session, 0.95 at most.
    """
    if least_support < 1:
        raise ValueError("least_support is 1 or more")
    hits = find_phrases(turns.select("session", "turn", "text"), "text", phrases).select("session", "turn", "_category").distinct()
    sums = hits.groupBy(F.col("_category").alias("category")).agg(F.count(F.lit(1)).alias("support"), F.count_distinct("session").alias("sessions"))
    confidence = F.round(F.least(F.lit(0.95), 0.50 + 0.08 * F.col("support") + 0.03 * F.col("sessions")), 6)
    return sums.where(F.col("support") >= least_support).withColumn("confidence", confidence)


ITEMS = r"""items AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9à-öø-ÿß]+', ' ', 'g')) AS t FROM benchmark),
  w AS (SELECT item_id, string_split(t, ' ') AS w FROM items WHERE t <> ''),
  ph AS (SELECT DISTINCT array_to_string(w[i:i+2], ' ') AS phrase FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9à-öø-ÿß]+', ' ', 'g')), ' ') AS w FROM documents),
  dw AS (SELECT doc_id, array_to_string(w[i:i+2], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))"""


@query("p18_phrase_hits", f"WITH {ITEMS} SELECT doc_id, count(*) AS hits, count(DISTINCT phrase) AS phrases FROM dw SEMI JOIN ph USING (phrase) GROUP BY doc_id")
def p18p(spark, d):
    """Occurrences, overlapping ones too, of every three-word phrase of the benchmark in all documents."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9à-öø-ÿß]+", " "))
    w = F.split(clean(F.col("text")), " ")
    grams = load(spark, d, "benchmark").select(F.explode(F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", F.slice(w, i, 3))))).alias("phrase"))
    phrases = phrases_of(grams.select(F.lit("item").alias("category"), "phrase"))
    docs = load(spark, d, "documents").select("doc_id", clean(F.col("text")).alias("text"))
    hits = find_phrases(docs, "text", phrases, fold=False)
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("_phrase").alias("phrases"))
