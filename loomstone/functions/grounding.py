"""Is a claimed value in its source?  Alignment of each value with the text it was taken from.

An extractor (a rule, a model, any callback) says that a source holds a value.  ``ground`` lays the value against
the source's whole text and tells where it stands:

* ``exact``: the folded value occurs in the folded text;
* ``reworded``: some span is within ``(1 - least_share)`` edits a character of the value, and every number of the
  value is in that span;
* ``altered``: such a span, but a number of the value isn't in it;
* ``invented``: no such span.

``kept`` is true for the first two; the others are for quarantine.  ``start`` and ``end`` are code points of the
original text, null if invented; ``cost`` is the edit distance.  Of several spans the one with the least cost
counts, then the one that ends first, then the shortest.

Folding lowers letters and makes runs of other characters one space.  Candidates come from anchors: an edit touches
at most q of the value's q-grams (q = L // (k + 1) for L characters and at most k edits, four at most), so a span
within the limit holds at least L - q + 1 - kq places, and one at least, where a q-gram of the value begins.  Only
stretches with so many of them within L + k characters are aligned, which loses no span within the limit.

A null or empty value (after folding) is ``invented``; so is one whose source has no text or doesn't exist.  A
source that is listed several times gives a row for each; a null source matches no source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import load, query

LONGEST = 4
_NUMBER = re.compile(r"\d+")
_RUN = re.compile(r"[^\W_]+")


def fold(text: str) -> tuple[str, list[int]]:
    """The folded text and the place in ``text`` of each of its characters."""
    out: list[str] = []
    at: list[int] = []
    for m in _RUN.finditer(text):
        run = m[0]
        if out:
            out.append(" ")
            at.append(m.start() - 1)
        # letter by letter beyond ASCII: lower() of a whole word looks at neighbours and can change its length
        out.append(run.lower() if run.isascii() else "".join(low if len(low := c.lower()) == 1 else c for c in run))
        at.extend(range(m.start(), m.end()))
    return "".join(out), at


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def ends(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits of the value to a stretch of text that ends before each place (0 to the length)."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, "i8")
    for i, c in enumerate(value):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return row


def start_of(value: np.ndarray, text: np.ndarray, cost: int) -> int:
    """The last start of a stretch that ends where ``text`` does and takes ``cost`` edits."""
    value, text = value[::-1], text[::-1]
    place = np.arange(len(text) + 1)
    row = place.copy()
    for i, c in enumerate(value):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return len(text) - int(np.flatnonzero(row == cost)[0])


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A number for the q characters from each place; equal ones have equal numbers."""
    n = len(text) - q + 1
    out = np.zeros(max(0, n), "u8")
    for i in range(q if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + text[i : n + i]
    return out


def stretches(value: np.ndarray, text: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Parts of the text that may hold the value with at most k edits, joined where they meet."""
    size, q = len(value), max(1, min(LONGEST, len(value) // (k + 1)))
    least = max(1, size - q + 1 - k * q)
    own = np.unique(grams(value, q))
    of_text = grams(text, q)
    hits = np.flatnonzero(own[np.minimum(np.searchsorted(own, of_text), len(own) - 1)] == of_text)
    if len(hits) < least:
        return []
    first, last = hits[: len(hits) - least + 1], hits[least - 1 :]
    near = last + q - first <= size + k
    low, high = np.maximum(0, last[near] + q - size - k), np.minimum(len(text), first[near] + size + k)
    if not len(low):
        return []
    new = np.flatnonzero(low[1:] > high[:-1]) + 1  # both ascend, so a part begins where it doesn't meet the one before
    return list(zip(low[np.r_[0, new]].tolist(), high[np.r_[new - 1, len(high) - 1]].tolist()))


def align(value: str, text: str | np.ndarray, k: int) -> tuple[int, int, int] | None:
    """``cost, start, end`` of the best span of at most k edits."""
    best, v = None, codes(value)
    whole = codes(text) if isinstance(text, str) else text
    for a, b in stretches(v, whole, k):
        t = whole[a:b]
        row = ends(v, t)
        e = int(np.argmin(row))
        cost = int(row[e])
        if cost <= k and (best is None or cost < best[0]):
            low = max(0, e - len(v) - cost)
            best = (cost, a + low + start_of(v, t[low:e], cost), a + e)
    return best


class Source:
    """A source's text, folded once for all its claims."""

    def __init__(self, text: str):
        self.text, self.at = fold(text)
        self.codes = codes(self.text)


def judged(value: str | None, source: Source, least_share: float) -> tuple[str, int | None, int | None, int | None]:
    """``kind, start, end, cost`` of one value."""
    v, _ = fold(value or "")
    t, at = source.text, source.at
    if not v or not t:
        return "invented", None, None, None
    s = t.find(v)
    found = (0, s, s + len(v)) if s >= 0 else align(v, source.codes, int((1 - least_share) * len(v) + 1e-9))
    if found is None or found[1] == found[2]:
        return "invented", None, None, None
    cost, s, e = found
    missing = Counter(_NUMBER.findall(v)) - Counter(_NUMBER.findall(t[s:e]))
    kind = "exact" if cost == 0 else "altered" if missing else "reworded"
    return kind, at[s], at[e - 1] + 1, cost


def ground(claims: DataFrame, sources: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Claims ``claim_id, source_id, value`` against ``source_id, text``: ``claim_id, source_id, kind, kept, start, end, cost``.

    Claims are told apart by the caller's ids; repeated ones give repeated rows.
    """
    if not 0 < least_share <= 1:
        raise ValueError("least_share is above 0 and at most 1")
    pairs = claims.select("claim_id", "source_id", "value").join(sources.select("source_id", "text"), "source_id", "left")
    pairs = pairs.select("claim_id", "source_id", F.col("value").cast("string"), F.col("text").cast("string"))
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, source = None, Source("")
        for b in batches:
            got = []
            for v, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if (t or "") != last:  # claims on one source mostly follow one another
                    last = t or ""
                    source = Source(last)
                got.append(judged(v, source, least_share))
            kind, start, end, cost = map(list, zip(*got)) if got else ([], [], [], [])
            kept = [x in ("exact", "reworded") for x in kind]
            more = [pa.array(kind, pa.string()), pa.array(kept, pa.bool_()), *(pa.array(c, pa.int64()) for c in (start, end, cost))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=["claim_id", "source_id", "kind", "kept", "start", "end", "cost"])

    return pairs.mapInArrow(run, f"claim_id {types['claim_id']}, source_id {types['source_id']}, kind string, kept boolean, start long, end long, cost long")


@query("f50_grounded")
def f50(spark, d):
    """Of every document the sixth to thirteenth word: as they stand, without the fifth letter, and as a claim on the document after it."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    value = F.array_join(F.slice(F.split("text", r"\s+"), 6, 8), " ")
    said = docs.select("doc_id", value.alias("value"))
    less = F.concat(F.substring("value", 1, 4), F.expr("substring(value, 6)"))
    claims = said.select("doc_id", F.explode(F.array(
        F.struct(F.lit("same").alias("how"), F.col("doc_id").alias("source_id"), F.col("value")),
        F.struct(F.lit("less").alias("how"), F.col("doc_id").alias("source_id"), less.alias("value")),
        F.struct(F.lit("other").alias("how"), (F.col("doc_id") + 1).alias("source_id"), F.col("value")),
    )).alias("c")).select(F.concat_ws(":", F.col("doc_id").cast("string"), "c.how").alias("claim_id"), "c.source_id", "c.value")
    return ground(claims, docs.withColumnRenamed("doc_id", "source_id"))
