"""Benchmark decontamination by spaced-seed hashing.

Words are lowered and hashed.  Each fixed mask selects some positions of a window of words and
ignores the others, so a window still matches when ignored words were changed.  The hashes of the
benchmark's windows are joined with those of the documents; around each hit the item is laid against
the document without gaps.  The longest stretch that begins and ends with an agreeing word and of which
``least_share`` agree, or the whole overlap if that much of it agrees, is a contamination if it covers
``least_words`` words (or the whole of a shorter item).

The join is Spark's.  The benchmark's windows become a table of hashes.  A bitmap of them, of a fixed
2 ** FILTER_BITS bits whatever the benchmark's size, goes to the tasks that scan the documents; what
passes it is joined by hash with the table, and hashes that very many documents share are dealt to many
tasks.  A candidate (document, item, shift) takes only the words that lie opposite the item along.

Items of fewer than ``least_item`` words match nothing: they occur everywhere by chance.  Shorter items
than the longest mask are also sought as a whole.  At the bound (12 words, 75 % of which agree) the masks
hit every placement of the changes; for stretches of other lengths the tests state the share.  Null text
and null item text have no words.  Null and repeated doc_ids are kept apart by row when documents are
dropped; in the list of hits they share their id.  Empty tables give empty results.  Other columns of the
input are passed on by ``drop`` and otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_keys, spread_join, table
from .tokens import mix, parts, words

#: Masks over word positions (fixed values): 1 is compared, 0 is ignored.  Chosen greedily among all masks of five
#: compared words in six to ten: together they hit every way to change 3 of 12 words between agreeing ends.
MASKS = ("111011", "110100011", "11001011", "110111")
LONGEST = max(map(len, MASKS))
FILTER_BITS = 27
TEXT_AT_ONCE = 1 << 18
BROADCAST_ROWS = 500_000  # up to so many keys (some 30 MB) documents to drop are found by broadcast, beyond by shuffle


def window_hashes(h: np.ndarray, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows under a mask, and where each begins; windows stay within their text."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, "u8"), np.empty(0, "i8")
    out = np.full(n, sum(map(ord, mask)) * 1_000_003 + len(mask), "u8")
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : i + n] * np.uint64((2 * i + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    at = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    return mix(out[at]), at


def longest(same: np.ndarray, least_share: float) -> tuple[int, int]:
    """Start and end of the longest stretch from one agreeing word to another of which the share agrees."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    # words that agree less those that must, before and after each agreeing word
    before = np.arange(len(at)) - least_share * at
    after = before + 1 - least_share
    first = np.searchsorted(-np.minimum.accumulate(before), -after - 1e-9)
    k = int(np.argmax(at - at[first]))
    return int(at[first[k]]), int(at[k]) + 1


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _seeds(masks: list[str], bits: np.ndarray | None, whole: bool):
    """``mapInArrow`` function over (columns to pass, text): words of each text and its windows' hashes and places.

    With ``bits``, only windows that pass the bitmap and only texts with such windows; with ``whole``, masks
    that are not of MASKS are for texts of just their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, batch.num_columns - 1, TEXT_AT_ONCE):
                h, text = words(_texts(part.column(part.num_columns - 1)))
                sizes = np.bincount(text, minlength=part.num_rows) if len(h) else np.zeros(part.num_rows, "i8")
                first = np.cumsum(sizes) - sizes
                keys, places = [np.empty(0, "u8")], [np.empty(0, "i8")]
                for m in masks:
                    k, at = window_hashes(h, text, m)
                    if bits is not None:
                        some = np.flatnonzero(passes(bits, k))
                        k, at = k[some], at[some]
                    if whole and m not in MASKS:
                        own = sizes[text[at]] == len(m)
                        k, at = k[own], at[own]
                    keys.append(k)
                    places.append(at)
                key, place = np.concatenate(keys), np.concatenate(places)
                who = text[place] if len(place) else place
                order = np.argsort(who, kind="stable")
                key, place, who = key[order], place[order], who[order]
                n = np.bincount(who, minlength=part.num_rows)
                rows = np.flatnonzero(n > 0) if bits is not None else np.arange(part.num_rows)
                if not len(rows):
                    continue
                ends = np.cumsum(sizes)
                part = part.take(pa.array(rows))
                raw = h.astype("<u8").tobytes()
                columns = [
                    *part.columns[:-1],
                    pa.array(sizes[rows], pa.int32()),
                    pa.array([raw[8 * s : 8 * e] for s, e in zip(first[rows], ends[rows])], pa.binary()),
                    _lists(key.view("i8"), n[rows], pa.int64()),
                    _lists((place - first[who]).astype("i4"), n[rows], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "n", "words", "h", "at"])

    return run


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits in the bitmap."""
    out, width = np.ones(len(key), bool), len(bits).bit_length() + 5
    for shift in (64 - width, 64 - 2 * width):
        p = key >> np.uint64(shift) & np.uint64((1 << width) - 1)
        out &= (bits[(p >> np.uint64(6)).astype("i8")] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Both bits of every hash in column ``h``: at most 2 ** FILTER_BITS / 64 numbers come to the driver."""
    mask = (1 << FILTER_BITS) - 1
    p = F.explode(F.array(*(F.shiftrightunsigned("h", s).bitwiseAND(F.lit(mask)) for s in (64 - FILTER_BITS, 64 - 2 * FILTER_BITS))))
    rows = seeds.select(p.alias("p")).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, cast(p & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, "u8")
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view("u8")
    return out


VERIFIED = pa.schema([("key", pa.string()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_same", pa.int64())])


def _verify(least_words: int, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, item, lo, shift, part, own in zip(*(c.to_pylist() for c in batch.columns)):
                part, own = np.frombuffer(part, "<u8"), np.frombuffer(own, "<u8")
                same = part == own[lo - shift : lo - shift + len(part)]
                s, e = (0, len(same)) if same.sum() >= least_share * len(same) else longest(same, least_share)
                n, m = e - s, int(same[s:e].sum())
                if n >= min(least_words, len(own)) and m >= least_share * n - 1e-9:
                    out.append((key, item, lo + s, n, m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), VERIFIED.types)], schema=VERIFIED)

    return run


def _key() -> Column:
    """Tells rows apart by doc_id and text."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))


def _found(documents: DataFrame, benchmark: DataFrame, least_words: int, least_share: float, least_item: int) -> tuple[DataFrame, DataFrame]:
    """``key, doc_id`` of every document that may have a hit, and ``key`` with the best overlap for each item."""
    sc = documents.sparkSession.sparkContext
    seeds = "n int, words binary, h array<long>, at array<int>"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    all_masks = [*MASKS, *("1" * n for n in range(least_item, LONGEST) if "1" * n not in MASKS)]
    items = cut(items.mapInArrow(_seeds(all_masks, None, True), f"item long, item_id long, {seeds}").where(F.col("n") >= least_item))
    short = {r.n for r in items.where(F.col("n") < LONGEST).select("n").distinct().collect()}  # fewer than LONGEST numbers
    masks = [m for m in all_masks if m in MASKS or len(m) in short]
    windows = items.select("item", "n", F.explode(F.arrays_zip("h", F.col("at").alias("place"))).alias("w")).select("item", "n", "w.h", "w.place")

    shared = sc.broadcast(bitmap(windows))
    rows = documents.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _seeds(masks, shared.value, False)(batches)

    scanned = cut(rows.mapInArrow(scan, f"key string, doc_id long, {seeds}"))
    shared.unpersist()
    once = scanned.dropDuplicates(["key"])
    hits = cut(once.select("key", F.explode(F.arrays_zip("h", "at")).alias("w")).select("key", "w.h", "w.at"))
    counted = hits.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    met = spread_join(hits, windows, ["h"], heavy_keys(counted, ["h"], "c", hits.count()))
    found = met.select("key", "item", "n", (F.col("at") - F.col("place")).alias("shift")).distinct()
    found = found.join(once.select("key", F.col("n").alias("size"), "words"), "key")
    found = found.withColumn("lo", F.greatest(F.lit(0), "shift"))
    part = F.col("words").substr(8 * F.col("lo") + 1, 8 * (F.least("size", F.col("shift") + F.col("n")) - F.col("lo")))
    found = cut(found.select("key", "item", "lo", "shift", part.alias("part")))
    counted = found.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    laid = spread_join(found, items.select("item", "item_id", "words"), ["item"], heavy_keys(counted, ["item"], "c", found.count()))
    laid = laid.select("key", "item_id", "lo", "shift", "part", "words")
    verified = laid.mapInArrow(_verify(least_words, least_share), "key string, item_id long, first_word long, n_words long, n_same long")
    best = F.max_by(F.struct("first_word", "n_words", "n_same"), F.struct("n_same", "n_words", -F.col("first_word")))
    return scanned.select("key", "doc_id"), verified.groupBy("key", "item_id").agg(best.alias("b"))


def find(documents: DataFrame, benchmark: DataFrame, least_words: int = 12, least_share: float = 0.75, least_item: int = 3) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, n_same`` of each document's best overlap with each item."""
    rows, best = _found(documents, benchmark, least_words, least_share, least_item)
    return rows.join(best, "key").select("doc_id", "item_id", "b.first_word", "b.n_words", "b.n_same")


def drop(documents: DataFrame, benchmark: DataFrame, least_words: int = 12, least_share: float = 0.75, least_item: int = 3) -> DataFrame:
    """The rows of ``documents`` without an overlap; all columns pass through unchanged."""
    _, best = _found(documents, benchmark, least_words, least_share, least_item)
    keys = cut(best.select("key").distinct())
    side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return documents.select(F.struct("*").alias("row"), _key().alias("key")).join(side, "key", "left_anti").select("row.*")


def op7_decontaminate(spark, sf_dir) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
