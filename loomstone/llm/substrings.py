"""Removal of repeated 50-byte strings, a bucket of suffixes at a time.

A byte of a document goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller doc_id.  Which suffixes agree in their first ``length`` bytes is all that matters, so no
suffix array is kept: suffixes are dealt into buckets of bounded size by a sample of their positions, and
each bucket groups the strings of its suffixes by hash and compares them byte by byte.  The sample stands
in for the precomputed difference cover (see the README for why that was left): it is chosen by content,
so that equal strings have it at the same place, and settles which suffixes can have a partner at all and
which bucket they belong to:

1. The sample of a string is its least hashed seed of ``SEED`` bytes, the leftmost if equal.  It
   takes 1 position in 10.  A periodic difference cover would take 6 in 31 with seeds of 20 bytes,
   and strings with one seed would not have it at one place; seeds of 20 bytes also recur by chance.
2. Documents are dealt into groups of bounded size.  Each group sends the distinct hashes of its
   seeds to buckets of hash ranges, which answer with those that another group has too.
3. For seeds that more than one document has, each group sends the distinct surroundings (all
   strings that own the seed lie within) with their smallest doc_id.  A bucket takes the strings of its
   surroundings a run of seeds at a time, compares them byte by byte with the first of their kind, and
   answers with those that start in a document with a smaller id.  A seed that has over ``crowd``
   different surroundings in some group (a line of dashes between other texts) is told to all groups as
   crowded: its strings go out one by one, each once for a group, to buckets of their own hashes.
4. Each group marks the bytes and measures what is left.

Because a group sends each hash and each surrounding once, a passage that a third of all documents
share costs a bucket one row for each group.  Whole copies of a text take part once, as the smallest
doc_id.  Groups sort their documents, so a group that is computed again gives the same answers.

Null text is empty.  Rows without doc_id are neither removed from nor a reason to remove.  Rows that
repeat a doc_id don't count as smaller than each other.  An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import P, groups, mix, powers, span_hashes

LENGTH, SEED = 50, 32
W = LENGTH - SEED + 1  # seeds of a string
AROUND = LENGTH + W - 1  # bytes of all strings that hold a seed
GROUP_BYTES = 4 << 20
SEED_BUCKET_BYTES = 32 << 20  # text whose seeds share a bucket
SORT_BUCKET_BYTES = 2 << 20  # text whose surroundings share a bucket
PARTITION_BYTES = 32 << 20  # text that a task reads
SORTED_AT_ONCE = 1 << 19  # strings
ENTRIES_AT_ONCE = 1 << 15  # surroundings, and as many more as share the last seed
CHUNK = 1 << 19
CROWD = 64  # different surroundings of a seed in a group, beyond which its strings are dealt one by one
SIDE = "g long, kind int, x long, idx long, data binary"


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes (a power of two) from each place."""
    h, n = data.astype("u8") + np.uint64(1), 1
    while n < SEED:
        h, n = h[:-n] * powers(n + 1)[n] + h[n:], 2 * n
    return mix(h)


def seeds_of(texts: list[bytes]):
    """For each seed that some string owns: its hash, text, place in the text, and first and last string's place."""
    out = []
    for a, b in groups(texts, CHUNK):
        part = texts[a:b]
        data = np.frombuffer(b"".join(part), np.uint8)
        if len(data) < LENGTH:
            continue
        h = seed_hashes(data)
        k = h & np.uint64(0xFFFFFFFFFFFFFFE0)  # the low bits hold the place within the string
        for n in (1, 2, 4, 8):
            k = np.minimum(k[:-n], k[n:] + np.uint64(n))
        k = np.minimum(k[: len(k) - (W - 16)], k[W - 16 :] + np.uint64(W - 16))
        ends = np.cumsum(np.array([len(t) for t in part], "i8"))
        p = np.arange(len(k))
        doc = np.searchsorted(ends, p, side="right")
        ok = p + LENGTH <= ends[doc]
        p, doc = p[ok], doc[ok]
        if not len(p):
            continue
        at = p + (k[p] & np.uint64(31)).astype("i8")
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(p)) - 1
        begin = ends[doc[new]] - np.array([len(t) for t in part], "i8")[doc[new]]
        # least hashes are small numbers; mixed again they spread evenly over the buckets
        out.append((mix(h[at[new]] ^ P), doc[new] + a, at[new] - begin, p[new] - begin, p[last] - begin))
    if not out:
        return (np.empty(0, "u8"), *(np.empty(0, "i8") for _ in range(4)))
    return tuple(np.concatenate(x) for x in zip(*out))


def six(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
    return out.view("<u8").ravel()


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("i8")


class Group:
    """A group's documents in a fixed order; of whole copies only the one that stands for them."""

    def __init__(self, docs: pd.DataFrame, side: pd.DataFrame):
        rows = [(d, t.encode("utf-8", "surrogatepass")) for d, t in zip(docs["doc_id"].tolist(), docs["text"].tolist())]
        rows.sort()
        first = dict.fromkeys(side.loc[side["kind"] == 0, "x"].tolist())
        self.all = rows
        self.active = [i for i, (d, t) in enumerate(rows) if d in first and len(t) >= LENGTH and (i == 0 or rows[i - 1] != rows[i])]
        self.ids = np.array([rows[i][0] for i in self.active], "i8")
        self.texts = [rows[i][1] for i in self.active]
        self.h, self.doc, self.at, self.lo, self.hi = seeds_of(self.texts)
        self.side = side

    def shared(self, buckets: int) -> np.ndarray:
        """Which seeds more than one document has, here or elsewhere."""
        order = np.lexsort((self.doc, self.h))
        h, doc = self.h[order], self.doc[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        kind = np.cumsum(new) - 1
        many = np.zeros(len(h), bool)
        if len(h):
            last = np.append(np.flatnonzero(new)[1:], len(h)) - 1
            many = (doc[last] != doc[new])[kind]
        out = np.empty(len(h), bool)
        out[order] = many
        return out | self.told(1, buckets)

    def told(self, kind: int, buckets: int) -> np.ndarray:
        """Which seeds are among those that the buckets told: 1 of several groups, 3 crowded."""
        told = self.side[self.side["kind"] == kind]
        if not len(told):
            return np.zeros(len(self.h), bool)
        keys = np.sort(np.concatenate([from_six(d) | np.uint64(b) << np.uint64(48) for b, d in zip(told["x"].tolist(), told["data"].tolist())]))
        own = self.h & np.uint64(0xFFFFFFFFFFFF) | bucket_of(self.h, buckets).astype("u8") << np.uint64(48)
        return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own

    def around(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The surroundings of some seeds, where their strings begin and end, and a hash of both."""
        around = np.zeros((len(pick), AROUND), "u1")
        o = (self.at[pick] - self.lo[pick]) * 64 + self.at[pick] - self.hi[pick]
        if not len(pick):
            return around, o, np.empty(0, "u8")
        sizes = np.array([len(t) for t in self.texts], "i8")
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(self.texts), "u1")
        for a in range(0, len(pick), 1 << 16):
            s = pick[a : a + (1 << 16)]
            col = (self.at[s] - (W - 1))[:, None] + np.arange(AROUND)
            ok = (col >= self.lo[s][:, None]) & (col < (self.hi[s] + LENGTH)[:, None])
            around[a : a + len(s)][ok] = data[(starts[self.doc[s]][:, None] + col)[ok]]
        base = np.arange(len(pick)) * AROUND
        key = span_hashes(around.ravel(), base, base + AROUND)
        return around, o, mix(key ^ mix(o.astype("u8") + np.uint64(1)))

    def crowded(self, most: int) -> np.ndarray:
        """Seeds with more than ``most`` different surroundings in this group."""
        h, n = np.unique(self.h, return_counts=True)
        pick = np.flatnonzero(np.isin(self.h, h[n > most]))
        key, h = self.around(pick)[2], self.h[pick]
        order = np.lexsort((key, h))
        new = np.ones(len(pick), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
        h, n = np.unique(h[order][new], return_counts=True)
        return h[n > most]

    def surroundings(self, buckets: int):
        """Classes of equal surroundings of shared seeds.

        Per shared seed: its number, its class; per class: its first seed, which has the smallest doc_id.
        """
        pick = np.flatnonzero(self.shared(buckets))
        around, o, key = self.around(pick)
        ids = self.ids[self.doc[pick]] if len(pick) else np.empty(0, "i8")
        order = np.lexsort((np.arange(len(pick)), ids, key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(pick) else np.empty(0, bool)
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(pick) else order
        unlike = (around[lead] != around[order]).any(1) | (o[lead] != o[order])
        if unlike.any():  # unequal surroundings with one hash: those stand for themselves
            lead[unlike] = order[unlike]
        leader = np.empty(len(pick), "i8")
        leader[order] = lead
        first, cls = np.unique(leader, return_inverse=True)
        return pick, cls, first, around, ids

    def ends(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first and the last string of some seeds begin in their surroundings."""
        return W - 1 - (self.at[s] - self.lo[s]), W - 1 - (self.at[s] - self.hi[s])

    def strings(self, classes: np.ndarray, seeds: np.ndarray, around: np.ndarray, ids: np.ndarray):
        """The strings of some classes of surroundings: class, place in it, document, hash, and the equal string with the smallest document.

        ``seeds``, ``around`` and ``ids`` are those of the classes' first members.
        """
        lo, hi = self.ends(seeds)
        n = hi - lo + 1
        row = np.repeat(np.arange(len(seeds)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        data = np.ascontiguousarray(around).ravel()
        key = np.empty(len(row), "u8")
        for a, z, row_a, row_z in _slices(n):
            start = (row[row_a:row_z] - a) * AROUND + off[row_a:row_z]
            key[row_a:row_z] = span_hashes(data[a * AROUND : z * AROUND], start, start + LENGTH)
        doc, leader = ids[row], np.arange(len(row))
        if len(row):
            order = np.lexsort((doc, key))
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            view, start = np.lib.stride_tricks.sliding_window_view(data, LENGTH), row * AROUND + off
            for a in range(0, len(order), 1 << 15):
                x, y = order[a : a + (1 << 15)], lead[a : a + (1 << 15)]
                leader[x] = np.where((view[start[x]] == view[start[y]]).all(1), y, x)  # unequal strings with one hash stand for themselves
        return classes[row], off, doc, key, leader


def pass_one(buckets: int, crowd: int):
    def run(key, docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        grp, parts = Group(docs, side), []
        for crowded, h in ((False, np.unique(grp.h)), (True, grp.crowded(crowd))):
            b = bucket_of(h, buckets)
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            parts += [(int(b[a]), int(key[0]), crowded, six(h[a:e])) for a, e in zip(cuts, np.append(cuts[1:], len(h)))]
        return pd.DataFrame(parts, columns=["b", "g", "crowded", "data"])

    return run


def answer_one(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Which hashes of one bucket more than one group has, and which are crowded in some group, by group."""
    crowded = np.unique(np.concatenate([np.empty(0, "u8"), *(from_six(d) for d in rows.loc[rows["crowded"], "data"])]))
    rows = rows[~rows["crowded"]]
    every = np.concatenate([from_six(d) for d in rows["data"]])
    ordered = np.sort(every)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    out = []
    for kind, those in ((1, twice), (3, crowded)):
        if not len(those):
            continue
        hit = those[np.minimum(np.searchsorted(those, every), len(those) - 1)] == every
        at = 0
        for g, d in zip(rows["g"].tolist(), rows["data"]):
            n = len(d) // 6
            own = every[at : at + n][hit[at : at + n]]
            at += n
            if len(own):
                out.append((g, kind, int(key[0]), 0, six(own)))
    return pd.DataFrame(out, columns=["g", "kind", "x", "idx", "data"])


ENTRY = np.dtype([("cls", "<u4"), ("lo", "u1"), ("hi", "u1"), ("doc", "<i8"), ("around", "u1", AROUND)])
MASK = np.dtype([("cls", "<u4"), ("mask", "<u4")])


def pass_two(buckets: int, sort_buckets: int):
    def run(key, docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        grp = Group(docs, side)
        pick, cls, first, around, ids = grp.surroundings(buckets)
        crowded = grp.told(3, buckets)[pick[first]]
        whole, apart = np.flatnonzero(~crowded), np.flatnonzero(crowded)
        e = np.empty(len(whole), ENTRY)
        own = first[whole]
        e["cls"], e["doc"], e["around"] = whole, ids[own], around[own]
        e["lo"], e["hi"] = grp.ends(pick[own])
        b = bucket_of(grp.h[pick[own]], sort_buckets)
        if len(apart):  # strings are numbered after the classes
            cls, off, doc, h, leader = grp.strings(apart, pick[first[apart]], around[first[apart]], ids[first[apart]])
            s = np.unique(leader)
            more = np.empty(len(s), ENTRY)
            more["cls"], more["doc"], more["around"] = len(first) + s, doc[s], around[first[cls[s]]]
            more["lo"] = more["hi"] = off[s]
            e, b = np.concatenate([e, more]), np.concatenate([b, bucket_of(h[s], sort_buckets)])
        order = np.argsort(b, kind="stable")
        e, b = e[order], b[order]
        cuts = np.flatnonzero(np.diff(b, prepend=-1))
        parts = [(int(b[a]), int(key[0]), e[a:z].tobytes()) for a, z in zip(cuts, np.append(cuts[1:], len(e)))]
        return pd.DataFrame(parts, columns=["b", "g", "data"])

    return run


def _smaller(e: np.ndarray) -> np.ndarray:
    """For each of some surroundings, bits of the strings that a smaller document has.

    The strings of one seed come together; only so many are sorted at a time, by their hashes, and
    compared byte by byte with the first of their kind.
    """
    data = np.ascontiguousarray(e["around"]).ravel()
    lo, n = e["lo"].astype("i4"), e["hi"].astype("i4") - e["lo"] + 1
    who = np.repeat(np.arange(len(e), dtype="i4"), n)
    off = (np.arange(len(who)) - np.repeat(np.cumsum(n, dtype="i8") - n, n)).astype("i4") + lo[who]
    h = np.empty(len(who), "u8")
    for a, z, who_a, who_z in _slices(n):
        start = (who[who_a:who_z].astype("i8") - a) * AROUND + off[who_a:who_z]
        h[who_a:who_z] = span_hashes(data[a * AROUND : z * AROUND], start, start + LENGTH)
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    smaller = np.zeros(len(who), bool)
    parts = np.uint64(len(who) // SORTED_AT_ONCE + 1)
    for part in range(int(parts)):
        own = np.flatnonzero(h % parts == np.uint64(part)) if parts > 1 else np.arange(len(h))
        doc, start = e["doc"][who[own]], who[own].astype("i8") * AROUND + off[own]
        order = np.lexsort((doc, h[own]))
        if not len(order):
            continue
        same = h[own][order]
        new = np.concatenate([[True], same[1:] != same[:-1]])
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        less = np.zeros(len(own), bool)
        less[order] = doc[lead] < doc[order]
        for a in range(0, len(order), 1 << 15):
            x, y = start[order[a : a + (1 << 15)]], start[lead[a : a + (1 << 15)]]
            if (strings[x] != strings[y]).any():  # two strings with one hash: order them by themselves
                _, kind = np.unique(np.array([strings[i].tobytes() for i in start], f"S{LENGTH}"), return_inverse=True)
                low = np.full(kind.max() + 1, np.iinfo("i8").max)
                np.minimum.at(low, kind, doc)
                less = low[kind] < doc
                break
        smaller[own] = less
    mask = np.zeros(len(e), "u4")
    np.bitwise_or.at(mask, who[smaller], (np.uint32(1) << off[smaller].astype("u4")))
    return mask


def answer_two(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Group the strings of one bucket, a run of seeds at a time; say which of them a smaller document has."""
    e = np.frombuffer(b"".join(rows["data"]), ENTRY)
    seed = np.empty(len(e), "u8")
    for a in range(0, len(e), 1 << 14):
        around = e["around"][a : a + (1 << 14)]
        start = np.arange(len(around)) * AROUND + W - 1
        seed[a : a + len(around)] = span_hashes(np.ascontiguousarray(around).ravel(), start, start + SEED)
    order = np.argsort(seed, kind="stable")
    seed = seed[order]
    mask = np.zeros(len(e), "u4")
    at = 0
    while at < len(e):
        end = min(len(e), at + ENTRIES_AT_ONCE)
        end = int(np.searchsorted(seed, seed[end - 1], side="right"))
        mask[order[at:end]] = _smaller(e[order[at:end]])
        at = end
    out, at = [], 0
    for g, d in zip(rows["g"].tolist(), rows["data"]):
        n = len(d) // ENTRY.itemsize
        m = np.empty(n, MASK)
        m["cls"], m["mask"] = e["cls"][at : at + n], mask[at : at + n]
        m = m[m["mask"] > 0]
        at += n
        if len(m):
            out.append((g, 2, 0, 0, m.tobytes()))
    return pd.DataFrame(out, columns=["g", "kind", "x", "idx", "data"])


def _slices(n: np.ndarray, most: int = 1 << 14):
    ends = np.concatenate([[0], np.cumsum(n)])
    for a in range(0, len(n), most):
        z = min(a + most, len(n))
        yield a, z, ends[a], ends[z]


def pass_three(buckets: int, keep_text: bool):
    def run(key, docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        grp = Group(docs, side)
        pick, cls, first, around, ids = grp.surroundings(buckets)
        apart = np.flatnonzero(grp.told(3, buckets)[pick[first]])
        string, off, doc, _, leader = grp.strings(apart, pick[first[apart]], around[first[apart]], ids[first[apart]])
        mask, said = np.zeros(len(first), "u4"), np.zeros(len(string), bool)
        for d in side.loc[side["kind"] == 2, "data"]:
            m = np.frombuffer(d, MASK)
            own = m["cls"] < len(first)
            mask[m["cls"][own]] |= m["mask"][own]
            said[m["cls"][~own] - len(first)] = True
        said = said[leader] | (doc[leader] < doc)
        np.bitwise_or.at(mask, string[said], np.uint32(1) << off[said].astype("u4"))
        full = np.uint32(2**W - 1)
        own = np.where(ids > ids[first][cls], full, mask[cls]) if len(pick) else mask[cls]
        size = np.array([len(t) for t in grp.texts], "i8")
        base = np.cumsum(size) - size
        edge = np.zeros(int(size.sum()) + 1, "i4")
        hit = np.flatnonzero(own)
        own, pick = own[hit], pick[hit]
        for o in range(W):
            p = grp.at[pick] - (W - 1) + o
            ok = (own >> np.uint32(o) & np.uint32(1)).astype(bool) & (p >= grp.lo[pick]) & (p <= grp.hi[pick])
            p = p[ok] + base[grp.doc[pick[ok]]]
            edge[p] += 1  # a place begins one string, so p has no repeats; neighbours of p + LENGTH neither
            edge[p + LENGTH] -= 1
        gone = np.cumsum(edge[:-1], dtype="i4") > 0
        del edge
        place = {i: k for k, i in enumerate(grp.active)}
        have = dict.fromkeys(side.loc[side["kind"] == 0, "x"].tolist())
        out = []
        for i, (d, t) in enumerate(grp.all):
            k = place.get(i)
            if k is None and len(t) >= LENGTH and d in have and i and grp.all[i - 1] == (d, t):
                j = i  # the same row again
                while j not in place:
                    j -= 1
                k = place[j]
            if k is not None:
                cut_ = gone[base[k] : base[k] + size[k]]
                removed, spans = int(cut_.sum()), int((np.diff(cut_.astype("i1"), prepend=0) == 1).sum())
                left = np.frombuffer(t, "u1")[~cut_].tobytes()
            elif len(t) >= LENGTH:  # a copy of a text with a smaller doc_id
                removed, spans, left = len(t), 1, b""
            else:
                removed, spans, left = 0, 0, t
            out.append((d, len(t), removed, spans, hashlib.sha256(left).hexdigest(), left if keep_text else None))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(documents: DataFrame, keep_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the bytes left, if asked for)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    first = cut(known.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("x"), F.max(F.octet_length("text")).cast("long").alias("n")))
    total = first.agg(F.sum("n")).first()[0] or 0
    n, seed_buckets, sort_buckets = (max(32, -(-total // size)) for size in (GROUP_BYTES, SEED_BUCKET_BYTES, SORT_BUCKET_BYTES))
    group = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    # partitions grow with the input, so that what a task reads doesn't
    shuffle = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, seed_parts, sort_parts = (max(shuffle, -(-total // PARTITION_BYTES)), max(shuffle, seed_buckets), max(shuffle, -(-sort_buckets // 8)))
    known = known.withColumn("g", group).repartition(parts, "g")
    none = lambda t: F.lit(None).cast(t)
    lead = first.select(F.pmod(F.xxhash64("x"), F.lit(n)).alias("g"), F.lit(0).alias("kind"), "x", F.lit(0).cast("long").alias("idx"), none("binary").alias("data"))

    def with_docs(side: DataFrame, f, schema: str) -> DataFrame:
        return known.groupBy("g").cogroup(side.groupBy("g")).applyInPandas(f, schema)

    sent = "b long, g long, data binary"
    told = lead.union(with_docs(lead, pass_one(seed_buckets, crowd), "b long, g long, crowded boolean, data binary").repartition(seed_parts, "b").groupBy("b").applyInPandas(answer_one, SIDE))
    told_more = told.union(with_docs(told, pass_two(seed_buckets, sort_buckets), sent).repartition(sort_parts, "b").groupBy("b").applyInPandas(answer_two, SIDE))
    out = with_docs(told_more, pass_three(seed_buckets, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = docs.where("doc_id is null").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        (F.encode("text", "UTF-8") if keep_text else none("binary")).alias("kept"),
    )
    return out.union(rest)


def op9_substrings(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
