"""Best-fit packing of tokenised documents by a linear grouping scheme.

1. Every document becomes its token ids plus an end id; only longer ones are cut into pieces of the
   sequence length.  Tasks do this once; what is kept of a piece is its length and checksum.
2. A plan is made from the histogram of piece lengths alone (at most ``seq_len`` rows, whatever the
   size of the corpus).  Large lengths are divided into groups of equal cardinality and rounded up
   to their group's largest; with so few sizes, configurations are found by a bounded knapsack that
   always takes the largest size left; then the groups' actual lengths take the configurations'
   places, and small lengths go best-fit into the room that is really left.
3. A plan is a list of runs "pieces of length L with ranks r .. r+n go to sequences s .. s+n at offset
   o".  Pieces get their rank within their length from counts by (length, bucket), so no task sees
   all pieces of a length, and find their run by binary search.

The number of runs depends on ``seq_len`` and the number of groups, not on the corpus.  Several
numbers of groups and lengths at which large begins are tried, and the plan with the fewest sequences
is taken.  Where large begins at half a sequence, a configuration holds one large piece and its room
goes to best fit; where it begins lower, configurations combine several.

Null text is the empty text: one piece that holds the end id.  Null and repeated doc_ids are kept.
An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import parts

CACHE_WORDS = 400_000  # words whose ids a worker remembers; others are encoded each time they come
CACHED_CHARS = 64  # longer words are not remembered, which bounds the bytes of the cache too
TEXT_AT_ONCE = 1 << 19
_workers: dict[str, "WordEncoder"] = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts by a tokenizer that drops white space, word by word from a cache.

    Exact because such a tokenizer treats what blanks separate independently.  Before the split,
    capitals of texts below U+0180 are lowered (the tokenizer does so too), and a comma or full stop
    between a letter or digit and a blank is set apart, which its own rules do as well.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        ends = self.tok.get_vocab()
        self.ends = np.zeros(max(ends.values()) + 1, bool)
        for token, i in ends.items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {"": b""}
        parts = json.loads(self.tok.to_str())
        blanks = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        parts |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": blanks}}
        self.lowered = Tokenizer.from_str(json.dumps(parts))  # the same, for words that are lowered letters
        self.far = re.compile("[^\x00-\u017f]").search
        self.joined = re.compile(r"[,.] (?<![^\W_][,.] )").search
        self.apart = re.compile(r"(?<=[^\W_])([,.])(?= )").sub

    def split(self, text: str) -> list[str]:
        text = text.replace("\n", " ")
        if "<|" not in text and (text.isascii() or self.far(text) is None):  # special tokens are matched before capitals are lowered
            text = text.lower()
        if self.joined(text) is None:
            text = text.replace(", ", " , ").replace(". ", " . ")
        else:
            text = self.apart(r" \1", text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.split(t) for t in texts]
        new = list(set().union(*split).difference(self.words))
        if new:
            self._learn(new)
        out = [b"".join(map(self.words.__getitem__, w)) for w in split]
        over = max(0, len(self.words) - CACHE_WORDS)
        for k, w in enumerate(new):
            if len(w) > CACHED_CHARS or k >= len(new) - over:
                del self.words[w]
        return out

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        if plain:  # one run of letters is one word to the tokenizer, and its last id ends a word
            line = " ".join(plain)
            tok = self.lowered if line == line.lower() and self.far(line) is None else self.tok
            ids = np.array(tok.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(plain) and at[-1] == len(ids):
                raw, last = ids.tobytes(), 0
                for w, e in zip(plain, (at * 4).tolist()):
                    self.words[w] = raw[last:e]
                    last = e
            else:
                rest += plain
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            self.words[w] = np.array(e.ids, "<u4").tobytes()


def _pieces(file: str, seq_len: int, end_id: int):
    """``mapInArrow`` function over (doc_id, text): a row for each piece of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _workers.get(file) or _workers.setdefault(file, WordEncoder(file))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, out, first = [], [], 0
            for texts in parts(batch, 1, TEXT_AT_ONCE):
                for i, ids in enumerate(enc.encode([t or "" for t in texts.column(1).to_pylist()]), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * seq_len)):
                        part = ids[at : at + 4 * seq_len]
                        row.append(i)
                        out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                first += texts.num_rows
            k, start, length, crc = np.array(out, "i8").reshape(-1, 4).T
            docs = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array(k.astype("i4")), *map(pa.array, (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(documents: DataFrame, file: str, seq_len: int, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(file, seq_len, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs by length: arrays of first rank, first sequence and offset; and the number of sequences."""

    def __init__(self, seq_len: int):
        self.seq_len, self.sequences = seq_len, 0
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        self.room: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, count)

    def put(self, length: int, rank: int, first: int, offset: int) -> None:
        self.runs.setdefault(length, []).append((rank, first, offset))

    def free(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.room.setdefault(room, []).append((first, n))

    def open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.array(sorted(v), "int64").T for k, v in self.runs.items()}


def equal_groups(hist: dict[int, int], lengths: list[int], k: int) -> list[list[list[int]]]:
    """Lengths from the largest down in ``k`` groups of equal cardinality; runs of [length, rank, n]."""
    total = sum(hist[x] for x in lengths)
    groups: list[list[list[int]]] = [[] for _ in range(k)]
    seen = 0
    for x in lengths:
        n, rank = hist[x], 0
        while n:
            g = min(k - 1, seen * k // total)
            take = min(n, -(-(g + 1) * total // k) - seen) if g < k - 1 else n
            groups[g].append([x, rank, take])
            seen, rank, n = seen + take, rank + take, n - take
    return [g for g in groups if g]


def fullest(sizes: list[int], left: list[int], seq_len: int) -> list[int]:
    """How many of each size make the fullest sequence with at least one of the largest size left."""
    lead = next(i for i, n in enumerate(left) if n)
    room = seq_len - sizes[lead]
    best = np.zeros(room + 1, "int64")
    took = []
    for i in range(lead, len(sizes)):
        most = min(left[i] - (i == lead), room // sizes[i])
        step = 1
        while most > 0:
            m = min(step, most)
            w = m * sizes[i]
            if w <= room:
                cand = np.full(room + 1, -1, "int64")
                cand[w:] = best[: room + 1 - w] + w
                better = cand > best
                if better.any():
                    best = np.where(better, cand, best)
                    took.append((i, m, w, better))
            most, step = most - m, step * 2
    config = [0] * len(sizes)
    config[lead] = 1
    at = room
    for i, m, w, better in reversed(took):
        if better[at]:
            config[i] += m
            at -= w
    return config


def _draw(pool: list[list[int]], n: int) -> list[tuple[int, int, int]]:
    out = []
    while n:
        run = pool[0]
        take = min(n, run[2])
        out.append((run[0], run[1], take))
        run[1], run[2], n = run[1] + take, run[2] - take, n - take
        if not run[2]:
            pool.pop(0)
    return out


def make_plan(hist: dict[int, int], seq_len: int, groups: int, small: int) -> Plan:
    plan = Plan(seq_len)
    if hist.get(seq_len):
        plan.put(seq_len, 0, plan.open(hist[seq_len]), 0)
    large = sorted((x for x in hist if small < x < seq_len), reverse=True)
    if large:
        pools = equal_groups(hist, large, min(groups, sum(hist[x] for x in large)))
        sizes = [g[0][0] for g in pools]
        left = [sum(r[2] for r in g) for g in pools]
        while any(left):
            config = fullest(sizes, left, seq_len)
            times = min(left[i] // c for i, c in enumerate(config) if c)
            slots = [_draw(pools[i], times) for i, c in enumerate(config) for _ in range(c)]
            for i, c in enumerate(config):
                left[i] -= c * times
            first = plan.open(times)
            ends = sorted({int(e) for s in slots for e in np.cumsum([r[2] for r in s])})
            at = [[0, 0] for _ in slots]  # run and place in it, for each slot
            done = 0
            for e in ends:
                n, offset = e - done, 0
                for s, a in zip(slots, at):
                    length, rank, have = s[a[0]]
                    plan.put(length, rank + a[1], first + done, offset)
                    offset += length
                    a[1] += n
                    if a[1] == have:
                        a[0], a[1] = a[0] + 1, 0
                plan.free(seq_len - offset, first + done, n)
                done = e
    for x in sorted((x for x in hist if x <= small and x < seq_len), reverse=True):
        _best_fit(plan, x, hist[x])
    return plan


def _best_fit(plan: Plan, length: int, n: int) -> None:
    rank = 0
    while n:
        rooms = sorted(plan.room)
        i = bisect_left(rooms, length)
        room = rooms[i] if i < len(rooms) else plan.seq_len
        per = room // length
        if i < len(rooms):
            first, have = plan.room[room].pop()
            if not plan.room[room]:
                del plan.room[room]
        else:
            have = -(-n // per)
            first = plan.open(have)
        whole = min(have, n // per)
        for k in range(per):
            if whole:
                plan.put(length, rank + k * whole, first, plan.seq_len - room + k * length)
        rank, n = rank + per * whole, n - per * whole
        plan.free(room - per * length, first, whole)
        if whole < have and n < per:  # one more sequence takes the rest
            for k in range(n):
                plan.put(length, rank + k, first + whole, plan.seq_len - room + k * length)
            plan.free(room - n * length, first + whole, 1 if n else 0)
            used = whole + (1 if n else 0)
            n = 0
            plan.free(room, first + used, have - used)


def best_plan(hist: dict[int, int], seq_len: int, tries=((64, 2), (128, 3), (256, 4), (512, 4))) -> Plan:
    """The plan with the fewest sequences over (groups, ``seq_len`` // largest small length)."""
    plans = [make_plan(hist, seq_len, k, seq_len // part) for k, part in tries]
    return min(plans, key=lambda p: p.sequences)


def pack(documents: DataFrame, file: str | None = None, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.  ``documents`` has ``doc_id`` and ``text``."""
    spark = documents.sparkSession
    pieces = cut(cut_pieces(documents, file or tokenizer_file(), seq_len, end_id))
    hist = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most seq_len rows
    plan = best_plan(hist, seq_len)
    runs = spark.sparkContext.broadcast(plan.arrays())

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = pieces.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("_place", place).join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_place"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy() for i in (3, 5))
            seq, off = np.zeros(len(ranks), "i8"), np.zeros(len(ranks), "i8")
            for x in np.unique(lengths):
                own = lengths == x
                r, s, o = runs.value[int(x)]
                i = np.searchsorted(r, ranks[own], side="right") - 1
                seq[own], off[own] = s[i] + ranks[own] - r[i], o[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "_rank").mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
