"""Packing into full windows by multiway differencing.

1. Tasks tokenise documents once and write what they get (16-bit ids where the vocabulary allows) in
   rows of at most ``ROW_WINDOWS`` windows, each with a number of its own.
2. Rows are dealt to buckets of about ``BUCKET_WINDOWS`` windows by a hash of that number, so neither a
   source, a group of copies nor a repeated id can make a bucket larger.  Sums of tokens by bucket, in
   the buckets' order, give each bucket its stretch of the numbered tokens of the whole corpus.
3. A bucket's windows are those that lie in its stretch entirely; a few documents at its ends fill the
   two windows that it shares with its neighbours.  Of a longer document whole windows are cut first.
   The rest goes through Karmarkar and Karp's differencing: partial partitions into k windows are merged,
   the two with the largest imbalance first, the fullest window of one with the emptiest of the other.
   k begins at the least number of windows and rises whenever one is over capacity.
4. The windows that are now nearly equal are filled up: the emptiest ones are dissolved, as many as k
   has risen, and their documents are cut to fill the room of the others exactly.

Thus every window is full but one of the whole corpus, and that one is cut at powers of two, which
need no padding.  Documents are cut only where a window is filled up or a bucket ends.

Null text is the empty text: one piece that holds the end id.  Null and repeated doc_ids are kept, as
documents of their own.  An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .packing import CACHED_CHARS, TEXT_AT_ONCE, WordEncoder, tokenizer_file
from .tokens import groups

SEQ_LEN, END_ID = 4096, 2
BUCKET_WINDOWS = 48
ROW_WINDOWS = 4
SMALL = 128  # documents shorter than this part of a window go together, as one item of at least so many tokens
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

WORDS = 1_000_000  # whose ids a worker remembers, some 200 MB
_workers: dict[str, "Encoder"] = {}

Part = tuple[int, int, int]  # row, first id of it, number of ids


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in at most ``k`` sets of nearly equal sums."""
    # a partial partition: its windows with something in them, fullest first, as (sum, tree of indices)
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the last ``over`` windows of a meet those of b, fullest with emptiest
            cut = len(a) - over
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[cut:], reversed(b[len(b) - over :]))]
            a = a[:cut] + met + b[: len(b) - over]
        else:
            a = a + b
        a.sort(key=lambda w: -w[0])
        low = a[-1][0] if len(a) == k else 0
        heapq.heappush(heap, (low - a[0][0], order, a))
        order += 1
    sets = []
    for _, tree in heap[0][2] if heap else ():
        own, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                own.append(t)
        sets.append(own)
    return sets


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """The least k of windows, from the lower bound on, that differencing fills within capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        sets = differencing(sizes, k)
        over = max((sum(sizes[i] for i in s) for s in sets), default=0) - capacity
        if over <= 0:
            return sets
        k += max(1, k * over // (4 * capacity))  # far over: more at once


def take(parts: list[Part], n: int) -> tuple[list[Part], list[Part]]:
    """The first ``n`` ids of ``parts``, and the rest."""
    for i, (row, at, have) in enumerate(parts):
        if have >= n:
            rest = [(row, at + n, have - n)] if have > n else []
            return [*parts[:i], *([(row, at, n)] if n else [])], [*rest, *parts[i + 1 :]]
        n -= have
    return parts, []


def full_windows(parts: list[Part], capacity: int) -> list[list[Part]]:
    """Windows of exactly ``capacity`` ids each; ``parts`` have a multiple of it in all."""
    total = sum(n for _, _, n in parts)
    windows, items, small, least = [], [], [], max(1, capacity // SMALL)
    for row, at, n in parts:
        while n >= capacity:
            windows.append([(row, at, capacity)])
            at, n = at + capacity, n - capacity
        if n >= least:
            items.append([(row, at, n)])
        elif n:
            small.append((row, at, n))
            if sum(x[2] for x in small) >= least:
                items.append(small)
                small = []
    if small:
        items.append(small)
    sizes = [sum(x[2] for x in i) for i in items]
    sets = balanced(sizes, capacity)
    fills = sorted(([x for i in s for x in items[i]] for s in sets), key=lambda w: -sum(x[2] for x in w))
    keep = total // capacity - len(windows)
    spare = [x for w in fills[keep:] for x in sorted(w, key=lambda x: -x[2])]  # of the dissolved windows
    for w in fills[:keep]:
        more, spare = take(spare, capacity - sum(x[2] for x in w))
        windows.append(w + more)
    while spare:  # fewer windows than needed have been filled: the rest makes the others
        w, spare = take(spare, capacity)
        windows.append(w)
    return windows


def bucket_windows(lengths: list[int], before: int, capacity: int) -> list[tuple[int, int, list[Part]]]:
    """(window, offset in it, parts) for a bucket whose tokens come after ``before`` others in the corpus."""
    total = sum(lengths)
    parts: list[Part] = [(i, 0, n) for i, n in enumerate(lengths)]
    head, parts = take(parts, min(total, -before % capacity))
    out = [(before // capacity, before % capacity, head)] if head else []
    first = -(-before // capacity)
    inner = (total - sum(x[2] for x in head)) // capacity
    parts, tail = take(parts, inner * capacity)
    out += [(first + k, 0, w) for k, w in enumerate(full_windows(parts, capacity))]
    return [*out, (first + inner, 0, tail)] if tail else out


class Encoder(WordEncoder):
    """The same ids, with WORDS words remembered."""

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = list(set().union(*split).difference(self.words))
        if new:
            self._learn(new)
        out = [b"".join(map(self.words.__getitem__, w)) for w in split]
        over = max(0, len(self.words) - WORDS)
        for k, w in enumerate(new):
            if len(w) > CACHED_CHARS or k >= len(new) - over:
                del self.words[w]
        return out


def tokens(documents: DataFrame, file: str, seq_len: int, end_id: int) -> DataFrame:
    """``part, nth, doc_id, start, doc_tokens, n, ids`` of documents; (part, nth) numbers the rows."""
    most = ROW_WINDOWS * seq_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _workers.get(file) or _workers.setdefault(file, Encoder(file))
        end = np.array([end_id], "<u4").tobytes()
        part, nth = TaskContext.get().partitionId(), 0
        gc.disable()  # words make many objects and no circles
        for batch in batches:
            docs, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts, TEXT_AT_ONCE):
                row, numbers, raw = [], [], []
                for i, ids in enumerate(enc.encode(texts[a:b]), a):
                    ids += end
                    for at in range(0, len(ids), 4 * most):
                        own = ids[at : at + 4 * most]
                        row.append(i)
                        numbers.append((nth, at // 4, len(ids) // 4, len(own) // 4))
                        narrow = np.frombuffer(own, "<u4")
                        raw.append(narrow.astype("<u2").tobytes() if narrow.max() < 1 << 16 else own)
                        nth += 1
                n, start, all_, length = np.array(numbers, "i8").T
                columns = [pa.array(np.full(len(n), part, "i8")), pa.array(n), docs.take(pa.array(row, pa.int64())), *map(pa.array, (start, all_, length)), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "nth", "doc_id", "start", "doc_tokens", "n", "ids"])
        gc.enable()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part long, nth long, doc_id long, start long, doc_tokens long, n long, ids binary")


def pack(documents: DataFrame, file: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, bucket_windows_: int = BUCKET_WINDOWS) -> DataFrame:
    """Pieces (see COLUMNS).  ``documents`` has ``doc_id`` and ``text``."""
    rows = written(tokens(documents, file or tokenizer_file(), seq_len, end_id))
    total = rows.agg(F.sum("n").alias("n")).first().n or 0
    buckets = max(1, total // (seq_len * bucket_windows_))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("part", "nth"), F.lit(buckets)))
    # sums in two steps, so that no task sees all buckets
    block = F.floor(F.col("bucket") / 4096)
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("block", block)
    blocks = sums.groupBy("block").agg(F.sum("n").alias("all")).withColumn("base", F.sum("all").over(Window.orderBy("block")) - F.col("all"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")
    before = sums.withColumn("inside", inside).join(blocks, "block").select("bucket", (F.col("base") + F.col("inside")).alias("before"))

    whole = total // seq_len
    left, ends = total % seq_len, []  # the last window is cut at powers of two
    for bit in reversed(range(seq_len.bit_length())):
        if left >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))

    def placed(window: int, offset: int, parts: list[Part]) -> Iterator[tuple[int, int, int, int, int]]:
        """row, first id, number, sequence, offset."""
        for row, at, n in parts:
            if window < whole:
                yield row, at, n, window, offset
                offset += n
                continue
            while n:
                k = next(i for i, e in enumerate(ends) if offset < e)
                m = min(n, ends[k] - offset)
                yield row, at, m, whole + k, offset - (ends[k - 1] if k else 0)
                at, n, offset = at + m, n - m, offset + m

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.combine_chunks().sort_by([("part", "ascending"), ("nth", "ascending")])
        lengths = own.column("n").to_pylist()
        ids = own.column("ids").to_pylist()
        pieces = [p for w in bucket_windows(lengths, own.column("before")[0].as_py(), seq_len) for p in placed(*w)]
        cut = []
        for row, at, n, _, _ in pieces:
            width = len(ids[row]) // lengths[row]
            cut.append(zlib.crc32(np.frombuffer(ids[row], f"<u{width}")[at : at + n].astype("<u4").tobytes()))
        row, at, n, sequence, offset = np.array(pieces, "i8").T
        taken = own.select(["doc_id", "start", "doc_tokens"]).take(pa.array(row))
        start = taken.column("start").to_numpy() + at
        return pa.table(
            {"doc_id": taken.column("doc_id"), "start": start, "length": n, "ids_crc32": np.array(cut, "i8"), "doc_tokens": taken.column("doc_tokens"), "sequence_id": sequence, "offset": offset}
        )

    return rows.join(before, "bucket").groupBy("bucket").applyInArrow(run, COLUMNS)


def op13_balanced_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
