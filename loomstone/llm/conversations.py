"""Repair of the structure of conversations as a lightest derivation.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``.  Rows can be kept,
given another role, deleted, or inserted; the cheapest way is sought, and of equally cheap ways the one
whose audit (the edits' first letters in order) is least in ASCII.

*Items* are "the first i rows are used up and the output ends in state q", with the states E (nothing put
out), S, U and A.  A *deduction* takes such an item and the axiom "row i + 1 is of this kind" and gives an
item of row i + 1; the *goal* takes an item of the last row.  Values are pairs (cost, audit).  Every
deduction adds to the cost and appends to the audit, and audits of one item end in an edit that uses up
a row, so none is a proper beginning of another of the same row: the functions are monotone and superior,
and Knuth's agenda finalises each item when it is popped.  It stops when the goal is popped.

Damage, faults and first occurrences are DataFrame functions.  Conversations are dealt to tasks by id, and
a task streams its rows in order, ``CHUNK_ROWS`` or ``CHUNK_CHARS`` at a time: a chunk's agenda begins
with the items that the chunk before it finalised, each with the state of its hash, so texts of a chunk
only are held.  What grows with a conversation is the audit, which is part of the result; the hash over
its repaired text is serial by definition, so one conversation is one task's work.

Rows of one turn are ordered by role, then by text.  Null text, role, conv_id and turn count as one space
where text is made of them; null turns come first and don't count for gaps; null conv_id is one
conversation.  Rows that repeat are duplicates; a row whose role is empty can't be kept as it is.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 22
BLANK_CLASS = r"[^\x20\x09-\x0D]"
MOVES = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}  # what may follow, and the state after it
ROLES = {"u": "user", "a": "assistant"}
LONG = 2**63 - 1
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _ways(state: str, letter: str) -> Iterator[tuple[str, str]]:
    """(inserted letters, state after ``letter``) from ``state``: none or one insertion before it."""
    if letter in MOVES[state]:
        yield "", MOVES[state][letter]
    for put, then in MOVES[state].items():
        if put in ROLES and letter in MOVES[then]:
            yield put, MOVES[then][letter]


def _deductions() -> dict[tuple[str, str, bool, bool], list[tuple[str, int, str, str]]]:
    """By (state, first letter of the role, must go, truncated): (state after, cost, audit, letters put out)."""
    out = {}
    for state in MOVES:
        for letter in "sua?":
            for gone in (False, True):
                for cutoff in (False, True):
                    ways = [(state, DELETE, "D", "")]
                    if not gone:
                        extra = TRUNCATED if cutoff else 0
                        ways += [(then, INSERT * len(put) + KEEP + extra, "I" * len(put) + "K", put + letter) for put, then in _ways(state, letter)]
                        for new in ROLES:
                            ways += [(then, INSERT * len(put) + REROLE + extra, "I" * len(put) + "R", put + new) for put, then in _ways(state, new)]
                    out[state, letter, gone, cutoff] = ways
    return out


DEDUCTIONS = _deductions()
GOAL = {"E": ("", 0), "S": ("ua", 2 * INSERT), "U": ("a", INSERT), "A": ("", 0)}  # letters put at the end, and their cost


class Item:
    """A finalised item at the end of a chunk: cost, audit in parts, hash of what was put out, and whether anything was."""

    __slots__ = ("cost", "audit", "sha", "any")

    def __init__(self, cost: int, audit: list[str], sha, any_: bool):
        self.cost, self.audit, self.sha, self.any = cost, audit, sha, any_


def lightest(starts: list[tuple[str, int]], kinds: list[tuple[str, bool, bool]], last: bool) -> dict[str, tuple[int, int, str, list]]:
    """Knuth's agenda over one chunk.

    ``starts``: (state, cost) of the items that hold before it, ordered by audit.  Gives by state at the end
    of the chunk, or for the goal alone (state "") if it is the ``last``: cost, number of the start, audit
    within the chunk, letters put out by each row (and at the end).
    """
    n = len(kinds)
    agenda = [(cost, rank, "", 0, state, None, "") for rank, (state, cost) in enumerate(starts)]
    heapq.heapify(agenda)
    done: dict[tuple[int, str], tuple] = {}
    ends: dict[str, tuple] = {}
    while agenda:
        cost, rank, audit, i, state, before, put = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done[i, state] = (before, put)
        if i == n and (not last or state == ""):
            ends[state] = (cost, rank, audit)
            if last or len(ends) == len(MOVES):
                break
            continue
        if i == n:
            more, price = GOAL[state]
            heapq.heappush(agenda, (cost + price, rank, audit + "I" * len(more), n, "", (n, state), more))
            continue
        letter, gone, cutoff = kinds[i]
        for then, price, edit, out in DEDUCTIONS[state, letter, gone, cutoff]:
            if (i + 1, then) not in done:
                heapq.heappush(agenda, (cost + price, rank, audit + edit, i + 1, then, (i, state), out))
    got = {}
    for state, (cost, rank, audit) in ends.items():
        puts, at = [], (n, state)
        while at is not None:
            at, put = done[at]
            puts.append(put)
        got[state] = (cost, rank, audit, puts[-2::-1])  # the last of them is the start's
    return got


class Conversation:
    """One conversation, fed row by row in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.letter = self.key = None
        self.items = {"E": Item(0, [], hashlib.sha256(), False)}
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[tuple[str, bool, bool]] = []
        self.chars = 0

    def add(self, turn, role: str, text: str, blank: bool, early: bool, cutoff: bool) -> None:
        """``early``: an earlier turn has the same role and text."""
        key = (turn, role, text)
        repeated = early or key == self.key
        self.key = key
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.turns = turn, turn, self.turns + 1
        letter = role[:1]
        if self.letter is not None and self.letter + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.letter = letter
        repeated, cutoff = repeated and not blank, cutoff and not blank and not repeated
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cutoff
        self.kinds.append((letter if letter and letter in "sua" else "?", blank or repeated, cutoff))
        self.rows.append((role, text))
        self.chars += len(text)
        if len(self.rows) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS:
            self._chunk(False)

    def _chunk(self, last: bool) -> None:
        order = sorted(self.items.items(), key=lambda x: x[1].audit)
        items = {}
        for state, (cost, rank, audit, puts) in lightest([(s, i.cost) for s, i in order], self.kinds, last).items():
            old = order[rank][1]
            sha, any_ = old.sha.copy(), old.any
            for (role, text), put in zip([*self.rows, ("", "")], puts):
                own = len(put) - 1 if len(puts) and put else 0
                for k, letter in enumerate(put):
                    line = f"{role if role[:1] == letter else ROLES[letter]}:{text}" if k == own else f"{ROLES[letter]}:"
                    sha.update((("\n" if any_ else "") + line).encode("utf-8", "surrogatepass"))
                    any_ = True
            items[state] = Item(cost, [*old.audit, audit], sha, any_)
        self.items, self.rows, self.kinds, self.chars = items, [], [], 0

    def result(self) -> tuple:
        self._chunk(True)
        end = self.items[""]
        gaps = min(LONG, self.high - self.low + 1 - self.turns) if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, end.cost, "".join(end.audit), end.sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: faults put in by ``crc32(conv_id:turn) % 20``; dropped rows stay, marked."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(some("conv_id"), F.lit(":"), some("turn")), "UTF-8")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), twice.alias("_n")).drop("_n")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conv_id, turn, role, text, dropped`` (see RESULT)."""
    spark = rows.sparkSession
    same = F.md5(F.encode(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), "UTF-8"))
    rows = rows.withColumn("_same", same)
    # repeated rows only, so that most conversations have nothing to join; counts combine before the shuffle
    at = F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn").alias("turn"))
    firsts = rows.where("not dropped").groupBy(F.col("conv_id").alias("_c"), F.col("_same").alias("_s")).agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where("_first < _last").drop("_last")
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_same") == F.col("_s")), "left")
    early = F.coalesce(F.col("_first") < at, F.lit(False))
    blank = ~F.col("text").rlike(BLANK_CLASS)
    cutoff = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    flagged = joined.select("conv_id", "turn", "role", "text", "dropped", blank.alias("blank"), early.alias("early"), cutoff.alias("cutoff"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = flagged.repartition(parts, F.xxhash64("conv_id")).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        for part in batches:
            for conv, turn, role, text, dropped, blank, early, cutoff in zip(*(c.to_pylist() for c in part.columns)):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv)
                if not dropped:
                    now.add(turn, role, text, blank, early, cutoff)
            if len(out) >= 1024:
                yield batch()
                out = []
        if now is not None:
            out.append(now.result())
        if out:
            yield batch()

    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    return ordered.mapInArrow(run, RESULT)


def op11_conversation_repair(spark, sf_dir) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
